"""HTML extraction by wrapper induction.

The pages of a host come from one wrapper. Each page's tree of block elements is aligned with the
tree of one exemplar of its host by simple tree matching (the largest set of pairs of equal labels
that keeps order and ancestry). A node of the exemplar whose text is the same on most aligned pages
is template, the others are slots. Template nodes, and elements that say by tag, role or class
that they are no content, are dropped; the text of the slots is the main text. Where a page marks
its main part, that element holds the slots, with what stands around an article in it; without one, or with most
text in an article elsewhere, the article does, if it holds most of what is not template. Inside a marked part
a node is template only if nearly all pages with another story have its text; a page that shares most of the
exemplar's story is a copy of it and has no vote there.

A class or id counts as a whole: ``sidebar`` and ``site-footer`` are no content, ``no-sidebar`` and
``legal-history`` say nothing. An element that would leave next to nothing of a page is content, whatever its name.

All pages of a host vote; the votes are added up before they are shuffled. Pages are joined with
their host's exemplar; the pages of a host are dealt to as many salts as their size asks for, so a host with
any share of the pages is spread over tasks of bounded size.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensa.llm import repeats as rp
from propensa.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A node is template if so many aligned pages vote, and that share of them have its text.
LEAST_VOTES, TEMPLATE_SHARE = 3, 0.5
#: The share inside a marked main part.
MARKED_SHARE = 0.9
#: An element that is no content by its name or as a form has at most so many times the text of the rest of the page.
REST = 10
#: Characters of a host's pages that go to one task.
SALT_CHARS = 1 << 21
#: Levels of a tree that are aligned; what lies deeper is read, but counted with its ancestor.
LEVELS = 100

# Elements that end a block, that hold no running text, and that are never content.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg textarea select button object title head".split())
CHROME_TAGS = frozenset("nav footer aside menu dialog header".split())
CHROME_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert form menu".split())
CHROME_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related "
    "recommended recommendations comment comments respond reply replies disqus discussion widget pagination pager toolbar "
    "skip copyright legal disclaimer".split()
)
#: Parts of a name that say where or in what form something stands, but not what it is.
PLACES = frozenset(
    "site page main global top bottom left right primary secondary sub mobile desktop sticky fixed inner outer wrap wrapper "
    "container box block area section region zone row col column list item items link links bar button buttons icon icons "
    "group panel slot unit space label title text content body module component form posts post articles stories news "
    "first last small large js u c 0 1 2 3 4 5 6 7 8 9".split()
)
CLOSES = {  # an opening tag ends these open elements, up to the scope
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)([^>]*)>|<[!?][^>]*>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def no_content(name: str) -> bool:
    """Does a class or id say that its element is no content? All its parts must, or tell a place or form."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    return any(p in CHROME_NAMES for p in parts) and all(p in CHROME_NAMES or p in PLACES for p in parts)


class Page:
    """Block elements of a page, in order, and the pieces of text between their tags."""

    def __init__(self, source: str) -> None:
        self.tag = ["#root"]
        self.label = ["#root"]
        self.parent = [-1]
        self.children: list[list[int]] = [[]]
        self.depth = [0]
        self.chrome = [False]
        self.named = [False]
        self.marked = [0]
        self.in_main = [False]
        self.texts: list[tuple[int, str]] = []
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        stack, at, piece = [0], 0, []

        def flush() -> None:
            if piece:
                text = " ".join(html.unescape("".join(piece)).split())
                if text:
                    self.texts.append((stack[-1], text))
                piece.clear()

        match = TOKEN.search(source)
        while match:
            piece.append(source[at : match.start()])
            at = match.end()
            closing = match[1] or match[4]
            name = (match[2] or match[5] or "").lower()
            if not name:
                pass
            elif closing:
                if name in BLOCKS:
                    flush()
                    self._close(stack, name)
                elif name == "br":
                    piece.append(" ")
            elif name in RAW:
                if not (match[3] or match[6] or "").endswith("/"):
                    if name == "head":
                        end = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(source, at)
                        at = end.end() if end else at
                    else:
                        end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                        at = end.end() if end else len(source)
                    piece.append(" " if name in ("select", "textarea", "button") else "")
            elif name in BLOCKS:
                flush()
                self._open(stack, name, match[3] or match[6] or "")
            elif name in VOID:
                piece.append(" " if name == "br" else "")
            match = TOKEN.search(source, at)
        piece.append(source[at:])
        flush()

    def _close(self, stack: list[int], name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] == name:
                del stack[i:]
                return

    def _open(self, stack: list[int], name: str, attributes: str) -> None:
        if self.tag[stack[-1]] == "p" or name in ("body", "html") and name in (self.tag[i] for i in stack):
            if name in ("body", "html"):
                return
            stack.pop()
        ends, scope = CLOSES.get(name, ((), ()))
        for i in range(len(stack) - 1, 0, -1):
            if self.tag[stack[i]] in scope:
                break
            if self.tag[stack[i]] in ends:
                del stack[i:]
                break
        found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        role = found.get("role", "")
        up = stack[-1]
        inside = self.marked[up]
        main = name == "main" or role == "main"
        own = 2 if name == "article" else 1 if main else 0
        plain = name in ("html", "body") or main
        hidden = "hidden" in found or found.get("aria-hidden") == "true"
        chrome = hidden or not plain and own == 0 and (
            name in CHROME_TAGS and not (name == "header" and inside) or role in CHROME_ROLES and role != "form"
        )
        named = not plain and (
            name == "form" or role == "form"
            or any(map(no_content, names)) and not (inside and name in ("h1", "h2", "h3", "p"))
        )
        node = len(self.tag)
        self.tag.append(name)
        self.label.append(f"{name}.{found.get('class', '')}" if found else name)
        self.parent.append(up)
        self.children.append([])
        self.children[up].append(node)
        self.depth.append(self.depth[up] + 1)
        self.chrome.append(self.chrome[up] or chrome)
        self.named.append(named)
        self.marked.append(max(inside, own))
        self.in_main.append(self.in_main[up] or main)
        if name != "hr":
            stack.append(node)

    def _settle(self) -> None:
        """Elements that are no content by name, but for those that would leave next to nothing of the page."""
        above = [-1] * len(self.tag)  # the nearest element by name around each node, or the node itself
        for node in range(1, len(self.tag)):
            above[node] = node if self.named[node] and not self.chrome[node] else above[self.parent[node]]
        inner: dict[int, list[int]] = {}
        whole, own, own_marked = {-1: 0}, {-1: 0}, {-1: 0}
        for node in range(1, len(self.tag)):
            if above[node] == node:
                inner.setdefault(above[self.parent[node]], []).append(node)
                whole[node] = own[node] = own_marked[node] = 0
        if not inner:
            return
        for node, text in self.texts:
            if not self.chrome[node]:
                own[above[node]] += len(text)
                own_marked[above[node]] += len(text) if self.marked[node] else 0
        for node in sorted(whole, reverse=True):
            whole[node] += own[node]
            if node > 0:
                whole[above[self.parent[node]]] += whole[node]
        left, marked, at, kept = own[-1], own_marked[-1], -1, {-1}
        while at in inner:
            at = max(inner[at], key=whole.__getitem__)
            if marked or whole[at] <= REST * left:
                break
            kept.add(at)
            left, marked = left + own[at], marked + own_marked[at]
        for node in range(1, len(self.tag)):
            self.chrome[node] = self.chrome[node] or above[node] not in kept

    def words(self) -> dict[int, str]:
        """The text of each node that has some of its own."""
        out: dict[int, list[str]] = {}
        for node, text in self.texts:
            out.setdefault(node, []).append(text)
        return {node: " ".join(parts) for node, parts in out.items()}

    def main_text(self, template: set[int]) -> str:
        """Text of the slots; ``template`` names nodes of this page that are template."""
        slots = [(n, t) for n, t in self.texts if not self.chrome[n] and n not in template]

        def length(part: list[tuple[int, str]]) -> int:
            return sum(len(t) for _, t in part)

        main = [(n, t) for n, t in slots if self.in_main[n]]
        article = [(n, t) for n, t in slots if self.marked[n] == 2]
        if main and 2 * length(main) >= length([(n, t) for n, t in slots if self.marked[n]]):
            slots = main
        elif article and 2 * length(article) >= length(slots):
            slots = article
        return " ".join(t for _, t in slots)


def align(a: Page, b: Page) -> list[tuple[int, int]]:
    """Pairs of nodes of the largest matching of two trees by simple tree matching."""
    size: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(x: int, y: int) -> tuple[int, list[tuple[int, int]]]:
        """(number of pairs, matched pairs of children) below equal labels x and y."""
        got = size.get((x, y))
        if got is not None:
            return got
        left, right = a.children[x], b.children[y]
        if not left or not right or a.depth[x] >= LEVELS:
            got = (1, [])
        elif all(
            a.label[i] == b.label[j] and not (a.children[i] and b.children[j]) for i, j in zip(left, right, strict=False)
        ) and (len(left) == len(right) or not any(a.children[i] for i in left) or not any(b.children[j] for j in right)):
            # Children without own children to match, in the same order: no other matching is larger.
            got = (1 + min(len(left), len(right)), list(zip(left, right, strict=False)))
        else:
            got = sequence(left, right)
        size[x, y] = got
        return got

    def sequence(left: list[int], right: list[int]) -> tuple[int, list[tuple[int, int]]]:
        rows = [[0] * (len(right) + 1)]
        for i in left:
            before, row = rows[-1], [0]
            for k, j in enumerate(right):
                best = max(before[k + 1], row[k])
                if a.label[i] == b.label[j]:
                    best = max(best, before[k] + match(i, j)[0])
                row.append(best)
            rows.append(row)
        pairs, m, k = [], len(left), len(right)
        while m and k:
            if rows[m][k] == rows[m - 1][k]:
                m -= 1
            elif rows[m][k] == rows[m][k - 1]:
                k -= 1
            else:
                m, k = m - 1, k - 1
                pairs.append((left[m], right[k]))
        return 1 + rows[-1][-1], pairs[::-1]

    out, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo += match(x, y)[1]
    return out


def vote_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: per host and node of the exemplar, pages that align with it and pages with its text."""
    for batch in batches:
        votes: dict[tuple[str, int], list[int]] = {}
        models: dict[str, tuple[Page, dict[int, str]]] = {}
        hosts, sources, models_of = (rp.field(batch, c).to_pylist() for c in ("host", "html", "model"))
        for host, source, model in zip(hosts, sources, models_of, strict=True):
            if host not in models:
                page = Page(model or "")
                models[host] = (page, page.words())
            if source == model:
                continue
            page = Page(source or "")
            (model_page, theirs), own = models[host], page.words()
            if [t for _, t in page.texts] == [t for _, t in model_page.texts]:
                continue
            pairs = [(x, theirs[x] == own.get(y)) for x, y in align(model_page, page) if x in theirs]
            story = {x: len(t) for x, t in theirs.items() if model_page.marked[x] and not model_page.chrome[x]}
            copy = 2 * sum(story.get(x, 0) for x, same in pairs if same) >= sum(story.values())
            for x, same in pairs:
                if not (copy and model_page.marked[x]):
                    vote = votes.setdefault((host, x), [0, 0])
                    vote[0] += 1
                    vote[1] += same
        keys = list(votes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                pa.array([votes[k][0] for k in keys], pa.int64()), pa.array([votes[k][1] for k in keys], pa.int64()),
                pa.array([models[host][0].marked[node] > 0 for host, node in keys], pa.bool_()),
            ],
            names=["host", "node", "pages", "same", "marked"],
        )


def extract_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: main text of every page; ``nodes`` are the template nodes of the exemplar."""
    for batch in batches:
        models: dict[str, Page] = {}
        texts = []
        columns = (rp.field(batch, c).to_pylist() for c in ("host", "html", "model", "nodes"))
        for host, source, model, nodes in zip(*columns, strict=True):
            page = Page(source or "")
            template: set[int] = set()
            if nodes:
                if host not in models:
                    models[host] = Page(model or "")
                wanted, theirs, own = set(nodes), models[host].words(), page.words()
                template = {y for x, y in align(models[host], page) if x in wanted and own.get(y) == theirs.get(x)}
            texts.append(page.main_text(template))
        dropped = ("host", "model", "nodes", "salt")
        names = [c for c in batch.schema.names if c not in dropped]
        yield pa.RecordBatch.from_arrays(
            [*(rp.field(batch, c) for c in names), pa.array(texts, pa.string())], names=[*names, "main"]
        )


def extract(pages: DataFrame, url: str = "url", source: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``pages`` (all by default) with text and n_chars, its code points.

    Blocks are joined in page order by one space, white space inside a block becomes one space, and
    character references are decoded. A null or empty page has an empty text; a page without a host
    shares one wrapper with the others of that kind. Columns named text or n_chars are replaced.
    """
    given = pages.drop("text", "n_chars")
    kept = [c for c in (carry or given.columns) if c in given.columns]
    clear = {c: f"c{i}_" for i, c in enumerate(kept)}
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#:]*)", 1))
    code = F.xxhash64(F.coalesce(F.col(source), F.lit("")))
    rows = given.select(
        host.alias("host"), code.alias("code"), F.col(source).alias("html"),
        *[F.col(c).alias(clear[c]) for c in kept if c != source],
    )
    # The exemplar of a host: its page with the smallest hash of the source, of those that have one.
    found = rows.where(F.length("html") > 0).groupBy("host").agg(
        F.min(F.struct(F.xxhash64("html"), "html")).alias("m"), F.sum(F.length("html")).alias("size")
    )
    salts = F.ceil(F.col("size") / SALT_CHARS).cast("int")
    hosts = cut_lineage(found.select("host", F.col("m.html").alias("model"), salts.alias("salts")), "hosts")
    every = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    exemplars = hosts.select("host", "model", every)
    # Few hosts need more than one salt: at most as many as the pages have blocks of SALT_CHARS.
    crowded = hosts.where("salts > 1").select("host", "salts")
    salt = F.pmod(F.col("code"), F.coalesce(F.col("salts"), F.lit(1))).cast("int").alias("salt")
    rows = rows.join(crowded, "host", "left").select("host", salt, *rows.drop("host", "code").columns)
    # Both uses of the joined pages read the same columns, so that they share one shuffle of the pages: without
    # the hint a small table of exemplars would be broadcast, and the pages shuffled with the exemplar on each.
    joined = rows.join(exemplars.hint("merge"), ["host", "salt"], "left")
    votes = joined.mapInArrow(vote_task, "host string, node int, pages bigint, same bigint, marked boolean")
    counted = votes.groupBy("host", "node", "marked").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    share = F.when(F.col("marked"), MARKED_SHARE).otherwise(TEMPLATE_SHARE)
    template = counted.where((F.col("pages") >= LEAST_VOTES) & (F.col("same") >= share * F.col("pages")))
    nodes = template.groupBy("host").agg(F.collect_list("node").alias("nodes"))
    nodes = nodes.join(hosts.select("host", "salts"), "host").select("host", "nodes", every)
    ready = joined.join(nodes, ["host", "salt"], "left")
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("host", "salt").schema.fields)
    out = ready.mapInArrow(extract_task, f"{base}, main string")
    names = {c: "html" if c == source else clear[c] for c in kept}
    return out.select(
        *[F.col(names[c]).alias(c) for c in kept], F.col("main").alias("text"), F.length("main").cast("bigint").alias("n_chars")
    )


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return found.select("page_id", "url", "text", "n_chars")
