"""Operators on single texts and the exact substring operators, against plain Python."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from propensa.llm import bpe, decontaminate, pages, quality, substring, suffixes
from propensa.llm import textarrays as ta

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n", "a", "a b\tc\n", "x" * 5000, "é 漢字 😀's", "it's 'quoted' \"re' don't\x1c"]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def order(rows):
    return sorted(rows, key=repr)


# ---- hashes and slices


def test_slices_and_hashes_agree_with_python():
    texts = ["ab  cd", "", None, "cd ab", " "]
    data, offsets = ta.flat(pa.array(texts))
    starts, ends, first = ta.slices(data, offsets, ta.ascii_space())
    words = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    assert words == [b"ab", b"cd", b"cd", b"ab"]
    assert first.tolist() == [0, 2, 2, 2, 4, 4]
    h = ta.slice_hashes(data, starts, ends)
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


def test_window_hashes_over_stretches():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5, 200_000).astype(np.uint64)
    h = ta.window_hashes(values, 7)
    seen = {}
    for i in range(0, len(h), 997):
        seen.setdefault(tuple(values[i : i + 7]), set()).add(int(h[i]))
    assert all(len(v) == 1 for v in seen.values())
    assert len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_sliding_min():
    values = np.array([5, 3, 9, 1, 7, 8, 2])
    for width in range(1, 8):
        assert ta.sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(8 - width)]


# ---- byte-level BPE


@pytest.fixture(scope="module")
def encoding():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    with open(bpe.default_ranks(), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, sf_dir, encoding):
    rng = random.Random(4)
    made = ["".join(rng.choice("ab' \n\tsdmtlrve1é! .　") for _ in range(rng.randint(0, 40))) for _ in range(400)]
    stored = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    texts = ODD + made + stored + ["ab" * 700]
    rows = bpe.encode(frame(spark, list(enumerate(texts))), bpe.default_ranks()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        plain = texts[r.doc_id] or ""
        expected = encoding.encode_ordinary(plain)
        assert r.ids == expected
        assert r.n_tokens == len(expected)
        assert r.ids_sha256 == hashlib.sha256(np.array(expected, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        sizes = [len(encoding.decode_single_token_bytes(i)) for i in expected]
        assert r.offsets == np.cumsum([0, *sizes])[:-1].tolist()[: len(expected)]


def test_bpe_decodes(spark):
    texts = ["", "it's 漢字", None]
    encoded = bpe.encode(frame(spark, list(enumerate(texts))).withColumnRenamed("text", "ids_sha256").toDF("ids", "text"), bpe.default_ranks())
    assert "ids" in encoded.columns
    back = bpe.decode(encoded, bpe.default_ranks()).collect()
    assert sorted(r.decoded for r in back) == ["", "", "it's 漢字"]


# ---- benchmark decontamination

NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def brute_hits(docs, items, window):
    windows = {}
    for name, text in items:
        words = NORMAL.findall(low(text))
        k = min(window, len(words))
        for i in range(len(words) - k + 1) if words else ():
            windows.setdefault(tuple(words[i : i + k]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for key, text in docs:
        words, hit, named = NORMAL.findall(low(text)), set(), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                found = windows.get(tuple(words[i : i + k]))
                if found:
                    hit.update(range(i, i + k))
                    named |= found
        out.append((key, len(words), len(hit), sorted(named)))
    return order(out)


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        window = rng.choice([2, 3, 4])
        letters = list("abcd")[: rng.choice([2, 3, 4])]
        items = [(str(i), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(0, 5))]
        docs = [(i, " ".join(rng.choice([*letters, "x", "A,"]) for _ in range(rng.randint(0, 25)))) for i in range(6)]
        batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
        rows = [r for out in decontaminate.finder(items, window, "text")([batch]) for r in out.to_pylist()]
        assert order([(r["doc_id"], r["n_words_"], r["n_hit_"], r["items_"]) for r in rows]) == brute_hits(docs, items, window)


def test_decontaminate_with_slices(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 9)))) for i in range(30)] + [(50, None), (3, "a b c d e")]
    docs = [(i, " ".join(rng.choice("abcdex") for _ in range(40))) for i in range(30)] + [(None, "a b c d"), (98, None), (99, "")]
    benchmark = frame(spark, items, "item_id bigint, text string")
    expected = brute_hits(docs, [(str(i), t) for i, t in items], 4)
    for limit in (10**6, 40):
        monkeypatch.setattr(decontaminate, "SLICE_WORDS", limit)
        found = decontaminate.decontaminate(frame(spark, docs), benchmark, window=4)
        rows = found.collect()
        assert order([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows]) == expected
        for r in rows:
            raw = (dict(docs)[r.doc_id] or "").encode()
            assert sum(s.n_words for s in r.spans) == r.n_hit
            assert all(len(NORMAL.findall(low(raw[s.start : s.end].decode()))) == s.n_words for s in r.spans)
        digests = {r.doc_id: r for r in decontaminate.digest(found).collect()}
        for key, _, n_hit, names in expected:
            assert digests[key].items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
            assert digests[key].n_items == len(names) and digests[key].contaminated == (n_hit > 0)


# ---- substring dedup, by words and by bytes


def brute_words(rows, width):
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    ids = [1 << 63 if i is None else i for i, _ in rows]
    least = {}
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            least[g] = min(least.get(g, 1 << 64), i)
    out = []
    for (key, _), i, w in zip(rows, ids, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((key, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return order(out)


def brute_bytes(rows, width):
    bodies = [(t or "").encode() for _, t in rows]
    ids = [1 << 63 if i is None else i for i, _ in rows]
    least = {}
    for i, b in zip(ids, bodies, strict=True):
        for k in range(len(b) - width + 1):
            least[b[k : k + width]] = min(least.get(b[k : k + width], 1 << 64), i)
    out = []
    for (key, _), i, b in zip(rows, ids, bodies, strict=True):
        gone, mine = bytearray(len(b)), set()
        for k in range(len(b) - width + 1):
            g = b[k : k + width]
            if least[g] < i or g in mine:
                gone[k : k + width] = b"\1" * width
            mine.add(g)
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((key, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return order(out)


def random_texts(rng, voc, joiner, sizes):
    rows = [(rng.choice([None, j, j, j, j, 3]), joiner.join(rng.choice(voc) for _ in range(rng.choice(sizes)))) for j in range(40)]
    rows += [(100, None), (101, ""), (102, " \n")]
    return rows + [(200 + j, f"xx{joiner}{rows[j][1]}{joiner}y") for j in range(5)] + [rows[2]]


@pytest.fixture
def many_buckets(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = random_texts(rng, ["a", "b", "c", "dd", "e,", "é"][: 2 + 2 * seed], " ", [0, 3, 6, 10, 40, 200])
    width, gram = rng.choice([(6, 2), (5, 3), (8, 3)])
    got = substring.substring_dedup(frame(spark, rows), width=width, gram=gram).collect()
    assert order([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got]) == brute_words(rows, width)
    for r in got:
        assert sum(s.n_words for s in r.spans) == r.n_removed


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup_equals_brute_force(spark, many_buckets, seed):
    rng = random.Random(seed)
    rows = random_texts(rng, ["a", "b", "c", "dd", "e,", "é"][: 2 * seed - 1], "", [0, 3, 20, 40, 200])
    width, gram = rng.choice([(20, 8), (16, 8), (24, 16)])
    got = suffixes.suffix_dedup(frame(spark, rows), width=width, gram=gram).collect()
    found = order([(r.doc_id, r.n_bytes, r.n_removed, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got])
    assert found == brute_bytes(rows, width)


def test_unequal_runs_are_not_copies(spark, monkeypatch):
    """Runs under one anchor that agree in the top 31 bits of their first hash, or in the hash but not in length."""
    whole = ta.slice_hashes

    def crowded(data, starts, ends, *base):
        out = whole(data, starts, ends, *base)
        return out if base else out & np.uint64((1 << 33) - 1)

    monkeypatch.setattr(ta, "slice_hashes", crowded)
    rng = random.Random(5)
    body = pa.array(["abcdefgh" * 2 + "".join(rng.choice("xyz") for _ in range(30)) for _ in range(40)])
    numbers = pa.array(range(40), pa.int64())
    batch = pa.RecordBatch.from_arrays([numbers, numbers, numbers, body], names=["row", "t", "ord", "text"])
    rows = pa.Table.from_batches(suffixes.runs_task(20, 8)([batch])).to_pylist()
    for r in rows:
        r["anchor"] = 7
    batch = pa.RecordBatch.from_pylist(rows)
    got = pa.Table.from_batches(suffixes.first_round([batch])).to_pylist()
    copied = {(r["row"], r["start"], r["n"]) for r in got if r["kind"] == suffixes.COPIED}
    texts, seen, expected = body.to_pylist(), set(), set()
    for r in sorted(rows, key=lambda r: (r["row"], r["start"])):
        held = texts[r["row"]][r["start"] : r["start"] + r["n"] + 19]
        if held in seen:
            expected.add((r["row"], r["start"], r["n"]))
        seen.add(held)
    assert copied == expected
    same = [dict(rows[0], row=i, t=i, ord=i, n=3 + i) for i in range(2)]
    got = pa.Table.from_batches(suffixes.first_round([pa.RecordBatch.from_pylist(same)])).to_pylist()
    assert not [r for r in got if r["kind"] == suffixes.COPIED]


def test_queries_over_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = frame(spark, rows)
    got = substring.digest(substring.substring_dedup(docs)).collect()
    expected = [(k, n, m, hashlib.sha256(kept.encode()).hexdigest()) for k, n, m, kept in brute_words(rows, 50)]
    assert order([tuple(r) for r in got]) == order(expected)
    got = suffixes.digest(suffixes.suffix_dedup(docs)).collect()
    expected = [(k, n, m, len(s), hashlib.sha256(b).hexdigest()) for k, n, m, s, b in brute_bytes(rows, 100)]
    assert order([tuple(r) for r in got]) == order(expected)


# ---- quality rules


def brute_measures(text):
    words = [w.decode() for w in WORD.findall((text or "").encode())]
    lines = [x for x in (text or "").split("\n") if WORD.search(x.encode())]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for places in seen.values() if len(places) > 1 for i in places for k in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
    )


def test_measures_equal_brute_force(spark):
    rng = random.Random(6)
    made = ["".join(rng.choice(["a ", "b ", "c\n", "é# ", "\t", "dd|"]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts = ODD + made
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    docs = frame(spark, [(i, t, 7, "w") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words int, words_ string")
    rows = quality.measured_cascade(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[n] for n in names) == brute_measures(texts[r.doc_id])
        assert r.words_ == "w"
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_cascade_verdict_does_not_depend_on_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rules = quality.base_rules() + quality.default_rules()
    planned = quality.plan(docs, rules)
    assert {r.name for r in planned} == {r.name for r in rules}
    both = docs.select(
        quality.cascade(docs.text, rules).isNull().alias("a"), quality.cascade(docs.text, rules[::-1]).isNull().alias("b")
    )
    rows = both.collect()
    assert all(r.a == r.b for r in rows) and len({r.a for r in rows}) == 2


# ---- pages


def test_main_text_of_a_page():
    source = (
        "<html><head><title>T</title><body><header>H</header><div class='cookie-notice'>c</div><main><p>A &amp; b<br>c"
        "<p>d&nbsp; e<ul><li>1<li>2</ul><form>f</form><script>if (a<b) {'</p>'}</script><section id=comments>k</section></main><footer>z"
    )
    assert pages.Page(source).main_text(set()) == "A & b c d e 1 2"


def test_article_is_not_the_whole_story():
    story = "The long story of the day, told in many words. " * 5

    def text(body):
        return pages.Page(f"<body>{body}</body>").main_text(set())

    whole = " ".join(story.split())
    assert text(f"<nav>Menu</nav><main><h1>Title</h1><p>Lead</p><article><p>{story}</article></main>") == f"Title Lead {whole}"
    assert text(f"<div><p>{story}</p></div><article>Teaser</article>") == f"{whole} Teaser"
    assert text(f"<main><p>{story}</p><article>Teaser</article></main>") == f"{whole} Teaser"
    assert text(f"<div>By the way</div><article>{story}</article>") == whole
    assert text(f"<main>Short</main><article>{story}</article>") == whole


def tree_match(a, b, x=0, y=0):
    if a.label[x] != b.label[y]:
        return 0
    left, right = a.children[x], b.children[y]
    table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(1, len(left) + 1):
        for j in range(1, len(right) + 1):
            pair = table[i - 1][j - 1] + tree_match(a, b, left[i - 1], right[j - 1])
            table[i][j] = max(table[i - 1][j], table[i][j - 1], pair)
    return 1 + table[-1][-1]


def test_alignment_is_largest():
    rng = random.Random(1)

    def page(depth=0):
        tags = [rng.choice(["div", "section", "ul"]) for _ in range(rng.randint(0, 3))]
        return "".join(f"<{t}>x{page(depth + 1) if depth < 3 and rng.random() < 0.6 else ''}</{t}>" for t in tags)

    for _ in range(200):
        a, b = pages.Page(page()), pages.Page(page())
        pairs = pages.align(a, b)
        assert len(pairs) == tree_match(a, b) == len({x for x, _ in pairs}) == len({y for _, y in pairs})


def test_template_of_a_host_is_dropped(spark):
    made = [
        (i, "http://h.example/x", f"<body><div>Site name</div><div>Story {i} of the day</div><div>All rights</div></body>", "e")
        for i in range(6)
    ]
    odd = [(10, None, "<p>alone</p>", "e"), (11, "http://h.example/y", None, None), (12, "x", "", "e"), (0, *made[0][1:])]
    rows = pages.extract(frame(spark, made + odd, "page_id bigint, url string, html string, host string")).collect()
    text = {r.page_id: r.text for r in rows}
    assert len(rows) == 10
    assert all(text[i] == f"Story {i} of the day" for i in range(6))
    assert (text[10], text[11], text[12]) == ("alone", "", "")
    assert all(r.n_chars == len(r.text) and r.host in ("e", None) for r in rows)


def test_names_count_as_a_whole():
    def text(body):
        return pages.Page(f"<body>{body}</body>").main_text(set())

    assert text('<div class="main-content no-sidebar"><p>Whole story</div>') == "Whole story"
    assert text('<div id="page" class="site has-banner"><article><p>Whole story</article></div>') == "Whole story"
    assert text('<article><p>a</p><section class="social-history">b</section><div class="legal-history">c</div></article>') == "a b c"
    assert text('<article><p>a</p><div class="site-footer">b</div><div id="ad_2">c</div><div class="x sidebar">d</div></article>') == "a"
    assert text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>") == "so x=2 holds"


def test_an_element_that_holds_the_page_is_content():
    def text(body):
        return pages.Page(f"<body>{body}</body>").main_text(set())

    assert text("<form><div>Whole story of the day</div><nav>Menu</nav></form>") == "Whole story of the day"
    assert text('<div class="banner"><div class="sidebar"><p>Whole story</p></div></div>') == "Whole story"
    assert text('<div class="banner"><p>Whole story</p><div class="sidebar">Side</div></div>') == "Whole story"
    assert text(f'<article>Short</article><div class="comments">{"Long remark. " * 50}</div>') == "Short"
    assert text(f'<div>Short story</div><div class="comments">{"Remark. " * 10}</div>') == "Short story"
    assert text(f'<article>Story</article><article class="comment">{"Remark. " * 10}</article>') == "Story"
    assert text('<div class="ad">' * 3000 + "deep" + "</div>" * 3000) == "deep"


def hosts_of_boilerplate():
    """Two hosts: one without a marked part, one whose articles have a constant line, copies and a shared line."""
    made = [
        (i, "http://a.example/x", f"<div class='top'>Site name</div><div>Story {i} of the day</div><div class='end'>All rights</div>")
        for i in range(8)
    ]
    made += [
        (100 + i, "http://b.example/x", f"<article><p>Follow us</p><p>Story number {i} is told in many words here.</p>"
         + ("<p>Shared by some</p>" if i % 2 else f"<p>Not shared, page {i}</p>") + "</article>")
        for i in range(8)
    ]
    same = "One story that has many copies on its host, word for word"
    made += [(200 + i, "http://c.example/x", f"<article><p>{same}</p></article><div>seen {i}</div>") for i in range(8)]
    return made


def test_wrapper_decides_inside_an_article(spark, monkeypatch):
    table = frame(spark, hosts_of_boilerplate(), "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in pages.extract(table).collect()}
    for i in range(8):
        assert got[i] == f"Story {i} of the day"
        assert got[100 + i].startswith(f"Story number {i} is told in many words here. ")
        assert got[100 + i].endswith("Shared by some") or "Not shared" in got[100 + i]
        assert got[200 + i] == "One story that has many copies on its host, word for word"
    monkeypatch.setattr(pages, "LEAST_VOTES", 1 << 40)
    off = {r.page_id: r.text for r in pages.extract(table).collect()}
    assert off[0] == "Site name Story 0 of the day All rights" and off[100].startswith("Follow us Story")


def test_salts_do_not_change_texts(spark, monkeypatch):
    table = frame(spark, hosts_of_boilerplate(), "page_id bigint, url string, html string")
    got = sorted(tuple(r) for r in pages.extract(table).collect())
    monkeypatch.setattr(pages, "SALT_CHARS", 100)
    assert got == sorted(tuple(r) for r in pages.extract(table).collect())


def test_article_is_kept_whole(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r.text for r in pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    import html

    for r in rows:
        inner = r.html.split("<article>")[1].split("</article>")[0]
        plain = re.sub(r"</?b>", "", re.sub(r"<br>|</?(?:p|h1)>", " ", inner))
        assert got[r.page_id] == " ".join(html.unescape(plain).split())


# ---- tables without rows


def test_empty_tables(spark):
    docs = frame(spark, [])
    benchmark = frame(spark, [], "item_id bigint, text string")
    assert bpe.encode(docs, bpe.default_ranks()).count() == 0
    assert decontaminate.decontaminate(docs, benchmark).count() == 0
    assert decontaminate.decontaminate(frame(spark, [(1, "a b")]), benchmark).first().n_hit == 0
    assert substring.substring_dedup(docs).count() == 0
    assert suffixes.suffix_dedup(docs).count() == 0
    assert quality.measured_cascade(docs).count() == 0
    assert pages.extract(frame(spark, [], "page_id bigint, url string, html string")).count() == 0


def test_extra_columns_stay(spark):
    schema = "doc_id bigint, text string, row int, t string, spans int, kept string, n_words_ int, x0x int"
    docs = frame(spark, [(1, "a b c", 5, "u", 6, "v", 7, 8)], schema)
    benchmark = frame(spark, [(1, "a b")], "item_id bigint, text string")
    for out in (
        substring.substring_dedup(docs), suffixes.suffix_dedup(docs), decontaminate.decontaminate(docs, benchmark),
        bpe.encode(docs, bpe.default_ranks()),
    ):
        r = out.first()
        assert (r.doc_id, r.text, r.row, r.t, r.n_words_, r.x0x) == (1, "a b c", 5, "u", 7, 8)


def test_copies_are_not_sorted_symbol_by_symbol(monkeypatch):
    """Windows that agree in a symbol were sorted by it all the same, copies by every one of their thirteen symbols."""
    rng = np.random.default_rng(5)
    one, other = rng.integers(0, 256, (2, 100), dtype=np.uint8)
    late = one.copy()
    late[-1] ^= 1
    windows = [one, other, one, late, other, one]
    body = np.concatenate([*windows, np.zeros(8, np.uint8)])
    sorts = []
    real = np.lexsort
    monkeypatch.setattr(suffixes.np, "lexsort", lambda keys: (sorts.append(len(keys[0])), real(keys))[1])
    order, number = suffixes.multikey(body, np.arange(6) * 100, np.zeros(6, dtype=np.int64), 100)
    want = sorted(range(6), key=lambda i: windows[i].tobytes())
    assert order.tolist() == want
    texts = [windows[i].tobytes() for i in want]
    assert number.tolist() == [sorted(set(texts)).index(t) for t in texts]
    assert sorts == [6, 4]
