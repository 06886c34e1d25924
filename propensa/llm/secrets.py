"""Secret scans: candidate strings judged by a random forest, in DataFrame functions only.

Candidates are all values of a word that holds a long string with a digit, or an assignment to a
name like ``password``, or that follows such a name and ``=`` or ``:``. A word is cut before every such name and
every ``&name=``, so minified JSON and query strings give a candidate per value. Its features are length, shares and transitions of character classes, coverage by
dictionary words, signs of a path, address or number, and the words around it. The forest learns from labelled
findings: by default those whose form settles the matter (provider formats and assigned values
against mail and network addresses, numbers, paths and plain words); a caller may bring labels of
its own. Its score then decides all candidates, which removes false positives.

Labels by form leave out the findings that no form settles; on those the forest alone decides. Fitting looks at no more than ``FIT_ROWS`` labelled findings, chosen by a hash; every candidate of
every whole text is scored. The main path is one row at a time, without shuffle.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensa.llm.quality import let, words_of
from propensa.llm.shield import restored, shielded
from propensa.session import cut_lineage

#: Labelled findings that a forest is fitted on, at most, and the size of the dictionary of words around all candidates.
FIT_ROWS = 20_000
#: Labelled findings of either kind that a forest needs at least; with fewer the form of a finding decides.
LEAST_LABELS = 10
DICTIONARY_WORDS = 300
MARK = "[SECRET]"

# Names whose values are secrets, neighbours that speak for or against one, formats of providers.
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_\-]?key|key|auth|credential)s?"
AGAINST = r"^(?:commit|sha\d*|md5|digest|checksum|version|build|revision|uuid|isbn|phone|tel|fax|card|order|invoice)\W*$"
PROVIDERS = r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-.]+)$"
ASSIGNED = rf"(?i)(?<![a-z])([a-z_\-]*{NAMES}[a-z_\-]*)[\"']?[=:](?!//)"
#: A name at the end of a word, alone or with its sign, and the signs that may stand apart from it.
NAMED = rf"(?i)(?<![a-z])([a-z_\-]*{NAMES}[a-z_\-]*)[\"']?"
SIGNS = ["=", ":", ":=", "=>"]
PARAMETER = r"&(?=[A-Za-z0-9_.\-]+=)"
VALUE = r"[A-Za-z0-9+/_.@%!?~^&*$#:()\\\-]{4,}=*"
MAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+$"
NETWORK = r"^\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?$"
NUMBER = r"^[+(]?[\d().,/:\-]+$"
PATH = r"^(?:[a-z]+://|/|\.{1,2}/|[A-Za-z]:\\|www\.)"

FEATURES = [
    "length", "digits", "upper", "lower", "hex", "distinct", "class_steps", "case_steps", "spoken", "dictionary",
    "dots", "slashes", "at_sign", "provider", "assigned", "near_for", "near_against", "quoted",
]
#: Features that the labels by form are made of; a forest that learns from such labels does not see them.
SETTLING = ["provider", "assigned"]


def _count(v: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(v, f"[^{kind}]", ""))


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per candidate: key, row (hash of the text), word (its place), value, name, before, after."""
    t = F.coalesce(F.col(text), F.lit(""))

    def possible(x: Column) -> Column:
        long = (F.length(x) >= 8) & x.rlike("[0-9]") & x.rlike(r"[A-Za-z0-9+/_.@\-]{8,}")
        return long | x.rlike(ASSIGNED)

    def word(w: Column, i: Column) -> Column:
        return F.coalesce(F.get(w, i), F.lit(""))

    def name_before(w: Column, i: Column) -> Column:
        """The name that the word is assigned to by the words before it, or null."""
        one, two, own = word(w, i - 1), word(w, i - 2), word(w, i)
        apart = one.isin(SIGNS) & two.rlike(f"{NAMED}$")
        behind = (one.endswith("=") | one.endswith(":")) & one.rlike(f"{NAMED}(?::?=|:)$")
        ahead = own.rlike("^(?::?=|:)[^=:]") & one.rlike(f"{NAMED}$")
        return F.when(apart, F.regexp_extract(two, f"{NAMED}$", 1)).when(behind, F.regexp_extract(one, f"{NAMED}(?::?=|:)$", 1)).when(
            ahead, F.regexp_extract(one, f"{NAMED}$", 1)
        )

    def places(w: Column) -> Column:
        every = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        chosen = F.filter(every, lambda i: possible(F.get(w, i)) | name_before(w, i).isNotNull())
        return F.transform(
            chosen,
            lambda i: F.struct(
                i.alias("word"), F.get(w, i).alias("raw"), name_before(w, i).alias("named"),
                F.get(w, i - 1).alias("before"), F.get(w, i + 1).alias("after"),
            ),
        )

    def values(raw: Column, named: Column) -> Column:
        """All values of a word, each with the name in front of it; ``named`` is that of the first."""
        own = F.when(named.isNotNull(), F.regexp_replace(raw, "^(?::?=|:)", "")).otherwise(raw)
        cut = F.regexp_replace(F.translate(own, "\1\2", "  "), PARAMETER, "\1")
        parts = F.split(F.regexp_replace(cut, ASSIGNED, "\1$1\2"), "\1")

        def part(p: Column, k: Column) -> Column:
            own = F.when(p.contains("\2"), F.substring_index(p, "\2", 1)).when(k == 0, named)
            found = F.regexp_extract_all(F.substring_index(p, "\2", -1), F.lit(VALUE), 0)
            return F.transform(found, lambda v, j: F.struct(F.when(j == 0, own).alias("name"), v.alias("value")))

        return F.flatten(F.transform(parts, part))

    found = docs.select(F.col(key).alias("key_"), F.xxhash64(t).alias("row_"), F.explode(let(words_of(t), places)).alias("x"))
    raw = F.col("x.raw")
    return (
        found.select("key_", "row_", "x", F.explode(values(raw, F.col("x.named"))).alias("y"))
        .select(
            F.col("key_"), F.col("row_"), F.col("x.word").cast("bigint").alias("word"),
            F.regexp_replace("y.value", r"[.,;:!?)]+$", "").alias("value"), F.lower("y.name").alias("name"),
            F.coalesce("x.before", F.lit("")).alias("before"), F.coalesce("x.after", F.lit("")).alias("after"),
            raw.rlike("[\"']").alias("in_quotes"),
        )
        .where(F.length("value") >= 6)
    )


def dictionary(found: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent plain words around all candidates."""
    each = found.select(F.explode(F.array(F.lower("before"), F.lower("after"))).alias("w")).where(F.col("w").rlike("^[a-z]{4,}$"))
    top = each.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words)
    return [r["w"] for r in top.collect()]


def with_features(found: DataFrame, known: list[str]) -> DataFrame:
    v = F.col("value")
    n = F.length(v)
    plain = F.lower(v)
    # Longer words first, so that they are taken off whole.
    pattern = "|".join(sorted(known, key=lambda w: (-len(w), w)))
    covered = (n - F.length(F.regexp_replace(plain, pattern, ""))) / n if known else F.lit(0.0)
    around = F.array("before", "after")
    made = {
        "length": F.log(n),
        "digits": _count(v, "0-9") / n,
        "upper": _count(v, "A-Z") / n,
        "lower": _count(v, "a-z") / n,
        "hex": _count(plain, "0-9a-f") / n,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "class_steps": F.regexp_count(v, F.lit("(?<=[0-9])[^0-9]|(?<=[^0-9])[0-9]")) / n,
        "case_steps": F.regexp_count(v, F.lit("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]")) / n,
        "spoken": F.regexp_count(plain, F.lit("(?<=[aeiou])[b-df-hj-np-tv-z]|(?<=[b-df-hj-np-tv-z])[aeiou]")) / n,
        "dictionary": covered,
        "dots": _count(v, ".") / n,
        "slashes": _count(v, r"/\\") / n,
        "at_sign": v.contains("@"),
        "provider": v.rlike(PROVIDERS),
        "assigned": F.coalesce(F.length("name") > 0, F.lit(False)),
        "near_for": F.exists(around, lambda x: x.rlike(rf"(?i)^{NAMES}\W*$")),
        "near_against": F.exists(around, lambda x: F.lower(x).rlike(AGAINST)),
        "quoted": F.col("in_quotes"),
    }
    return found.withColumns({f"f_{k}": made[k].cast("double") for k in FEATURES})


def form_label() -> Column:
    """1 or 0 where the form of a finding settles it, else null."""
    v = F.col("value")
    assigned = F.coalesce(F.length("name") > 0, F.lit(False))
    mixed = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.length(v) >= 8)
    harmless = v.rlike(MAIL) | v.rlike(NETWORK) | v.rlike(NUMBER) | v.rlike(PATH) | ~v.rlike("[0-9]")
    return (
        F.when(v.rlike(PROVIDERS), 1).when(assigned & mixed & ~v.rlike(MAIL) & ~v.rlike(PATH), 1).when(~assigned & harmless, 0)
    )


def fit(measured: DataFrame, label: Column | None = None, rows: int = FIT_ROWS, least: int = LEAST_LABELS):
    """(forest, its features) from at most ``rows`` labelled findings, or None for fewer than ``least`` of either label.

    Without ``label`` the findings are labelled by their form, and the features that settle the form are left
    out: the forest has to tell from length, transitions, words and neighbours what it is given.
    """
    used = FEATURES if label is not None else [f for f in FEATURES if f not in SETTLING]
    known = measured.withColumn("label", (form_label() if label is None else label).cast("double")).where("label is not null")
    chosen = (
        known.select("label", *[f"f_{f}" for f in used]).orderBy(F.xxhash64("key_", "word", "value")).limit(rows)
        if {"key_", "word"} <= set(measured.columns) else known.limit(rows)
    )
    chosen = chosen.persist()
    try:
        counts = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
        if min(counts.get(0.0, 0), counts.get(1.0, 0)) < least:
            return None
        ready = VectorAssembler(inputCols=[f"f_{f}" for f in used], outputCol="features").transform(chosen)
        forest = RandomForestClassifier(labelCol="label", numTrees=30, maxDepth=8, seed=11, featureSubsetStrategy="sqrt")
        return forest.fit(ready), used
    finally:
        chosen.unpersist()


def judged(measured: DataFrame, fitted) -> DataFrame:
    """``measured`` with score and is_secret; where nothing could be fitted the form alone decides."""
    if fitted is None:
        scored = measured.withColumn("score", F.coalesce(form_label(), F.lit(0)).cast("double"))
    else:
        forest, used = fitted
        ready = VectorAssembler(inputCols=[f"f_{f}" for f in used], outputCol="features").transform(measured)
        scored = forest.transform(ready).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("is_secret", F.col("score") >= 0.5)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", label: Column | None = None) -> DataFrame:
    """One row per candidate of every text: key, row_, word, value, name, score, is_secret.

    A null or empty text has none. Repeated rows repeat their findings.
    """
    found = cut_lineage(candidates(docs, key, text), "candidates")
    measured = with_features(found, dictionary(found))
    out = judged(measured, fit(measured, label))
    return out.select(F.col("key_").alias(key), "row_", "word", "value", "name", "score", "is_secret")


def redacted(docs: DataFrame, findings: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every confirmed secret replaced by ``[SECRET]``, and n_secrets, the number of different ones.

    Rows are matched by id and a hash of the text; other columns stay as they are.
    """
    longest_first = F.array_sort(
        F.collect_set("value"),
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0),
    )
    confirmed = (
        findings.where("is_secret").groupBy(F.col(key).alias("found_key"), F.col("row_").alias("found_row"))
        .agg(longest_first.alias("secrets"))
    )
    given, names = shielded(docs, "n_secrets")
    own, body = F.col(names[key]), F.col(names[text])
    marked = given.withColumn("row", F.xxhash64(F.coalesce(body, F.lit("")))).join(
        confirmed, (F.col("row") == F.col("found_row")) & own.eqNullSafe(F.col("found_key")), "left"
    )
    clean = F.aggregate("secrets", body, lambda t, s: F.replace(t, s, F.lit(MARK)))
    marked = marked.withColumn(names[text], F.when(F.col("secrets").isNull(), body).otherwise(clean))
    found = F.when(F.col("secrets").isNull(), 0).otherwise(F.size("secrets")).cast("bigint")
    return restored(marked, names, found.alias("n_secrets"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The columns of the registered query: the secret itself only as a digest."""
    return found.select(
        key, "word", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.length("value").cast("bigint").alias("n_chars"),
        F.round("score", 6).alias("score"), "is_secret",
    )
