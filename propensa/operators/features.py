"""Splits, folds, class weights and the fitted preprocessing of the feature columns."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propensa.functions.hashing import SEED, digest
from propensa.operators.clean import columns_by_type, medians
from propensa.operators.explore import value_counts_of
from propensa.operators.ordered import cutoff_table, hash_cutoffs
from propensa.session import cut_lineage


def _with_cutoffs(df: DataFrame, group: Column, order: Column, quotas: Sequence[Column]) -> DataFrame:
    """``df`` with the cutoffs of each row's group as ``_cuts``; a null group is a group too.

    The cutoffs are found once and stored, one row per group: whatever reads the result only compares
    digests with them. From the stored size Spark decides whether they are broadcast.
    """
    table = cutoff_table(df.select(group.alias("_by"), order.alias("_digest")), F.col("_digest"), quotas, F.col("_by"))
    cuts = cut_lineage(table.select(F.col("by").alias("_by"), F.col("cuts").alias("_cuts")), "cutoffs")
    return df.join(cuts, group.eqNullSafe(F.col("_by")), "left").drop("_by")


def split(
    df: DataFrame,
    key: str = "CustomerID",
    label: str = "ProdTaken",
    test: float = 0.2,
    stratify: bool = True,
    seed: int = SEED,
) -> DataFrame:
    """Add ``split`` = 'test' for exactly ⌈test·n⌉ rows (per class when stratified), else 'train'.

    The choice is a comparison with one digest per class: the train rows are the complement of
    the test rows without any set difference. Rows without a label are a class of their own.
    """
    order = digest(key, "split", seed)
    quota = F.ceil(F.lit(test) * F.col("n_all"))
    if stratify:
        out = _with_cutoffs(df, F.col(label), order, [quota])
        is_test = order <= F.col("_cuts")[0]
    else:
        out, is_test = df, order <= hash_cutoffs(df, order, [quota]).get("", [""])[0]
    return out.withColumn("split", F.when(is_test, "test").otherwise("train")).drop("_cuts")


def split_by_share(
    df: DataFrame, key: str = "CustomerID", test: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Add ``split`` by the key's hash alone: no job, works on streams, sizes are approximate."""
    limit = f"{min(int(test * 16**8), 16**8 - 1):08x}"
    head = F.substring(digest(key, "split", seed), 1, 8)
    return df.withColumn("split", F.when(head < limit, "test").otherwise("train"))


def folds(
    df: DataFrame, key: str = "CustomerID", label: str = "ProdTaken", k: int = 5, seed: int = SEED
) -> DataFrame:
    """Add ``fold`` 0…k-1; within each class the fold sizes differ by at most one.

    Rows without a label are dealt out like a class of their own.
    """
    order = digest(key, "fold", seed)
    quotas = [F.floor(F.col("n_all") * j / k) for j in range(1, k)]
    if not quotas:
        return df.withColumn("fold", F.lit(0))
    dealt = _with_cutoffs(df, F.col(label), order, quotas)
    return dealt.withColumn("fold", F.size(F.filter("_cuts", lambda cut: order > cut))).drop("_cuts")


def class_counts(df: DataFrame, label: str) -> dict:
    """Rows per class of a label; one row per class reaches the driver."""
    rows = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()
    return {r[label]: r["n"] for r in sorted(rows, key=lambda r: r[label])}


def class_weights(df: DataFrame, label: str, mode: str | float = "balanced") -> dict:
    """Weight per class: 'balanced' n/(classes·n_c), 'ratio' neg/pos for class 1, or a number."""
    counts = class_counts(df, label)
    if mode == "balanced":
        n = sum(counts.values())
        return {c: n / (len(counts) * m) for c, m in counts.items()}
    positive = counts[0] / counts[1] if mode == "ratio" else float(mode)
    return {c: positive if c == 1 else 1.0 for c in counts}


def with_class_weights(
    df: DataFrame, label: str, mode: str | float = "balanced", name: str = "weight"
) -> DataFrame:
    out = F
    for c, w in class_weights(df, label, mode).items():
        out = out.when(F.col(label) == c, F.lit(float(w)))
    return df.withColumn(name, out)


def _number(value: float) -> str:
    return f"CAST({float(value)!r} AS DOUBLE)"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _category_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, int]]:
    """Rows per category of each text column."""
    if not columns:
        return {}
    found = value_counts_of(df, columns).collect()
    out: dict[str, dict[str, int]] = {c: {} for c in columns}
    for r in found:
        out[r["column"]][r["value"]] = r["n"]
    return out


def _moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """(known, missing, mean, population deviation) of each numeric column, in one pass."""
    wanted = [
        x.alias(f"{name}{i}")
        for i, c in enumerate(columns)
        for name, x in (
            ("n", F.count(c)), ("m", F.avg(c)), ("s", F.stddev_pop(F.col(c).cast("double")))
        )
    ]
    row = df.agg(F.count("*").alias("n"), *wanted).first()
    return {
        c: (row[f"n{i}"], row["n"] - row[f"n{i}"], row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0)
        for i, c in enumerate(columns)
    }


@dataclass
class Preprocessor:
    """Imputation, scaling and one-hot encoding learned on train rows.

    It is a list of plain SQL expressions, so applying it is one projection inside code
    generation, and it saves as ordinary pipeline stages.
    """

    numeric: list[str]
    text: list[str]
    fills: dict
    means: dict[str, float]
    stds: dict[str, float]
    categories: dict[str, list[str]]
    unknown: str = "ignore"
    onehot_first: bool = False
    keep: list[str] = field(default_factory=list)

    @staticmethod
    def fit(
        train: DataFrame,
        exclude: Sequence[str],
        imputed: bool = True,
        unknown: str = "ignore",
        onehot_first: bool = False,
    ) -> Preprocessor:
        """Learn from ``train``. Medians, modes, moments and categories are bounded by the number
        of columns and categories, whatever the number of rows.
        """
        if unknown not in ("ignore", "error"):
            raise ValueError("unknown must be 'ignore' or 'error'")
        numeric, text = columns_by_type(train, exclude)
        # Three independent jobs over the same rows; Spark runs them side by side.
        with ThreadPoolExecutor(3) as jobs:
            middle = jobs.submit(medians, train, numeric if imputed else [])
            listed = jobs.submit(_category_counts, train, text)
            spread = jobs.submit(_moments, train, numeric)
        fills: dict = dict(middle.result())
        categories: dict[str, list[str]] = {}
        for c, counts in listed.result().items():
            categories[c] = sorted(counts)
            if imputed and counts:
                fills[c] = min(counts, key=lambda v: (-counts[v], v))
        means, stds = {}, {}
        for c, (n, missing, mean, std) in spread.result().items():
            fill = fills.get(c)
            if fill is not None and missing:
                # Mean and deviation after ``missing`` cells have been set to ``fill``.
                total = n + missing
                filled = (n * mean + missing * fill) / total
                square = n * (std**2 + (mean - filled) ** 2) + missing * (fill - filled) ** 2
                mean, std = filled, math.sqrt(square / total)
            means[c], stds[c] = mean, std or 1.0
        return Preprocessor(numeric, text, fills, means, stds, categories, unknown, onehot_first)

    def _scaled(self, c: str) -> str:
        value = f"CAST(`{c}` AS DOUBLE)"
        if c in self.fills:
            value = f"coalesce({value}, {_number(self.fills[c])})"
        return f"({value} - {_number(self.means[c])}) / {_number(self.stds[c])}"

    def _category(self, c: str) -> str:
        """The category of a row as text, filled where it is missing."""
        value = f"CAST(`{c}` AS STRING)"
        if c in self.fills:
            value = f"coalesce({value}, {_text(str(self.fills[c]))})"
        known = self.categories[c]
        if self.unknown == "error" and known:
            listed = ", ".join(_text(v) for v in known)
            problem = f"raise_error(concat('unknown category in {c}: ', `{c}`))"
            value = f"CASE WHEN `{c}` IS NULL OR `{c}` IN ({listed}) THEN {value} ELSE {problem} END"
        return value

    def _encoded(self, c: str) -> list[tuple[str, str]]:
        value = self._category(c)
        return [
            (f"{c}_{v}", f"CAST(coalesce({value} = {_text(v)}, false) AS DOUBLE)")
            for v in self.categories[c][1:]
        ]

    def expressions(self) -> list[tuple[str, str]]:
        """(feature name, SQL expression) in matrix order; the first category is dropped."""
        scaled = [(f"num_{c}", self._scaled(c)) for c in self.numeric]
        encoded = [e for c in self.text for e in self._encoded(c)]
        return encoded + scaled if self.onehot_first else scaled + encoded

    def feature_names(self) -> list[str]:
        numbers = [f"num_{c}" for c in self.numeric]
        encoded = [f"{c}_{v}" for c in self.text for v in self.categories[c][1:]]
        return encoded + numbers if self.onehot_first else numbers + encoded

    def apply(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Kept columns and one double column per feature."""
        return df.select(*keep, *[F.expr(x).alias(n) for n, x in self.expressions()])

    def stages(self, output: str = "features") -> list:
        """The same as saved-pipeline stages, ending in one vector column.

        Categories are looked up in an index and encoded as sparse vectors, so a column may have any
        number of them. The first category is left out of the index and so becomes, like an unknown
        one, the last place of the encoder, which is dropped.
        """
        wide = [c for c in self.text if len(self.categories[c]) > 1]
        scaled = [(f"num_{c}", self._scaled(c)) for c in self.numeric]
        picked = [(f"_cat_{c}", self._category(c)) for c in self.text]
        listed = ", ".join(f"{x} AS `{n}`" for n, x in scaled + picked)
        out: list = [SQLTransformer(statement=f"SELECT *, {listed} FROM __THIS__")] if listed else []
        numbers, encoded = [n for n, _ in scaled], [f"_hot_{c}" for c in wide]
        if wide:
            index = PipelineModel([
                StringIndexerModel.from_labels(self.categories[c][1:], f"_cat_{c}", f"_at_{c}", handleInvalid="keep")
                for c in wide
            ])
            empty = SparkSession.active().createDataFrame([], ", ".join(f"`_cat_{c}` string" for c in wide))
            # The sizes come from the index, no row is read.
            hot = OneHotEncoder(inputCols=[f"_at_{c}" for c in wide], outputCols=encoded, dropLast=True)
            out += [*index.stages, hot.fit(index.transform(empty))]
        inputs = encoded + numbers if self.onehot_first else numbers + encoded
        return [*out, VectorAssembler(inputCols=inputs, outputCol=output)]

    def matrix(self, df: DataFrame, keep: Sequence[str], output: str = "features") -> DataFrame:
        """Kept columns and the feature vector."""
        return PipelineModel(self.stages(output)).transform(df).select(*keep, output)


def fitted_fills(
    df: DataFrame, fills: dict, key: str, split_column: str = "split"
) -> DataFrame:
    """Fill values learned elsewhere applied to all rows of ``df``."""
    numeric, _ = columns_by_type(df)
    chosen = {
        c: F.coalesce(F.col(c).cast("double") if c in numeric else F.col(c), F.lit(v))
        for c, v in fills.items()
    }
    return df.select(key, split_column, *[x.alias(c) for c, x in chosen.items()])
