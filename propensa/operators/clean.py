"""Cleaning: dirty values, missing values, derived columns, alignment, snapshots, samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensa.functions.columns import RECODES, age_group, income_per_trip, recode, total_visiting
from propensa.functions.hashing import SEED, digest
from propensa.operators.ordered import hash_cutoffs, quantiles

# Columns filled with the median and with the most frequent value.
MEDIAN_COLUMNS = ["Age", "DurationOfPitch", "NumberOfTrips", "MonthlyIncome"]
MODE_COLUMNS = [
    "TypeofContact", "NumberOfFollowups", "PreferredPropertyStar", "NumberOfChildrenVisiting",
]
# Share of cells blanked per column.
MISSING_SHARES = {
    "Age": 0.03, "DurationOfPitch": 0.03, "NumberOfFollowups": 0.05, "PreferredPropertyStar": 0.04,
    "NumberOfTrips": 0.04, "NumberOfChildrenVisiting": 0.03, "MonthlyIncome": 0.04,
    "TypeofContact": 0.02,
}

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def columns_by_type(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and text columns in schema order; reads the schema only.

    A column of any other type is an error: name it in ``exclude`` or derive a number or text from it.
    """
    kinds = [(c, t) for c, t in df.dtypes if c not in exclude]
    numeric = [c for c, t in kinds if t in NUMERIC_TYPES or t.startswith("decimal")]
    text = [c for c, t in kinds if t in ("string", "boolean")]
    rest = [f"{c} ({t})" for c, t in kinds if c not in numeric and c not in text]
    if rest:
        raise ValueError(f"neither number nor text: {', '.join(rest)}")
    return numeric, text


def column_difference(columns: Sequence[str], remove: Sequence[str]) -> list[str]:
    """Names that are not in ``remove``, in order."""
    gone = set(remove)
    return [c for c in columns if c not in gone]


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns; names that are not there are ignored."""
    return df.drop(*names)


def recode_values(df: DataFrame, rules: Mapping[str, Mapping] = RECODES) -> DataFrame:
    """Replace dirty category spellings in the listed columns that exist."""
    return df.withColumns({c: recode(c, dict(m)) for c, m in rules.items() if c in df.columns})


def inject_missing(
    df: DataFrame, shares: Mapping[str, float] = MISSING_SHARES, key: str = "CustomerID",
    seed: int = SEED,
) -> DataFrame:
    """Blank exactly ⌊n·share⌋ cells per column, chosen by the hash order of the key."""
    picks = F.explode(F.array(*[F.lit(c) for c in shares])).alias("column")
    long = df.select(F.col(key).alias("key"), picks)
    quota = F.lit(0)
    for column, share in shares.items():
        quota = F.when(F.col("by") == column, F.floor(F.col("n_all") * share)).otherwise(quota)
    salt = F.concat(F.lit("blank-"), F.col("column"))
    cutoffs = hash_cutoffs(long, digest("key", salt, seed), [quota], F.col("column"))
    return df.withColumns(
        {
            c: F.when(digest(key, f"blank-{c}", seed) > cutoffs[c][0], F.col(c))
            for c in shares
            if c in cutoffs
        }
    )


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; one row per column reaches the driver."""
    if not columns:
        return {}
    return {r["column"]: r["q50"] for r in quantiles(df, columns, [0.5]).collect()}


WHOLE = ("tinyint", "smallint", "int", "bigint")


def mode_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, number, whole, text, n): the most frequent value of each column, smallest on ties.

    The value is in ``whole`` for integers of any size, in ``text`` for texts and booleans, else in ``number``.
    Values are counted before they are compared, so no task ever holds all values of a column.
    """
    types = dict(df.dtypes)

    def entry(c: str) -> Column:
        is_text, is_whole = types[c] in ("string", "boolean"), types[c] in WHOLE
        return F.struct(
            F.lit(c).alias("column"),
            (F.lit(None) if is_text or is_whole else F.col(c)).cast("double").alias("number"),
            (F.col(c) if is_whole else F.lit(None)).cast("bigint").alias("whole"),
            (F.col(c) if is_text else F.lit(None)).cast("string").alias("text"),
        )

    long = df.select(F.explode(F.array(*[entry(c) for c in columns])).alias("e")).select("e.*")
    counted = (
        long.where(F.coalesce(F.col("number").cast("string"), F.col("whole").cast("string"), "text").isNotNull())
        .groupBy("column", "number", "whole", "text")
        .agg(F.count("*").alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("less"), "number", "whole", "text")).alias("b")
    return counted.groupBy("column").agg(best).select(
        "column", "b.number", "b.whole", "b.text", (-F.col("b.less")).alias("n")
    )


def modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """The most frequent value by column; an integer column's is an int."""
    if not columns:
        return {}
    rows = mode_table(df, columns).collect()
    return {r["column"]: next(v for v in (r["text"], r["whole"], r["number"]) if v is not None) for r in rows}


def fit_impute(
    df: DataFrame, median: Sequence[str] = (), mode: Sequence[str] = ()
) -> dict[str, float | int | str]:
    """Fill value per column, learned from ``df``; columns without any value are left out."""
    # Two independent jobs over the same rows; Spark runs them side by side.
    with ThreadPoolExecutor(2) as jobs:
        middle, common = jobs.submit(medians, df, median), jobs.submit(modes, df, mode)
        return {**middle.result(), **common.result()}


def impute(
    df: DataFrame,
    median: Sequence[str] = MEDIAN_COLUMNS,
    mode: Sequence[str] = MODE_COLUMNS,
    fills: Mapping | None = None,
) -> DataFrame:
    """Fill nulls with medians and modes, learned from ``df`` unless ``fills`` is given.

    An integer column stays one when an integer, such as its mode, fills it; a median makes it double.
    """
    if fills is None:
        present = set(df.columns)
        fills = fit_impute(
            df, [c for c in median if c in present], [c for c in mode if c in present]
        )
    types = dict(df.dtypes)

    def kind(c: str, v) -> str:
        keeps = types[c] in ("string", "boolean") or (types[c] in WHOLE and isinstance(v, int))
        return types[c] if keeps else "double"

    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kind(c, v))) for c, v in fills.items() if c in types})


def clean(df: DataFrame, key: str = "CustomerID", keep_key: bool = False) -> DataFrame:
    """Recode, impute on all rows, replace adults and children by their total."""
    out = impute(recode_values(df)).withColumn("TotalVisiting", total_visiting())
    gone = ["NumberOfPersonVisiting", "NumberOfChildrenVisiting"]
    return drop_columns(out, gone if keep_key else [key, *gone])


def derive(df: DataFrame) -> DataFrame:
    """Recode and derive features without imputing; statistics are learned later, on train rows."""
    out = recode_values(df).withColumns(
        {
            "TotalVisiting": total_visiting("zero"),
            "IncomePerTrip": income_per_trip(),
            "AgeGroup": age_group(),
        }
    )
    return drop_columns(out, ["NumberOfPersonVisiting", "NumberOfChildrenVisiting"])


def variant(df: DataFrame) -> DataFrame:
    """The keyless 17-column table: whole numbers, visitors added up, income per trip, age band."""
    whole = ["Age", "MonthlyIncome", "NumberOfTrips", "DurationOfPitch", "NumberOfFollowups"]
    return df.withColumns(
        {
            "TotalVisiting": total_visiting().cast("int"),
            "IncomePerTrip": income_per_trip(truncate=True),
            "AgeGroup": age_group(),
        }
    ).withColumns({c: F.col(c).cast("int") for c in whole})


def align_columns(df: DataFrame, template: Sequence[str] | T.StructType) -> DataFrame:
    """Exactly the template's columns in its order; missing ones are filled with 0.

    With a schema as template every column also has its type there; for text the 0 is the text '0',
    a category that no row was trained on.
    """
    present = set(df.columns)
    if not isinstance(template, T.StructType):
        return df.select(*[F.col(c) if c in present else F.lit(0).alias(c) for c in template])
    return df.select(
        *[
            (F.col(f.name) if f.name in present else F.lit("0")).cast(f.dataType).alias(f.name)
            for f in template
        ]
    )


def drop_duplicates(
    df: DataFrame, columns: Sequence[str] | None = None, key: str | None = None
) -> DataFrame:
    """One row of every set of rows equal in ``columns`` (all columns by default; nulls are equal).

    With a key it is the row with the smallest key, a missing key counting as larger than all; rows
    that tie in the key, too, are told apart by their other columns, so the choice is repeatable.
    """
    columns = list(columns or df.columns)
    if key is None and set(columns) == set(df.columns):
        return df.dropDuplicates()
    others = [c for c in df.columns if c != key]
    order = [F.col(key).isNull().alias("_none"), F.col(key)] if key else []
    first = F.min(F.struct(*order, *[F.col(c) for c in others])).alias("_first")
    marked = df.withColumns({f"_same_{i}": _comparable(df, c) for i, c in enumerate(columns)})
    grouped = marked.groupBy(*[f"_same_{i}" for i in range(len(columns))]).agg(first)
    return grouped.select(*[F.col("_first")[c].alias(c) for c in df.columns])


def duplicate_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, and rows equal to an earlier row (nulls are equal to nulls)."""
    narrow = df.select(*[_comparable(df, c) for c in columns])
    return narrow.groupBy(*columns).agg(F.count("*").alias("_copies")).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("n_duplicates"),
    )


def _comparable(df: DataFrame, column: str) -> Column:
    """Text of any length as a 256-bit digest of the whole text; other values as they are."""
    if dict(df.dtypes)[column] == "string":
        return F.sha2(F.col(column), 256).alias(column)
    return F.col(column)


def compare_snapshots(
    raw: DataFrame, cleaned: DataFrame, key: str, columns: Sequence[str]
) -> DataFrame:
    """(key, column, raw_value, clean_value) for every cell that differs between two versions."""

    def text(side: str, c: str) -> Column:
        return F.col(f"{side}.{c}").cast("string")

    cells = [
        F.when(
            ~F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")),
            F.struct(
                F.lit(c).alias("column"),
                text("r", c).alias("raw_value"),
                text("c", c).alias("clean_value"),
            ),
        )
        for c in columns
    ]
    joined = raw.alias("r").join(cleaned.alias("c"), key)
    changed = F.filter(F.array(*cells), lambda e: e.isNotNull())
    return joined.select(key, F.explode(changed).alias("e")).select(key, "e.*")


def sample_rows(df: DataFrame, n: int, key: str = "CustomerID", seed: int = 1) -> DataFrame:
    """Exactly n rows without replacement; the same seed gives the same rows.

    The digest of the n-th row is found first; the choice is then a filter and gathers nothing.
    """
    order = digest(key, "sample", seed)
    cut = hash_cutoffs(df, order, [F.least(F.lit(n), F.col("n_all"))]).get("", [""])[0]
    return df.where(order <= cut)


def sample_share(df: DataFrame, share: float, key: str = "CustomerID", seed: int = 1) -> DataFrame:
    """About ``share`` of the rows, by a filter alone."""
    top = f"{min(int(share * 16**8), 16**8 - 1):08x}"
    head = F.substring(digest(key, "sample", seed), 1, 8)
    return df.where(F.lit(share >= 1) | (head < top))


def lookup_by_key(df: DataFrame, chosen: DataFrame, key: str = "CustomerID") -> DataFrame:
    """Rows of ``df`` whose key is among the chosen rows."""
    return df.join(chosen.select(key), key, "left_semi")
