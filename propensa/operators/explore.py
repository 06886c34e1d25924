"""Exploratory aggregates: shape, nulls, frequencies, rates, distributions, trends."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensa.functions.sums import merge_task, pearson_task, products_task
from propensa.operators.ordered import quantiles, value_frequencies
from propensa.session import cut_lineage

# Above this many distinct values a numeric column counts as continuous.
DISCRETE_LIMIT = 25
# Tasks that merge the sums of all others before the last one does.
MERGERS = 16


def _rows(df: DataFrame, names: Sequence[str], entries) -> DataFrame:
    """Turn one aggregated row into one row per entry (list of same-typed column tuples)."""
    structs = [F.struct(*[v.alias(n) for n, v in zip(names, entry)]) for entry in entries]
    return df.select(F.explode(F.array(*structs)).alias("e")).select("e.*")


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns)).cast("long")
    )


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n_null, n_rows): every column in one pass."""
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    one = df.select(F.struct(*df.columns).alias("r")).select("r.*").agg(
        F.count("*").alias("_rows"), *nulls
    )
    entries = [(F.lit(c), F.col(c), F.col("_rows")) for c in df.columns]
    return _rows(one, ["column", "n_null", "n_rows"], entries)


def null_percent(df: DataFrame) -> DataFrame:
    """Columns with missing values and their share in percent, largest first."""
    share = F.round(F.col("n_null") * 100.0 / F.col("n_rows"), 2)
    return (
        null_counts(df)
        .where(F.col("n_null") > 0)
        .select("column", share.alias("null_pct"))
        .orderBy(F.desc("null_pct"), "column")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of every non-null value, most frequent first."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), column)
    )


def value_counts_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for several columns from one pass."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count("*").alias("n")
    )


def schema_info(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null)."""
    types = F.create_map(*[x for c, t in df.dtypes for x in (F.lit(c), F.lit(t))])
    return null_counts(df).select(
        "column",
        types[F.col("column")].alias("dtype"),
        (F.col("n_rows") - F.col("n_null")).alias("non_null"),
    )


def imbalance_ratio(df: DataFrame, label: str) -> DataFrame:
    """Negatives per positive."""
    zero, one = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(
        zero.alias("n_negative"), one.alias("n_positive"), F.try_divide(zero, one).alias("ratio")
    )


def discrete_or_continuous(
    df: DataFrame, columns: Sequence[str], limit: int = DISCRETE_LIMIT, exact: bool = True
) -> DataFrame:
    """Kind of each numeric column by its distinct values, a missing value being one of them.

    A sketch of all columns tells which have far more values than ``limit``. The others' values, at most
    about twice the limit, are collected as sets in one aggregate. With ``exact`` the many
    values of the rest are counted too, else their number is the sketch's.
    """
    sketch = df.agg(
        *[F.approx_count_distinct(c, 0.02).alias(f"s{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c).isNull().cast("int")).alias(f"m{i}") for i, c in enumerate(columns)],
    ).first()
    missing = {c: sketch[f"m{i}"] or 0 for i, c in enumerate(columns)}
    few = [c for i, c in enumerate(columns) if sketch[f"s{i}"] <= 2 * limit]
    many = {c: sketch[f"s{i}"] for i, c in enumerate(columns) if c not in few}
    parts = []
    if few:
        sets = df.agg(*[F.size(F.collect_set(c)).cast("bigint").alias(f"d{i}") for i, c in enumerate(few)])
        parts.append(_rows(sets, ["column", "n_distinct"], [
            (F.lit(c), F.col(f"d{i}") + F.lit(missing[c])) for i, c in enumerate(few)
        ]))
    if many and exact:
        # Values merge in every task before they are shuffled.
        known = value_frequencies(df, list(many)).groupBy("column").agg(F.count("*").alias("n_distinct"))
        gap = F.create_map(*[x for c in many for x in (F.lit(c), F.lit(missing[c]))])
        parts.append(known.select("column", (F.col("n_distinct") + gap[F.col("column")]).alias("n_distinct")))
    elif many:
        rows = [(c, n + missing[c]) for c, n in many.items()]
        parts.append(df.sparkSession.createDataFrame(rows, "column string, n_distinct bigint"))
    rows = functools.reduce(DataFrame.unionByName, parts)
    kind = F.when(F.col("n_distinct") <= limit, "discrete").otherwise("continuous")
    return rows.withColumn("kind", kind)


def filter_counts(df: DataFrame, predicates: dict) -> DataFrame:
    """(predicate, n): how many rows satisfy each named condition, in one pass."""
    names = list(predicates)
    one = df.agg(*[F.count_if(predicates[n]).alias(n) for n in names])
    return _rows(one, ["predicate", "n"], [(F.lit(n), F.col(f"`{n}`")) for n in names])


def rate_by(
    df: DataFrame, segment: str, label: str, domain: Sequence | None = None
) -> DataFrame:
    """Rows, positives and mean label per segment; with a domain also the empty segments."""
    grouped = (
        df.where(F.col(segment).isNotNull())
        .groupBy(segment)
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col(label).cast("long")).alias("n_positive"),
            F.avg(label).alias("rate"),
        )
    )
    if domain is None:
        return grouped
    dtype = dict(df.dtypes)[segment]
    listed = df.sparkSession.createDataFrame([(v,) for v in domain], f"`{segment}` {dtype}")
    return listed.join(grouped, segment, "left").fillna(0, ["n", "n_positive"])


def rates_by(df: DataFrame, segments: Sequence[str], label: str) -> DataFrame:
    """(segment, value, n, rate_pct) for several segment columns from one pass."""
    entries = [
        F.struct(F.lit(c).alias("segment"), F.col(c).cast("string").alias("value"))
        for c in segments
    ]
    long = df.select(label, F.explode(F.array(*entries)).alias("e")).select(label, "e.*")
    return (
        long.where(F.col("value").isNotNull())
        .groupBy("segment", "value")
        .agg(
            F.count("*").alias("n"),
            F.avg(label).alias("rate"),
            F.round(F.avg(label) * 100, 1).alias("rate_pct"),
        )
    )


def count_by(df: DataFrame, segment: str, label: str) -> DataFrame:
    return (
        df.where(F.col(segment).isNotNull())
        .groupBy(segment, label)
        .agg(F.count("*").alias("n"))
    )


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, max) for all columns in one pass."""
    aggregates = []
    for c in columns:
        value = F.col(c).cast("double")
        aggregates += [
            F.struct(
                F.lit(c).alias("column"),
                F.count(value).alias("count"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("std"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
            ).alias(c)
        ]
    one = df.agg(*aggregates)
    return one.select(F.explode(F.array(*[F.col(f"`{c}`") for c in columns])).alias("e")).select(
        "e.*"
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, q25, q50, q75, max) with exact quartiles."""
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75]).drop("n")
    return moments(df, columns).join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x, y, r): Pearson correlation of every ordered pair, over rows where both are known.

    Every task adds up one masked cross product of its rows, four matrices with one element per pair;
    those are merged element by element, so no row is made per pair until the result. Values are taken
    relative to their column's mean. Pairs with fewer than two rows have no correlation (null).
    """
    numbers = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    means = numbers.agg(*[F.avg(c).alias(c) for c in numbers.columns]).first()
    shift = [m if m is not None and math.isfinite(m) else 0.0 for m in means]
    schema = "n array<double>, x array<double>, xx array<double>, xy array<double>"
    sums = numbers.mapInArrow(products_task(shift), schema)
    merged = sums.repartition(MERGERS).mapInArrow(merge_task, schema).repartition(1).mapInArrow(merge_task, schema)
    return merged.mapInArrow(pearson_task(list(columns)), "x string, y string, r double")


def histogram(df: DataFrame, column: str, label: str, bins: int = 30) -> DataFrame:
    """(bin, low, high, label, n): equal-width bins, the maximum falling into the last one."""
    known = df.where(F.col(column).isNotNull()).select(
        F.col(column).cast("double").alias("value"), label
    )
    span = known.agg(F.struct(F.min("value").alias("low"), F.max("value").alias("high")).alias("s"))
    limits = span.scalar()
    binned = known.withColumns({"_low": limits["low"], "_high": limits["high"]})
    width = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    position = F.floor((F.col("value") - F.col("_low")) / F.nullif(width, F.lit(0.0)))
    bin_id = F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int")
    # Limits are the same in every row, so max() only carries them through the aggregate.
    counted = (
        binned.withColumn("bin", bin_id)
        .groupBy("bin", label)
        .agg(F.count("*").alias("n"), F.max("_low").alias("_low"), F.max("_high").alias("_high"))
    )
    step = (F.col("_high") - F.col("_low")) / F.lit(float(bins))
    return counted.select(
        "bin",
        (F.col("_low") + F.col("bin") * step).alias("low"),
        (F.col("_low") + (F.col("bin") + 1) * step).alias("high"),
        label,
        "n",
    )


def box_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (furthest value within 1.5 IQR) and outlier count per (by…, column).

    The quartiles of a group are one row; the rows meet them where they are, in one aggregate.
    """
    by = list(by)
    quartiles = quantiles(df, columns, [0.25, 0.5, 0.75], by)
    stats = F.struct("n", "q25", "q50", "q75")
    groups = quartiles.groupBy(*by).agg(
        *[F.max(F.when(F.col("column") == c, stats)).alias(f"s{i}") for i, c in enumerate(columns)]
    )
    groups = cut_lineage(groups, "quartiles")
    known = df.select(*by, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    if by:
        rows = known.join(groups, by)
    else:
        rows = known.withColumn("_one", F.lit(1)).join(F.broadcast(groups.withColumn("_one", F.lit(1))), "_one")
    out = []
    for i, c in enumerate(columns):
        v, s = F.col(f"v{i}"), F.col(f"s{i}")
        reach = (s["q75"] - s["q25"]) * 1.5
        inside = v.between(s["q25"] - reach, s["q75"] + reach)
        out.append(F.struct(
            F.lit(c).alias("column"),
            F.max(s["n"]).alias("n"),
            F.max(s["q25"]).alias("q1"),
            F.max(s["q50"]).alias("median"),
            F.max(s["q75"]).alias("q3"),
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(v.isNotNull() & ~inside).alias("n_outliers"),
        ))
    found = rows.groupBy(*by).agg(F.array(*out).alias("e")).select(*by, F.explode("e").alias("e"))
    return found.select(*by, "e.*").where(F.col("n").isNotNull())


# Points of a density curve that are added up in one aggregate.
POINTS_AT_ONCE = 64


def density(df: DataFrame, column: str, by: Sequence[str], grid: int = 32) -> DataFrame:
    """(by…, point, x, density): Gaussian kernel estimate on a grid per group.

    Bandwidth 1.059·min(std, IQR/1.349)·n^(-1/5); the grid spans two bandwidths beyond the data.
    Equal values are merged first; each of them then adds its height to every grid point inside one
    aggregate, so no row is made per value and point.
    """
    by = list(by)
    known = df.dropna(subset=[*by, column]).select(*by, F.col(column).cast("double").alias(column))
    spread = known.groupBy(*by).agg(
        F.stddev_samp(column).alias("_std"),
        F.min(column).alias("_min"),
        F.max(column).alias("_max"),
    )
    quartiles = quantiles(known, [column], [0.25, 0.75], by)
    scale = F.least(F.col("_std"), (F.col("q75") - F.col("q25")) / 1.349)
    bandwidth = F.lit(1.059) * scale * F.pow(F.col("_all"), F.lit(-0.2))
    shape = (
        quartiles.withColumnRenamed("n", "_all")
        .join(spread, by)
        .withColumn("_h", bandwidth)
        .where(F.col("_h") > 0)
        .withColumn("_start", F.col("_min") - 2 * F.col("_h"))
        .withColumn("_step", (F.col("_max") - F.col("_min") + 4 * F.col("_h")) / float(grid - 1))
        .select(*by, "_all", "_h", "_start", "_step")
    )
    shape = cut_lineage(shape, "curves")
    frequencies = value_frequencies(known, [column], by).join(shape, by)

    def height(point: int) -> Column:
        z = (F.col("_start") + F.col("_step") * point - F.col("value")) / F.col("_h")
        return F.sum(F.col("n") * F.exp(-0.5 * z * z))

    parts = []
    for start in range(0, grid, POINTS_AT_ONCE):
        points = range(start, min(start + POINTS_AT_ONCE, grid))
        curve = F.array(*[F.struct(F.lit(p).alias("point"), height(p).alias("height")) for p in points])
        parts.append(frequencies.groupBy(*by).agg(curve.alias("e")).select(*by, F.explode("e").alias("e")))
    heights = functools.reduce(DataFrame.unionByName, parts).select(*by, "e.*")
    return heights.join(shape, by).select(
        *by, "point", (F.col("_start") + F.col("_step") * F.col("point")).alias("x"),
        (F.col("height") / (F.col("_all") * F.col("_h")) / math.sqrt(2 * math.pi)).alias("density"),
    )


def ols(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of y on x per group."""
    yc, xc = F.col(y).cast("double"), F.col(x).cast("double")
    return df.groupBy(*by).agg(
        F.count_if(yc.isNotNull() & xc.isNotNull()).alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_r2(yc, xc).alias("r2"),
    )


def target_kpis(df: DataFrame, label: str) -> DataFrame:
    """Customers, buyers and non-buyers with their shares in percent."""
    n, bought = F.count("*"), F.sum(F.col(label).cast("long"))
    return df.agg(
        n.alias("total"),
        bought.alias("purchased"),
        (n - bought).alias("not_purchased"),
        F.round(F.try_divide(bought * 100.0, n), 1).alias("purchased_pct"),
        F.round(F.try_divide((n - bought) * 100.0, n), 1).alias("not_purchased_pct"),
    )


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def transpose(df: DataFrame, index: str) -> DataFrame:
    """Swap rows and columns of a small statistics table; its rows become columns."""
    return df.transpose(F.col(index))
