"""Distributed order statistics: running totals, quantiles, hash-rank cutoffs.

An un-partitioned ordered window puts a whole table into one task. Everything here cuts the
order into slices instead: totals per slice (a few rows) give each slice its starting value,
and only the rows of one slice meet in one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensa.session import cut_lineage

# Rows of a slice whose running totals are summed up in one task.
SLICE_ROWS = 200_000
# A digest slice is its first four hex digits: at most 65,536 slices.
SLICE_DIGITS = 4


def _slice_of(value: Column, bounds: Column, slices: int) -> Column:
    """Number of bounds below ``value``, by binary search in the sorted bounds."""
    steps = []
    step = 1
    while step < slices:
        step *= 2
    while step:
        steps.append(step)
        step //= 2

    def advance(position, step):
        probe = position + step
        within = probe <= F.size(bounds)
        return F.when(within & (F.get(bounds, probe - 1) < value), probe).otherwise(position)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), advance)


def running_totals(
    counts: DataFrame,
    order: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    slices: int | None = None,
    prior: bool = False,
) -> DataFrame:
    """Add ``<m>_before`` (sum over smaller ``order``) and ``<m>_all`` (group sum) per measure.

    With ``prior`` also ``<m>_prior``, the measure of the next smaller ``order``.

    ``counts`` holds one row per (``by``, ``order``), already aggregated, with non-null keys and
    a numeric ``order``; it is stored, as several steps read it. Slices are cut at approximate quantiles of ``order``, so they hold
    similar row numbers whatever the distribution looks like: about SLICE_ROWS rows, unless their number is given.
    """
    by = list(by)
    if slices is None:
        counts = cut_lineage(counts, "counts")
        slices = max(1, -(-counts.count() // SLICE_ROWS))
    if slices == 1:
        whole = Window.partitionBy(*by)
        rows = whole.orderBy(order)
        before = rows.rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(
            "*",
            *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"{m}_before") for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_all") for m in measures],
            *[F.lag(m).over(rows).alias(f"{m}_prior") for m in measures if prior],
        )
    shares = [i / slices for i in range(1, slices)]
    bounds = counts.agg(F.percentile_approx(order, shares, max(10_000, 10 * slices)).alias("bounds")).scalar()
    sliced = counts.withColumn("_bounds", bounds)
    sliced = sliced.withColumn("_slice", _slice_of(F.col(order), F.col("_bounds"), slices)).drop("_bounds")
    lasts = [F.max_by(m, order).alias(f"_{m}_last") for m in measures] if prior else []
    per_slice = sliced.groupBy(*by, "_slice").agg(*[F.sum(m).alias(m) for m in measures], *lasts)
    group = Window.partitionBy(*by)
    in_order = group.orderBy("_slice")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_start") for m in measures],
        *[F.sum(m).over(group).alias(f"{m}_all") for m in measures],
        *[F.lag(f"_{m}_last").over(in_order).alias(f"_{m}_last") for m in measures if prior],
    )
    rows = Window.partitionBy(*by, "_slice").orderBy(order)
    inside = rows.rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.select(
        "*",
        *[F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"_{m}_local") for m in measures],
        *[F.lag(m).over(rows).alias(f"_{m}_lag") for m in measures if prior],
    )
    joined = local.join(offsets, [*by, "_slice"])
    return joined.select(
        *counts.columns,
        *[(F.col(f"_{m}_start") + F.col(f"_{m}_local")).alias(f"{m}_before") for m in measures],
        *[f"{m}_all" for m in measures],
        *[F.coalesce(f"_{m}_lag", f"_{m}_last").alias(f"{m}_prior") for m in measures if prior],
    )


def value_frequencies(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, value, n) for numeric columns, without nulls; shrinks before the shuffle."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    )
    long = df.select(*by, F.explode(entries).alias("e")).select(*by, "e.column", "e.value")
    return (
        long.dropna(subset=[*by, "value"])
        .groupBy(*by, "column", "value")
        .agg(F.count("*").alias("n"))
    )


def quantile_name(share: float) -> str:
    return f"q{share * 100:g}".replace(".", "_")


# Brackets reach this far to either side of a quantile, as a share of the rows.
REACH = 1 / 1_000
# Largest error of a sketched rank, as a share of the rows; a tenth of the reach.
SKETCH = 1 / 10_000


def _brackets(known: DataFrame, width: int, shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """(by…, n0, low0, high0, …): per column its known rows, and values just below and above each quantile.

    Groups of few rows, where a rank is more than the sketch can tell apart, are inside as a whole; NaN is
    the largest value there is.
    """
    m = len(shares)
    low, high = [max(0.0, q - REACH) for q in shares], [min(1.0, q + REACH) for q in shares]
    values = [f"v{i}" for i in range(width)]
    sketched = known.groupBy(*by).agg(
        *[F.count(v).alias(f"n{i}") for i, v in enumerate(values)],
        *[F.percentile_approx(v, [*low, *high], int(1 / SKETCH)).alias(f"b{i}") for i, v in enumerate(values)],
    )
    out = []
    for i in range(width):
        few = F.col(f"n{i}") < 4 / REACH
        out.append(F.col(f"n{i}"))
        for name, ends, start, outer in (("low", low, 0, float("-inf")), ("high", high, m, float("nan"))):
            edges = [
                F.lit(outer) if ends[j] in (0.0, 1.0)
                else F.when(few, F.lit(outer)).otherwise(F.get(f"b{i}", F.lit(start + j)))
                for j in range(m)
            ]
            out.append(F.array(*edges).alias(f"{name}{i}"))
    return sketched.select(*by, *out)


def quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per (by…, column).

    A sketch brackets each quantile, a second pass counts the rows below the bracket and ranks only the
    values inside it. So of a continuous column about 2·REACH of the rows are shuffled for each share,
    and of a discrete one a few rows per task. Columns without a known value have no row.
    """
    by, m = list(by), len(shares)
    known = df.select(*by, *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    known = known.dropna(subset=by) if by else known
    brackets = _brackets(known, len(columns), shares, by)
    if by:
        # From the stored size Spark decides whether they are broadcast.
        rows = known.join(cut_lineage(brackets, "brackets"), by)
    else:
        # One row, of as many numbers as columns and shares.
        only = brackets.first()
        rows = known.withColumns({c: F.lit(only[c]) for c in brackets.columns})
    below, inside = [], []
    for i in range(len(columns)):
        v = F.col(f"v{i}")
        for j in range(m):
            low, high = F.get(f"low{i}", F.lit(j)), F.get(f"high{i}", F.lit(j))
            below.append(F.struct(
                F.lit(i).alias("i"), F.lit(j).alias("j"), F.max(f"n{i}").alias("n_all"),
                F.count_if(v < low).alias("below"),
            ))
            hit = F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("value"))
            inside.append(F.when((v >= low) & (v <= high), hit))
    counts = rows.groupBy(*by).agg(F.array(*below).alias("e")).select(*by, F.explode("e").alias("e")).select(*by, "e.*")
    merged = (
        rows.select(*by, F.explode(F.array_compact(F.array(*inside))).alias("e")).select(*by, "e.*")
        .groupBy(*by, "i", "j", "value").agg(F.count("*").alias("n"))
    )
    key = [*by, "i", "j"]
    ranked = running_totals(merged, "value", ["n"], key).join(counts.withColumnRenamed("n_all", "rows"), key)
    first = F.col("below") + F.col("n_before")
    position = F.element_at(F.array(*[F.lit(float(q)) for q in shares]), F.col("j") + 1) * (F.col("rows") - 1)

    def value_at(rank: Column) -> Column:
        found = F.max(F.when((first <= rank) & (rank < first + F.col("n")), F.col("value")))
        return F.coalesce(found, F.raise_error(F.lit("a quantile is outside its bracket")).cast("double"))

    low, high, gap = value_at(F.floor(position)), value_at(F.ceil(position)), F.max(position - F.floor(position))
    each = ranked.groupBy(*key).agg(F.max("rows").alias("n"), (low + (high - low) * gap).alias("q"))
    names = F.array(*[F.lit(c) for c in columns])
    return each.groupBy(*by, "i").agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("j") == j, F.col("q"))).alias(quantile_name(q)) for j, q in enumerate(shares)]
    ).select(*by, F.get(names, F.col("i")).alias("column"), "n", *[quantile_name(q) for q in shares])


def cutoff_table(
    df: DataFrame, digest: Column, quotas: Sequence[Column], by: Column | None = None
) -> DataFrame:
    """(by, cuts): for every group the digest of its q-th smallest row, for each quota q.

    ``quotas`` are expressions over ``n_all`` (rows of the group) and ``by``. Rows with a digest
    up to the cutoff are exactly the q first in hash order, so wide rows are never sorted. A quota
    of zero has the cutoff ``""``. Rows whose group is null are a group of their own. The table has
    one row per group and stays in Spark, so there may be any number of groups.
    """
    group = F.lit("") if by is None else by
    narrow = df.select(
        group.alias("by"), digest.alias("digest"), F.substring(digest, 1, SLICE_DIGITS).alias("slice")
    )
    per_slice = narrow.groupBy("by", "slice").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("by")
    earlier = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    located = (
        per_slice.withColumn("n_all", F.sum("n").over(whole))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select("*", F.posexplode(F.array(*[q.cast("long") for q in quotas])).alias("j", "quota"))
    )
    # One row per (group, quota): the slice in which the quota is reached.
    reached = (F.col("quota") > F.col("before")) & (F.col("quota") <= F.col("before") + F.col("n"))
    hits = located.where(reached).select(
        F.col("by").alias("hit_by"), F.col("slice").alias("hit_slice"), "j",
        (F.col("quota") - F.col("before")).alias("wanted"),
    )
    nothing = located.where((F.col("quota") <= 0) & (F.col("before") == 0)).select("by", "j", F.lit("").alias("cut"))
    # Only the slices that hold a cutoff are ranked.
    slices = hits.select("hit_by", "hit_slice").distinct()
    inside = F.col("by").eqNullSafe(F.col("hit_by")) & (F.col("slice") == F.col("hit_slice"))
    ranked = narrow.join(slices, inside, "left_semi").withColumn(
        "rank", F.row_number().over(Window.partitionBy("by", "slice").orderBy("digest"))
    )
    found = ranked.join(hits, inside & (F.col("rank") == F.col("wanted"))).select(
        "by", "j", F.col("digest").alias("cut")
    )
    cuts = F.transform(F.sort_array(F.collect_list(F.struct("j", "cut"))), lambda e: e["cut"])
    return found.unionByName(nothing).groupBy("by").agg(cuts.alias("cuts"))


def hash_cutoffs(
    df: DataFrame, digest: Column, quotas: Sequence[Column], by: Column | None = None
) -> dict:
    """The rows of :func:`cutoff_table` by group, for groups that the caller has named, such as columns."""
    return {r["by"]: list(r["cuts"]) for r in cutoff_table(df, digest, quotas, by).collect()}
