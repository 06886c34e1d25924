"""Queries over exploratory aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from propensa.functions.columns import AGE_LABELS, PURCHASE_LABELS, age_group, map_labels
from propensa.operators import explore
from propensa.operators.clean import impute, recode_values
from propensa.plans import sql
from propensa.plans.common import kept_profile, profile, rounded
from propensa.plans.registry import query
from propensa.sources.schemas import CUSTOMER, LABEL

_ALL = CUSTOMER.fieldNames()
_NUMERIC = [f.name for f in CUSTOMER if f.dataType.simpleString() in ("int", "double")]
_SHOWN = [c for c in _NUMERIC if c != LABEL]
_TEXT = ["TypeofContact", "Occupation", "Gender", "ProductPitched", "MaritalStatus", "Designation"]


def _union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


@query("table_shape", sql.using("profile", "SELECT count(*) AS n_rows, 20::BIGINT AS n_columns FROM profile"))
def table_shape(spark, sf_dir):
    return explore.table_shape(profile(spark, sf_dir))


_NULLS = _union(
    *[
        f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS n_null, count(*) AS n_rows
        FROM profile"""
        for c in _ALL
    ]
)


@query(
    "null_counts",
    sql.using(
        "profile",
        f"""SELECT "column", n_null FROM ({_NULLS})
        UNION ALL SELECT '(total)', sum(n_null)::BIGINT FROM ({_NULLS})""",
    ),
)
def null_counts(spark, sf_dir):
    counted = explore.null_counts(profile(spark, sf_dir)).select("column", "n_null")
    total = F.coalesce("column", F.lit("(total)")).alias("column")
    return counted.rollup("column").agg(F.sum("n_null").alias("n_null")).select(total, "n_null")


@query(
    "null_percent",
    sql.using(
        "profile",
        f"""SELECT "column", round(n_null * 100.0::DOUBLE / n_rows, 2) AS null_pct
        FROM ({_NULLS}) WHERE n_null > 0""",
    ),
)
def null_percent(spark, sf_dir):
    return explore.null_percent(profile(spark, sf_dir))


@query(
    "value_counts",
    sql.using(
        "profile",
        "SELECT ProductPitched, count(*) AS n FROM profile WHERE ProductPitched IS NOT NULL GROUP BY 1",
    ),
)
def value_counts(spark, sf_dir):
    return explore.value_counts(profile(spark, sf_dir), "ProductPitched")


@query(
    "value_counts_all",
    sql.using(
        "profile",
        _union(
            *[
                f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n FROM profile
                WHERE {c} IS NOT NULL GROUP BY {c}"""
                for c in _TEXT
            ]
        ),
    ),
)
def value_counts_all(spark, sf_dir):
    return explore.value_counts_of(profile(spark, sf_dir), _TEXT)


@query(
    "schema_info",
    sql.using(
        "profile",
        _union(
            *[
                f"""SELECT '{f.name}' AS "column", '{f.dataType.simpleString()}' AS dtype,
                count({f.name}) AS non_null FROM profile"""
                for f in CUSTOMER
            ]
        ),
    ),
)
def schema_info(spark, sf_dir):
    return explore.schema_info(profile(spark, sf_dir))


@query(
    "imbalance_ratio",
    sql.using(
        "profile",
        """SELECT count(*) FILTER (ProdTaken = 0) AS n_negative,
        count(*) FILTER (ProdTaken = 1) AS n_positive,
        round(count(*) FILTER (ProdTaken = 0) / (count(*) FILTER (ProdTaken = 1))::DOUBLE, 6)
          AS ratio FROM profile""",
    ),
)
def imbalance_ratio(spark, sf_dir):
    return rounded(explore.imbalance_ratio(profile(spark, sf_dir), LABEL))


_AGE_RATES = f"""SELECT d.AgeGroup, count(ProdTaken) AS n,
  coalesce(sum(ProdTaken), 0)::BIGINT AS n_positive, round(avg(ProdTaken), 6) AS rate
FROM (VALUES ('<25'), ('25-35'), ('35-45'), ('45-60'), ('60+')) AS d(AgeGroup)
LEFT JOIN (SELECT {sql.AGE_GROUP} AS AgeGroup, ProdTaken FROM imputed) i USING (AgeGroup)
GROUP BY 1"""


@query("purchase_rate", sql.using("imputed", _AGE_RATES))
def purchase_rate(spark, sf_dir):
    rows = impute(kept_profile(spark, sf_dir, "Age", LABEL))
    banded = rows.select(age_group().alias("AgeGroup"), LABEL)
    return rounded(explore.rate_by(banded, "AgeGroup", LABEL, AGE_LABELS))


_SEGMENTS = [
    "Occupation", "MaritalStatus", "Gender", "ProductPitched", "Designation", "Passport", "CityTier",
]


@query(
    "purchase_rate_by_segment",
    sql.using(
        "recoded",
        _union(
            *[
                f"""SELECT '{c}' AS segment, {c}::VARCHAR AS value, count(*) AS n,
                round(avg(ProdTaken), 6) AS rate, round(avg(ProdTaken) * 100, 1) AS rate_pct
                FROM recoded WHERE {c} IS NOT NULL GROUP BY {c}"""
                for c in _SEGMENTS
            ]
        ),
    ),
)
def purchase_rate_by_segment(spark, sf_dir):
    rows = recode_values(profile(spark, sf_dir))
    return rounded(explore.rates_by(rows, _SEGMENTS, LABEL))


@query(
    "segment_by_label",
    sql.using(
        "recoded",
        """SELECT MaritalStatus, CASE ProdTaken WHEN 0 THEN 'Not Purchased' ELSE 'Purchased' END
        AS purchase, count(*) AS n FROM recoded GROUP BY 1, 2""",
    ),
)
def segment_by_label(spark, sf_dir):
    counted = explore.count_by(recode_values(profile(spark, sf_dir)), "MaritalStatus", LABEL)
    return counted.select(
        "MaritalStatus", map_labels(LABEL, PURCHASE_LABELS).alias("purchase"), "n"
    )


def _describe_sql(c: str, source: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
      round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min,
      round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50,
      round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, round(max({c})::DOUBLE, 6) AS max FROM {source}"""


@query(
    "describe_numeric",
    sql.using("profile", _union(*[_describe_sql(c, "profile") for c in _NUMERIC])),
)
def describe_numeric(spark, sf_dir):
    return rounded(explore.describe(kept_profile(spark, sf_dir, *_NUMERIC), _NUMERIC))


_STATS = ["mean", "std", "min", "q25", "q50", "q75", "max"]


@query(
    "transpose_stats",
    sql.using(
        "profile",
        _union(
            *[
                f"SELECT '{s}' AS statistic, "
                + ", ".join(f"max({s}) FILTER (\"column\" = '{c}') AS {c}" for c in _SHOWN)
                + " FROM described"
                for s in _STATS
            ]
        ),
        f"described AS ({_union(*[_describe_sql(c, 'profile') for c in _SHOWN])})",
    ),
)
def transpose_stats(spark, sf_dir):
    stats = explore.describe(kept_profile(spark, sf_dir, *_SHOWN), _SHOWN).select("column", *_STATS)
    # Transposing runs the statistics at once: their rows become its columns.
    wide = explore.transpose(rounded(stats), "column")
    return wide.withColumnRenamed("key", "statistic").select("statistic", *_SHOWN)


@query(
    "melt_metrics",
    sql.using(
        "profile",
        _union(
            *[
                f"""SELECT "column", '{s}' AS metric, {s} AS score FROM described"""
                for s in _STATS
            ]
        ),
        f"described AS ({_union(*[_describe_sql(c, 'profile') for c in _SHOWN])})",
    ),
)
def melt_metrics(spark, sf_dir):
    stats = rounded(explore.describe(kept_profile(spark, sf_dir, *_SHOWN), _SHOWN))
    return explore.melt(stats, ["column"], _STATS, "metric", "score")


@query(
    "correlation_matrix",
    sql.using(
        "imputed",
        _union(
            *[
                f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM imputed"
                for a in _NUMERIC
                for b in _NUMERIC
            ]
        ),
    ),
)
def correlation_matrix(spark, sf_dir):
    rows = impute(kept_profile(spark, sf_dir, *_NUMERIC))
    return rounded(explore.correlations(rows, _NUMERIC))


@query(
    "histogram_by_label",
    sql.using(
        "profile",
        """SELECT bin, round(lo + bin * ((hi - lo) / 30), 6) AS low,
          round(lo + (bin + 1) * ((hi - lo) / 30), 6) AS high, ProdTaken, count(*) AS n
        FROM (SELECT ProdTaken, lo, hi,
            least(floor((MonthlyIncome - lo) / ((hi - lo) / 30)), 29)::INT AS bin
          FROM profile, (SELECT min(MonthlyIncome) AS lo, max(MonthlyIncome) AS hi FROM profile)
          WHERE MonthlyIncome IS NOT NULL)
        GROUP BY bin, lo, hi, ProdTaken""",
    ),
)
def histogram_by_label(spark, sf_dir):
    return rounded(explore.histogram(profile(spark, sf_dir), "MonthlyIncome", LABEL, 30))


def _box_sql(c: str) -> str:
    return f"""SELECT ProdTaken, '{c}' AS "column", count(*) AS n, round(max(q1), 6) AS q1,
      round(max(q2), 6) AS median, round(max(q3), 6) AS q3,
      round(min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
      round(max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
      count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM (SELECT ProdTaken, {c},
        quantile_cont({c}, 0.25) OVER w AS q1, quantile_cont({c}, 0.5) OVER w AS q2,
        quantile_cont({c}, 0.75) OVER w AS q3
      FROM profile WHERE {c} IS NOT NULL WINDOW w AS (PARTITION BY ProdTaken))
    GROUP BY ProdTaken"""


@query("boxplot_stats", sql.using("profile", _union(*[_box_sql(c) for c in _SHOWN])))
def boxplot_stats(spark, sf_dir):
    return rounded(explore.box_stats(profile(spark, sf_dir), _SHOWN, [LABEL]))


@query(
    "violin_density",
    sql.using(
        "derived",
        """SELECT AgeGroup, ProdTaken, point, round(x, 4) AS x, round(sum(
            exp(-0.5 * pow((x - MonthlyIncome) / h, 2))) / (n * h * sqrt(2 * pi())), 12) AS density
        FROM grid JOIN derived USING (AgeGroup, ProdTaken)
        WHERE MonthlyIncome IS NOT NULL GROUP BY AgeGroup, ProdTaken, point, x, n, h""",
        """shape AS (
          SELECT AgeGroup, ProdTaken, count(*) AS n, min(MonthlyIncome) AS lo, max(MonthlyIncome) AS hi,
            1.059::DOUBLE * least(stddev_samp(MonthlyIncome),
              (quantile_cont(MonthlyIncome, 0.75) - quantile_cont(MonthlyIncome, 0.25)) / 1.349::DOUBLE)
              * pow(count(*), -0.2::DOUBLE) AS h
          FROM derived WHERE AgeGroup IS NOT NULL AND MonthlyIncome IS NOT NULL GROUP BY 1, 2),
        grid AS (
          SELECT AgeGroup, ProdTaken, n, h, i::INT AS point,
            lo - 2 * h + i * ((hi - lo + 4 * h) / 31) AS x
          FROM shape, range(32) AS r(i) WHERE h > 0)""",
    ),
)
def violin_density(spark, sf_dir):
    rows = kept_profile(spark, sf_dir, "Age", "MonthlyIncome", LABEL)
    banded = rows.select(age_group().alias("AgeGroup"), LABEL, "MonthlyIncome")
    curves = explore.density(banded, "MonthlyIncome", ["AgeGroup", LABEL], grid=32)
    return curves.select(
        "AgeGroup", LABEL, "point", F.round("x", 4).alias("x"), F.round("density", 12).alias("density")
    )


@query(
    "ols_trend",
    sql.using(
        "profile",
        """SELECT ProdTaken, count(*) FILTER (MonthlyIncome IS NOT NULL AND Age IS NOT NULL) AS n,
          round(regr_slope(MonthlyIncome, Age), 6) AS slope,
          round(regr_intercept(MonthlyIncome, Age), 6) AS intercept,
          round(regr_r2(MonthlyIncome, Age), 6) AS r2 FROM profile GROUP BY ProdTaken""",
    ),
)
def ols_trend(spark, sf_dir):
    return rounded(explore.ols(profile(spark, sf_dir), "MonthlyIncome", "Age", [LABEL]))


@query(
    "target_kpis",
    sql.using(
        "profile",
        """SELECT count(*) AS total, sum(ProdTaken)::BIGINT AS purchased,
          (count(*) - sum(ProdTaken))::BIGINT AS not_purchased,
          round(sum(ProdTaken) * 100.0::DOUBLE / count(*), 1) AS purchased_pct,
          round((count(*) - sum(ProdTaken)) * 100.0::DOUBLE / count(*), 1) AS not_purchased_pct
        FROM profile""",
    ),
)
def target_kpis(spark, sf_dir):
    return explore.target_kpis(profile(spark, sf_dir), LABEL)


@query(
    "sort_by_metric",
    sql.using(
        "recoded",
        """SELECT Designation, count(*) AS n, sum(ProdTaken)::BIGINT AS n_positive,
          round(avg(ProdTaken), 6) AS rate FROM recoded GROUP BY 1 ORDER BY rate DESC""",
    ),
)
def sort_by_metric(spark, sf_dir):
    rates = explore.rate_by(profile(spark, sf_dir), "Designation", LABEL)
    return rounded(rates).orderBy(F.desc("rate"), "Designation")
