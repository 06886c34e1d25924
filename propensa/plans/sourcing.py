"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from propensa.functions.columns import drawn_label, propensity
from propensa.operators.clean import (
    MISSING_SHARES,
    compare_snapshots,
    impute,
    inject_missing,
    recode_values,
)
from propensa.plans import sql
from propensa.plans.common import kept_profile, profile, rounded, scored
from propensa.plans.registry import query
from propensa.session import cached, fresh_path
from propensa.sources.schemas import CUSTOMER, KEY
from propensa.sources.sinks import write_customers, write_scores
from propensa.sources.tables import customers_or_profile, read_customers

_PROFILE_ROWS = "SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c == "MonthlyIncome" else c for c in CUSTOMER.fieldNames()
)


@query("profile_join", sql.using("profile", f"{_PROFILE_ROWS} FROM profile"))
def profile_join(spark, sf_dir):
    return rounded(profile(spark, sf_dir))


@query("scan_profile", sql.using("profile", f"{_PROFILE_ROWS} FROM profile"))
def scan_profile(spark, sf_dir):
    path = fresh_path(spark, "customers-csv")
    write_customers(profile(spark, sf_dir), path)
    return rounded(read_customers(spark, path))


@query("source_fallback", sql.using("profile", f"{_PROFILE_ROWS} FROM profile"))
def source_fallback(spark, sf_dir):
    return rounded(customers_or_profile(spark, f"{sf_dir}/no-such-file.csv", sf_dir))


@query(
    "inject_missing",
    sql.using(
        "imputed",
        "SELECT CustomerID, "
        + ", ".join(
            f"CASE WHEN row_number() OVER (ORDER BY md5(CustomerID::VARCHAR || ':blank-{c}:42')) "
            f"> floor(count(*) OVER () * {s}::DOUBLE) THEN "
            + (f"round({c}, 6)" if c == "MonthlyIncome" else c)
            + f" END AS {c}"
            for c, s in MISSING_SHARES.items()
        )
        + " FROM imputed",
    ),
)
def inject(spark, sf_dir):
    complete = impute(kept_profile(spark, sf_dir, KEY, *MISSING_SHARES))
    return rounded(inject_missing(complete).select(KEY, *MISSING_SHARES))


@query(
    "propensity_label",
    sql.using(
        "profile",
        f"""SELECT CustomerID, round({sql.PROPENSITY}, 6) AS propensity,
          ({sql.u('label', 'CustomerID')} < {sql.PROPENSITY})::INT AS label FROM profile""",
    ),
)
def propensity_label(spark, sf_dir):
    return profile(spark, sf_dir).select(
        KEY, F.round(propensity(), 6).alias("propensity"), drawn_label(propensity()).alias("label")
    )


_COMPARED = [f.name for f in CUSTOMER if f.name != KEY]


@query(
    "snapshot_compare",
    sql.using(
        "imputed",
        "\nUNION ALL\n".join(
            f"""SELECT r.CustomerID, '{c}' AS "column", r.{c}::VARCHAR AS raw_value,
              i.{c}::VARCHAR AS clean_value
            FROM profile r JOIN imputed i USING (CustomerID) WHERE r.{c} IS DISTINCT FROM i.{c}"""
            for c in _COMPARED
        ),
    ),
)
def snapshot_compare(spark, sf_dir):
    raw = kept_profile(spark, sf_dir)
    return compare_snapshots(raw, impute(recode_values(raw)), KEY, _COMPARED)


@query("write_scores", sql.using("scored", "SELECT CustomerID, ProdTaken, score FROM scored"))
def write_scored(spark, sf_dir):
    return write_scores(scored(spark, sf_dir), fresh_path(spark, "scores"))


@query(
    "cached_reuse",
    sql.using(
        "profile",
        """SELECT count(*) AS n_rows, count(DISTINCT CustomerID) AS n_customers,
        count(MonthlyIncome) AS n_incomes FROM profile""",
    ),
)
def cached_reuse(spark, sf_dir):
    kept = cached(profile(spark, sf_dir))
    return cached(kept).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct(KEY).alias("n_customers"),
        F.count("MonthlyIncome").alias("n_incomes"),
    )
