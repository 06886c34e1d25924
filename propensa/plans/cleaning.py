"""Queries over cleaning, deriving, projecting and combining customer rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from propensa.functions.columns import (
    PASSPORT_LABELS,
    PURCHASE_LABELS,
    age_group,
    apply_threshold,
    clip,
    income_per_trip,
    key_factors,
    map_labels,
    risk_band,
    rounded as round_column,
    total_visiting,
)
from propensa.operators import clean
from propensa.operators.evaluate import attach_actuals
from propensa.operators.explore import discrete_or_continuous, filter_counts, rate_by
from propensa.operators.features import split
from propensa.plans import sql
from propensa.plans.common import kept_profile, profile, rounded, scored
from propensa.plans.registry import query
from propensa.sources.schemas import CUSTOMER, KEY, LABEL, VARIANT_COLUMNS
from propensa.sources.tables import table

_RECODED_TEXT = "CustomerID, Gender, MaritalStatus"


@query(
    "drop_columns",
    sql.using(
        "profile",
        "SELECT * EXCLUDE (CustomerID, TypeofContact, NumberOfPersonVisiting) "
        "REPLACE (round(MonthlyIncome, 6) AS MonthlyIncome) FROM profile",
    ),
)
def drop_columns(spark, sf_dir):
    names = ["CustomerID", "TypeofContact", "NumberOfPersonVisiting", "NotThere"]
    return rounded(clean.drop_columns(profile(spark, sf_dir), names))


@query(
    "select_columns",
    sql.using("profile", "SELECT CustomerID, Age, Occupation, Passport, ProdTaken FROM profile"),
)
def select_columns(spark, sf_dir):
    return profile(spark, sf_dir).select(KEY, "Age", "Occupation", "Passport", LABEL)


def _typed(kinds: tuple[str, ...]) -> list[str]:
    return [f.name for f in CUSTOMER if f.dataType.simpleString() in kinds and f.name != KEY]


@query(
    "discrete_vs_continuous",
    sql.using(
        "profile",
        "SELECT *, CASE WHEN n_distinct <= 25 THEN 'discrete' ELSE 'continuous' END AS kind FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", (count(DISTINCT {c})
              + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))::BIGINT AS n_distinct FROM profile"""
            for c in _typed(("int", "double"))
        )
        + ")",
    ),
)
def discrete_vs_continuous(spark, sf_dir):
    return discrete_or_continuous(profile(spark, sf_dir), _typed(("int", "double")))


_PREDICATES = {
    "high income": "MonthlyIncome > 60000",
    "passport": "Passport = 1",
    "frequent": "NumberOfTrips >= 5",
    "young": "Age < 35",
    "with children": "NumberOfChildrenVisiting > 0",
    "divorced": "MaritalStatus = 'Divorced'",
    "high pitch score": "PitchSatisfactionScore > 3",
    "income unknown": "MonthlyIncome IS NULL",
    "buyer": "ProdTaken = 1",
}


@query(
    "filter_predicates",
    sql.using(
        "profile",
        " UNION ALL ".join(
            f"SELECT '{n}' AS predicate, count(*) AS n FROM profile WHERE {p}"
            for n, p in _PREDICATES.items()
        ),
    ),
)
def filter_predicates(spark, sf_dir):
    return filter_counts(profile(spark, sf_dir), {n: F.expr(p) for n, p in _PREDICATES.items()})


@query(
    "rename_columns",
    sql.using(
        "profile",
        'SELECT Occupation AS segment, count(*) AS "Count" FROM profile GROUP BY 1',
    ),
)
def rename_columns(spark, sf_dir):
    counted = profile(spark, sf_dir).groupBy("Occupation").count()
    return counted.withColumnsRenamed({"Occupation": "segment", "count": "Count"})


@query("recode_values", sql.using("recoded", f"SELECT {_RECODED_TEXT} FROM recoded"))
def recode_values(spark, sf_dir):
    return clean.recode_values(profile(spark, sf_dir)).select(KEY, "Gender", "MaritalStatus")


@query(
    "map_labels",
    sql.using(
        "profile",
        """SELECT CustomerID,
          CASE ProdTaken WHEN 0 THEN 'Not Purchased' WHEN 1 THEN 'Purchased' END AS purchase,
          CASE Passport WHEN 0 THEN 'No Passport' WHEN 1 THEN 'Has Passport' END AS passport_text,
          CASE CityTier WHEN 1 THEN 'metro' END AS metro FROM profile""",
    ),
)
def map_label_texts(spark, sf_dir):
    return profile(spark, sf_dir).select(
        KEY,
        map_labels(LABEL, PURCHASE_LABELS).alias("purchase"),
        map_labels("Passport", PASSPORT_LABELS).alias("passport_text"),
        map_labels("CityTier", {1: "metro"}).alias("metro"),
    )


@query(
    "total_visiting",
    sql.using(
        "profile",
        """SELECT CustomerID, NumberOfPersonVisiting + NumberOfChildrenVisiting AS strict_total,
          NumberOfPersonVisiting + coalesce(NumberOfChildrenVisiting, 0) AS lenient_total
          FROM profile""",
    ),
)
def total_visitors(spark, sf_dir):
    return profile(spark, sf_dir).select(
        KEY,
        total_visiting().alias("strict_total"),
        total_visiting("zero").alias("lenient_total"),
    )


@query(
    "income_per_trip",
    sql.using(
        "profile",
        """SELECT CustomerID,
          round(MonthlyIncome / CASE WHEN NumberOfTrips = 0 THEN 1 ELSE NumberOfTrips END, 6)
            AS guarded,
          trunc(MonthlyIncome / nullif(NumberOfTrips, 0))::INT AS truncated FROM profile""",
    ),
)
def income_by_trip(spark, sf_dir):
    return rounded(
        profile(spark, sf_dir).select(
            KEY,
            income_per_trip().alias("guarded"),
            income_per_trip(zero_guard=False, truncate=True).alias("truncated"),
        )
    )


@query(
    "age_group", sql.using("profile", f"SELECT CustomerID, {sql.AGE_GROUP} AS AgeGroup FROM profile")
)
def age_groups(spark, sf_dir):
    return profile(spark, sf_dir).select(KEY, age_group().alias("AgeGroup"))


_LEFT_CLOSED = """CASE WHEN Age < 25 THEN '<25' WHEN Age < 35 THEN '25-35' WHEN Age < 45 THEN '35-45'
    WHEN Age < 60 THEN '45-60' WHEN Age IS NOT NULL THEN '60+' END"""


@query(
    "age_group_skew",
    sql.using(
        "profile",
        f"""SELECT CustomerID, Age, training, serving FROM (
          SELECT CustomerID, Age, {sql.AGE_GROUP} AS training, {_LEFT_CLOSED} AS serving
          FROM profile) WHERE training IS DISTINCT FROM serving""",
    ),
)
def age_group_skew(spark, sf_dir):
    return (
        profile(spark, sf_dir)
        .select(
            KEY,
            "Age",
            age_group(closed="right").alias("training"),
            age_group(closed="left").alias("serving"),
        )
        .where(~F.col("training").eqNullSafe(F.col("serving")))
    )


@query(
    "align_columns",
    sql.using(
        "profile",
        "SELECT CustomerID, Passport, 0 AS LoyaltyPoints, Age, 0 AS Region FROM profile",
    ),
)
def align_columns(spark, sf_dir):
    template = [KEY, "Passport", "LoyaltyPoints", "Age", "Region"]
    return clean.align_columns(profile(spark, sf_dir), template)


@query(
    "clip_values",
    sql.using(
        "profile",
        """SELECT CustomerID,
          CASE WHEN Age IS NOT NULL THEN greatest(least(Age, 60), 20) END AS Age,
          round(CASE WHEN MonthlyIncome IS NOT NULL
            THEN greatest(least(MonthlyIncome, 60000), 20000) END, 6) AS MonthlyIncome FROM profile""",
    ),
)
def clip_values(spark, sf_dir):
    return rounded(
        profile(spark, sf_dir).select(
            KEY,
            clip("Age", 20, 60).alias("Age"),
            clip("MonthlyIncome", 20000, 60000).alias("MonthlyIncome"),
        )
    )


@query(
    "cast_columns",
    sql.using(
        "profile",
        """SELECT CustomerID, CityTier::VARCHAR AS tier_text, (Age > 30)::INT AS over_30,
          trunc(MonthlyIncome)::INT AS income_int, Passport::DOUBLE AS passport_float
          FROM profile""",
    ),
)
def cast_columns(spark, sf_dir):
    return profile(spark, sf_dir).select(
        KEY,
        F.col("CityTier").cast("string").alias("tier_text"),
        (F.col("Age") > 30).cast("int").alias("over_30"),
        F.col("MonthlyIncome").cast("int").alias("income_int"),
        F.col("Passport").cast("double").alias("passport_float"),
    )


@query(
    "round_values",
    sql.using(
        "profile",
        """SELECT CustomerID, round(MonthlyIncome / 7, 1) AS one_digit,
          round(MonthlyIncome / 7, 3) AS three_digits, round(NumberOfTrips + 0.5) AS half_up,
          round_even(NumberOfTrips + 0.5, 0) AS half_even FROM profile""",
    ),
)
def round_values(spark, sf_dir):
    seventh, half = F.col("MonthlyIncome") / 7, F.col("NumberOfTrips") + 0.5
    return profile(spark, sf_dir).select(
        KEY,
        round_column(seventh, 1).alias("one_digit"),
        round_column(seventh, 3).alias("three_digits"),
        round_column(half, 0).alias("half_up"),
        round_column(half, 0, "half_even").alias("half_even"),
    )


@query(
    "ratio_delta",
    sql.using(
        "scored",
        """SELECT CustomerID, round(score * 100, 4) AS pct, round(1 - score, 6) AS complement,
          round(score - 0.5::DOUBLE, 6) AS from_even FROM scored""",
    ),
)
def ratio_delta(spark, sf_dir):
    score = F.col("score")
    return scored(spark, sf_dir).select(
        KEY,
        F.round(score * 100, 4).alias("pct"),
        F.round(1 - score, 6).alias("complement"),
        F.round(score - 0.5, 6).alias("from_even"),
    )


@query(
    "apply_threshold",
    sql.using(
        "scored", "SELECT CustomerID, score, (score >= 0.21)::INT AS prediction FROM scored"
    ),
)
def thresholded(spark, sf_dir):
    return scored(spark, sf_dir).select(
        KEY, "score", apply_threshold("score", 0.21).alias("prediction")
    )


_FACTORS = [
    ("High Income", "up", "MonthlyIncome > 60000"),
    ("Has Passport", "up", "Passport = 1"),
    ("Frequent Traveller", "up", "NumberOfTrips >= 5"),
    ("Young Demographic", "up", "Age < 35"),
    ("High Pitch Score", "up", "PitchSatisfactionScore >= 4"),
    ("Lower Income", "down", "MonthlyIncome <= 40000"),
    ("No Passport", "down", "Passport = 0"),
    ("Infrequent Traveller", "down", "NumberOfTrips < 2"),
]


@query(
    "key_factors",
    sql.using(
        "profile",
        " UNION ALL ".join(
            f"SELECT CustomerID, '{t}' AS title, '{d}' AS direction FROM profile WHERE {p}"
            for t, d, p in _FACTORS
        ),
    ),
)
def factors(spark, sf_dir):
    # Pitch scores of the profile go up to 5, so the limit is 4 here.
    listed = profile(spark, sf_dir).select(KEY, F.explode(key_factors(pitch_limit=4)).alias("e"))
    return listed.select(KEY, "e.title", "e.direction")


@query(
    "head_rows",
    sql.using(
        "profile",
        "SELECT CustomerID, Age, Occupation, ProdTaken FROM profile ORDER BY CustomerID LIMIT 8",
    ),
)
def head_rows(spark, sf_dir):
    rows = profile(spark, sf_dir).select(KEY, "Age", "Occupation", LABEL)
    return rows.orderBy(KEY).limit(8)


@query(
    "sample_rows",
    sql.using(
        "profile",
        """SELECT CustomerID, round(MonthlyIncome, 6) AS MonthlyIncome,
          CASE ProdTaken WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS bought FROM profile
          ORDER BY md5(CustomerID::VARCHAR || ':sample:1') LIMIT 800""",
    ),
)
def sample_rows(spark, sf_dir):
    chosen = clean.sample_rows(profile(spark, sf_dir), 800)
    return rounded(
        chosen.select(KEY, "MonthlyIncome", map_labels(LABEL, {0: "No", 1: "Yes"}).alias("bought"))
    )


@query(
    "risk_band",
    sql.using(
        "scored",
        """SELECT fixed_band, split_band, count(*) AS n FROM (SELECT
          CASE WHEN score < 0.30 THEN 'low' WHEN score < 0.70 THEN 'medium' ELSE 'high' END
            AS fixed_band,
          CASE WHEN score < 0.21 THEN 'below' ELSE 'at or above' END AS split_band
          FROM scored) GROUP BY 1, 2""",
    ),
)
def risk_bands(spark, sf_dir):
    banded = scored(spark, sf_dir).select(
        risk_band("score").alias("fixed_band"),
        risk_band("score", (0.21,), ("below", "at or above")).alias("split_band"),
    )
    return banded.groupBy("fixed_band", "split_band").agg(F.count("*").alias("n"))


@query(
    "derived_variant",
    sql.using(
        "imputed",
        f"""SELECT trunc(Age)::INT AS Age, trunc(MonthlyIncome)::INT AS MonthlyIncome,
          trunc(NumberOfTrips)::INT AS NumberOfTrips, trunc(DurationOfPitch)::INT AS DurationOfPitch,
          PitchSatisfactionScore, trunc(NumberOfFollowups)::INT AS NumberOfFollowups,
          (NumberOfPersonVisiting + NumberOfChildrenVisiting)::INT AS TotalVisiting, Passport,
          Occupation, Gender, MaritalStatus, Designation, ProductPitched, CityTier, ProdTaken,
          trunc(MonthlyIncome / CASE WHEN NumberOfTrips = 0 THEN 1 ELSE NumberOfTrips END)::INT
            AS IncomePerTrip, {sql.AGE_GROUP} AS AgeGroup FROM imputed""",
    ),
)
def derived_variant(spark, sf_dir):
    rows = clean.impute(clean.recode_values(kept_profile(spark, sf_dir)))
    return clean.variant(rows).select(*VARIANT_COLUMNS)


# Combining tables


@query(
    "lookup_by_key",
    sql.using(
        "profile",
        """SELECT CustomerID, CASE ProdTaken WHEN 0 THEN 'No' ELSE 'Yes' END AS bought
          FROM profile SEMI JOIN (SELECT CustomerID FROM profile
            ORDER BY md5(CustomerID::VARCHAR || ':sample:1') LIMIT 800) USING (CustomerID)""",
    ),
)
def lookup_by_key(spark, sf_dir):
    rows = profile(spark, sf_dir)
    found = clean.lookup_by_key(rows, clean.sample_rows(rows.select(KEY), 800))
    return found.select(KEY, map_labels(LABEL, {0: "No", 1: "Yes"}).alias("bought"))


@query(
    "attach_actuals",
    sql.using(
        "scored",
        """SELECT s.CustomerID, s.score, (s.score >= 0.5)::INT AS prediction, p.ProdTaken AS actual
          FROM scored s JOIN profile p USING (CustomerID)""",
    ),
)
def with_actuals(spark, sf_dir):
    scores = scored(spark, sf_dir).select(
        KEY, "score", apply_threshold("score", 0.5).alias("prediction")
    )
    actuals = profile(spark, sf_dir).select(KEY, F.col(LABEL).alias("actual"))
    return attach_actuals(scores, actuals, KEY)


@query(
    "apply_fitted_stats",
    sql.using(
        "split",
        f"""SELECT CustomerID,
          round(coalesce(MonthlyIncome, (SELECT median(MonthlyIncome) FROM train)), 6)
            AS MonthlyIncome,
          coalesce(Age, (SELECT median(Age) FROM train)) AS Age,
          coalesce(TypeofContact, {sql.mode_of('TypeofContact', 'train')}) AS TypeofContact
          FROM parted WHERE split = 'test'""",
    ),
)
def apply_fitted_stats(spark, sf_dir):
    used = [KEY, LABEL, "MonthlyIncome", "Age", "TypeofContact"]
    rows = split(kept_profile(spark, sf_dir, *used))
    train = rows.where(F.col("split") == "train")
    fills = clean.fit_impute(train, ["MonthlyIncome", "Age"], ["TypeofContact"])
    filled = clean.impute(rows.where(F.col("split") == "test"), fills=fills)
    return rounded(filled.select(KEY, "MonthlyIncome", "Age", "TypeofContact"))


@query(
    "group_with_domain",
    sql.using(
        "profile",
        """SELECT star AS PreferredPropertyStar, count(ProdTaken) AS n,
          coalesce(sum(ProdTaken), 0)::BIGINT AS n_positive, round(avg(ProdTaken), 6) AS rate
          FROM (VALUES (1.0::DOUBLE), (2.0), (3.0), (4.0), (5.0)) AS d(star)
          LEFT JOIN profile ON PreferredPropertyStar = star GROUP BY star""",
    ),
)
def group_with_domain(spark, sf_dir):
    stars = [1.0, 2.0, 3.0, 4.0, 5.0]
    return rounded(rate_by(profile(spark, sf_dir), "PreferredPropertyStar", LABEL, stars))


# Fitted cleaning


@query(
    "impute_median",
    sql.using(
        "imputed",
        """SELECT CustomerID, Age, DurationOfPitch, NumberOfTrips,
          round(MonthlyIncome, 6) AS MonthlyIncome FROM imputed""",
    ),
)
def impute_median(spark, sf_dir):
    rows = clean.impute(kept_profile(spark, sf_dir, KEY, *clean.MEDIAN_COLUMNS))
    return rounded(rows.select(KEY, *clean.MEDIAN_COLUMNS))


@query(
    "impute_mode",
    sql.using(
        "imputed",
        """SELECT CustomerID, TypeofContact, NumberOfFollowups, PreferredPropertyStar,
          NumberOfChildrenVisiting FROM imputed""",
    ),
)
def impute_mode(spark, sf_dir):
    return clean.impute(kept_profile(spark, sf_dir, KEY, *clean.MODE_COLUMNS))


@query(
    "load_and_clean",
    sql.using(
        "cleaned",
        "SELECT * EXCLUDE (CustomerID) REPLACE (round(MonthlyIncome, 6) AS MonthlyIncome) "
        "FROM cleaned",
    ),
)
def load_and_clean(spark, sf_dir):
    return rounded(clean.clean(kept_profile(spark, sf_dir)))


# Duplicates

_DOCUMENT = ["text", "lang", "source", "n_chars"]
_NO_KEY = [c for c in CUSTOMER.fieldNames() if c != KEY]


@query(
    "duplicate_count",
    sql.using(
        "profile",
        f"""SELECT 'customers' AS "table", count(*) AS n_rows, (count(*) - (SELECT count(*) FROM
          (SELECT DISTINCT {', '.join(_NO_KEY)} FROM profile)))::BIGINT AS n_duplicates FROM profile
        UNION ALL
        SELECT 'documents', count(*), (count(*) - (SELECT count(*) FROM
          (SELECT DISTINCT text, lang, source, n_chars FROM documents)))::BIGINT FROM documents""",
    ),
)
def duplicate_count(spark, sf_dir):
    customers = clean.duplicate_count(profile(spark, sf_dir), _NO_KEY)
    documents = clean.duplicate_count(table(spark, sf_dir, "documents"), _DOCUMENT)
    return customers.select(F.lit("customers").alias("table"), "*").unionByName(
        documents.select(F.lit("documents").alias("table"), "*")
    )


@query(
    "drop_duplicates",
    """SELECT doc_id, text, lang, source, n_chars FROM documents
    QUALIFY row_number() OVER (PARTITION BY text, lang, source, n_chars ORDER BY doc_id) = 1""",
)
def drop_duplicates(spark, sf_dir):
    return clean.drop_duplicates(table(spark, sf_dir, "documents"), _DOCUMENT, "doc_id").select(
        "doc_id", *_DOCUMENT
    )



@query(
    "drop_duplicates_keyless",
    sql.using("cleaned", "SELECT DISTINCT * EXCLUDE (CustomerID) REPLACE (round(MonthlyIncome, 6) AS MonthlyIncome) FROM cleaned"),
)
def drop_duplicates_keyless(spark, sf_dir):
    """Cleaned customers without a key, delivered twice, once each: rows without a key are told apart by all their columns."""
    rows = rounded(clean.clean(kept_profile(spark, sf_dir)))
    return clean.drop_duplicates(rows.unionByName(rows))


@query(
    "column_difference",
    sql.using(
        "profile",
        """SELECT "column" FROM ("""
        + " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(DISTINCT {c})
              + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS n FROM profile"""
            for c in _typed(("int", "double"))
        )
        + ") WHERE n > 25",
    ),
)
def continuous_columns(spark, sf_dir):
    numeric = _typed(("int", "double"))
    kinds = discrete_or_continuous(profile(spark, sf_dir), numeric)
    discrete = [r["column"] for r in kinds.where(F.col("kind") == "discrete").collect()]
    left = clean.column_difference(numeric, discrete)
    return spark.createDataFrame([(c,) for c in left], "column string")
