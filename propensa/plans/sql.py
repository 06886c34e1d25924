"""SQL of the shared inputs, for stating expected results independently of the operators."""

from __future__ import annotations

# Columns, categories, coefficients, bands and titles below are those of the data and its rules.
NUMERIC = [
    "Age", "CityTier", "DurationOfPitch", "NumberOfFollowups", "PreferredPropertyStar",
    "NumberOfTrips", "Passport", "PitchSatisfactionScore", "OwnCar", "MonthlyIncome",
    "TotalVisiting", "IncomePerTrip",
]
# Categories of the test tables, sorted; the first of each is the dropped one.
CATEGORIES = {
    "TypeofContact": ["Company Invited", "Self Enquiry"],
    "Occupation": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "Gender": ["Female", "Male"],
    "ProductPitched": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    "MaritalStatus": ["Divorced", "Married", "Unmarried"],
    "Designation": ["AVP", "Executive", "Manager", "Senior Manager", "VP"],
    "AgeGroup": ["25-35", "35-45", "45-60", "60+", "<25"],
}


def u(salt: str, key: str = "c_custkey") -> str:
    return f"(('0x' || substr(md5({key}::VARCHAR || ':{salt}:42'), 1, 4))::INT / 65536::DOUBLE)"


PROPENSITY = """greatest(least(0.05::DOUBLE
    + CASE WHEN MonthlyIncome > 60000 THEN 0.12::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN Passport = 1 THEN 0.10::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN NumberOfTrips >= 5 THEN 0.08::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN Age < 35 THEN 0.06::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN NumberOfChildrenVisiting > 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN MaritalStatus = 'Divorced' THEN -0.04::DOUBLE ELSE 0::DOUBLE END
    + CASE WHEN PitchSatisfactionScore > 7 THEN 0.03::DOUBLE ELSE 0::DOUBLE END, 1), 0)"""

PROFILE = f"""
per_type AS (
  SELECT o_custkey, p_type, sum(l_quantity) AS qty, count(*) AS n
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1, 2),
pitched AS (SELECT o_custkey AS k1, round(sum(qty) / sum(n)) AS duration FROM per_type GROUP BY 1),
product AS (
  SELECT o_custkey AS k2, p_type AS product FROM per_type WHERE p_type IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p_type) = 1),
placed AS (
  SELECT o_custkey AS k3, count(*) FILTER (o_orderstatus = 'F') AS trips,
    count(*) FILTER (o_orderpriority = '2-HIGH') AS followups FROM orders GROUP BY 1),
unlabelled AS (
  SELECT c_custkey AS CustomerID,
    CASE WHEN {u('agenull')} >= 0.03 THEN (18 + floor(47 * {u('age')}))::DOUBLE END AS Age,
    CASE WHEN {u('toc')} < 0.02 THEN NULL WHEN {u('toc')} < 0.70 THEN 'Self Enquiry'
      ELSE 'Company Invited' END AS TypeofContact,
    (n_regionkey % 3 + 1)::INT AS CityTier,
    duration::DOUBLE AS DurationOfPitch,
    c_mktsegment AS Occupation,
    CASE WHEN {u('gender')} < 0.60 THEN 'Male' WHEN {u('gender')} < 0.95 THEN 'Female'
      ELSE 'Fe Male' END AS Gender,
    (1 + floor(5 * {u('persons')}))::INT AS NumberOfPersonVisiting,
    CASE WHEN followups > 0 THEN followups::DOUBLE END AS NumberOfFollowups,
    product AS ProductPitched,
    CASE WHEN {u('starnull')} >= 0.04 THEN (3 + floor(3 * {u('star')}))::DOUBLE END
      AS PreferredPropertyStar,
    CASE WHEN {u('mar')} < 0.25 THEN 'Single' WHEN {u('mar')} < 0.75 THEN 'Married'
      WHEN {u('mar')} < 0.85 THEN 'Divorced' ELSE 'Unmarried' END AS MaritalStatus,
    trips::DOUBLE AS NumberOfTrips,
    ({u('pass')} < 0.29)::INT AS Passport,
    (1 + floor(5 * {u('score')}))::INT AS PitchSatisfactionScore,
    ({u('car')} < 0.6)::INT AS OwnCar,
    CASE WHEN {u('chnull')} >= 0.03 THEN floor(4 * {u('child')})::DOUBLE END
      AS NumberOfChildrenVisiting,
    CASE WHEN {u('desig')} < 0.3 THEN 'Executive' WHEN {u('desig')} < 0.6 THEN 'Manager'
      WHEN {u('desig')} < 0.8 THEN 'Senior Manager' WHEN {u('desig')} < 0.92 THEN 'AVP'
      ELSE 'VP' END AS Designation,
    CASE WHEN c_acctbal >= 0 THEN 15000 + 6 * c_acctbal END AS MonthlyIncome
  FROM customer JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN pitched ON c_custkey = k1 LEFT JOIN product ON c_custkey = k2
    LEFT JOIN placed ON c_custkey = k3),
profile AS MATERIALIZED (
  SELECT *, ({u('label', 'CustomerID')} < {PROPENSITY})::INT AS ProdTaken FROM unlabelled)"""

RECODED = """
recoded AS (
  SELECT * REPLACE (
    CASE WHEN Gender = 'Fe Male' THEN 'Female' ELSE Gender END AS Gender,
    CASE WHEN MaritalStatus = 'Single' THEN 'Unmarried' ELSE MaritalStatus END AS MaritalStatus)
  FROM profile)"""


def mode_of(column: str, source: str) -> str:
    return (
        f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


MEDIANS = ["Age", "DurationOfPitch", "NumberOfTrips", "MonthlyIncome"]
MODES = ["TypeofContact", "NumberOfFollowups", "PreferredPropertyStar", "NumberOfChildrenVisiting"]

IMPUTED = (
    "\nimputed AS (\n  SELECT * REPLACE (\n    "
    + ",\n    ".join(
        [f"coalesce({c}, (SELECT median({c}) FROM recoded)) AS {c}" for c in MEDIANS]
        + [f"coalesce({c}, {mode_of(c, 'recoded')}) AS {c}" for c in MODES]
    )
    + ")\n  FROM recoded)"
)

CLEANED = """
cleaned AS (
  SELECT * EXCLUDE (NumberOfPersonVisiting, NumberOfChildrenVisiting),
    NumberOfPersonVisiting + NumberOfChildrenVisiting AS TotalVisiting FROM imputed)"""

AGE_GROUP = """CASE WHEN Age > 0 AND Age <= 25 THEN '<25' WHEN Age > 25 AND Age <= 35 THEN '25-35'
    WHEN Age > 35 AND Age <= 45 THEN '35-45' WHEN Age > 45 AND Age <= 60 THEN '45-60'
    WHEN Age > 60 AND Age <= 100 THEN '60+' END"""

DERIVED = f"""
derived AS (
  SELECT * EXCLUDE (NumberOfPersonVisiting, NumberOfChildrenVisiting),
    NumberOfPersonVisiting + coalesce(NumberOfChildrenVisiting, 0) AS TotalVisiting,
    MonthlyIncome / CASE WHEN NumberOfTrips = 0 THEN 1 ELSE NumberOfTrips END AS IncomePerTrip,
    {AGE_GROUP} AS AgeGroup
  FROM recoded)"""

SPLIT = """
parted AS MATERIALIZED (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY ProdTaken
      ORDER BY md5(CustomerID::VARCHAR || ':split:42'))
    <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY ProdTaken))
    THEN 'test' ELSE 'train' END AS split
  FROM derived),
train AS (SELECT * FROM parted WHERE split = 'train')"""

FILLS = (
    "\nfills AS MATERIALIZED (\n  SELECT "
    + ",\n    ".join(
        [f"(SELECT median({c}) FROM train) AS f_{c}" for c in NUMERIC]
        + [f"{mode_of(c, 'train')} AS f_{c}" for c in CATEGORIES]
    )
    + "),\nfilled AS MATERIALIZED (\n  SELECT CustomerID, ProdTaken, split,\n    "
    + ",\n    ".join(
        [f"coalesce({c}::DOUBLE, f_{c}::DOUBLE) AS {c}" for c in NUMERIC]
        + [f"coalesce({c}, f_{c}) AS {c}" for c in CATEGORIES]
    )
    + "\n  FROM parted, fills)"
)

FEATURES = [f"num_{c}" for c in NUMERIC] + [f"{c}_{v}" for c, vs in CATEGORIES.items() for v in vs[1:]]

MATRIX = (
    "\nspread AS MATERIALIZED (\n  SELECT "
    + ",\n    ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMERIC)
    + "\n  FROM filled WHERE split = 'train'),\nmatrix AS MATERIALIZED (\n  SELECT CustomerID, ProdTaken, split,\n    "
    + ",\n    ".join(
        [f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS "num_{c}"' for c in NUMERIC]
        + [
            f"""({c} = '{v}')::INT::DOUBLE AS "{c}_{v}\""""
            for c, vs in CATEGORIES.items()
            for v in vs[1:]
        ]
    )
    + "\n  FROM filled, spread)"
)

# Two more sets of feature columns: those of the cleaned table and those of the derived variant.
CLEANED_NUMERIC = [
    "Age", "CityTier", "DurationOfPitch", "NumberOfFollowups", "PreferredPropertyStar", "NumberOfTrips", "Passport",
    "PitchSatisfactionScore", "OwnCar", "MonthlyIncome", "TotalVisiting",
]
CLEANED_CATEGORIES = {c: v for c, v in CATEGORIES.items() if c != "AgeGroup"}
VARIANT_NUMERIC = [
    "Age", "MonthlyIncome", "NumberOfTrips", "DurationOfPitch", "PitchSatisfactionScore", "NumberOfFollowups",
    "TotalVisiting", "Passport", "CityTier", "IncomePerTrip",
]
VARIANT_CATEGORIES = {c: v for c, v in CATEGORIES.items() if c != "TypeofContact"}

VARIANT = f"""
variant AS (
  SELECT CustomerID, ProdTaken, trunc(Age)::INT AS Age, trunc(MonthlyIncome)::INT AS MonthlyIncome,
    trunc(NumberOfTrips)::INT AS NumberOfTrips, trunc(DurationOfPitch)::INT AS DurationOfPitch,
    PitchSatisfactionScore, trunc(NumberOfFollowups)::INT AS NumberOfFollowups,
    (NumberOfPersonVisiting + NumberOfChildrenVisiting)::INT AS TotalVisiting, Passport,
    Occupation, Gender, MaritalStatus, Designation, ProductPitched, CityTier,
    trunc(MonthlyIncome / CASE WHEN NumberOfTrips = 0 THEN 1 ELSE NumberOfTrips END)::INT AS IncomePerTrip,
    {AGE_GROUP} AS AgeGroup
  FROM recoded)"""


def features(categories: dict, numeric: list[str]) -> list[str]:
    return [f"{c}_{v}" for c, vs in categories.items() for v in vs[1:]] + [f"num_{c}" for c in numeric]


def matrix_of(source: str, numeric: list[str], categories: dict, imputed: bool) -> str:
    """``set_matrix``: the scaled and encoded columns of ``source``, with statistics of its train rows."""

    def filled(c: str, value: str) -> str:
        return f"coalesce({value}, f_{c}) AS {c}" if imputed else f"{value} AS {c}"

    fills = ", ".join(
        [f"(SELECT median({c}) FROM set_train)::DOUBLE AS f_{c}" for c in numeric]
        + [f"{mode_of(c, 'set_train')} AS f_{c}" for c in categories]
    )
    cells = ", ".join([filled(c, f"{c}::DOUBLE") for c in numeric] + [filled(c, c) for c in categories])
    moments = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in numeric)
    made = ", ".join(
        [f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS "num_{c}"' for c in numeric]
        + [f"""({c} = '{v}')::INT::DOUBLE AS "{c}_{v}\"""" for c, vs in categories.items() for v in vs[1:]]
    )
    return f"""
set_parted AS MATERIALIZED (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY ProdTaken ORDER BY md5(CustomerID::VARCHAR || ':split:42'))
    <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY ProdTaken)) THEN 'test' ELSE 'train' END AS split
  FROM {source}),
set_train AS (SELECT * FROM set_parted WHERE split = 'train'),
set_fills AS MATERIALIZED (SELECT {fills}),
set_filled AS MATERIALIZED (SELECT CustomerID, split, {cells} FROM set_parted, set_fills),
set_spread AS MATERIALIZED (SELECT {moments} FROM set_filled WHERE split = 'train'),
set_matrix AS MATERIALIZED (SELECT CustomerID, {made} FROM set_filled, set_spread)"""


SCORED = f"""
scored AS MATERIALIZED (
  SELECT CustomerID, ProdTaken, round({PROPENSITY}, 6) AS score FROM profile)"""

# Positives and negatives at or above each distinct score, and in all.
CURVE = """
per_score AS (
  SELECT score, count(*) FILTER (ProdTaken = 1) AS pos, count(*) FILTER (ProdTaken = 0) AS neg
  FROM scored GROUP BY score),
curve AS (
  SELECT score, pos, neg,
    sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
    sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
  FROM per_score),
pr AS (
  SELECT score, tp / (tp + fp)::DOUBLE AS prec, tp / all_pos::DOUBLE AS rec FROM curve)"""


def cells(threshold: float) -> str:
    return f"""
cells AS (
  SELECT count(*) FILTER (ProdTaken = 1 AND score >= {threshold})::DOUBLE AS tp,
    count(*) FILTER (ProdTaken = 0 AND score >= {threshold})::DOUBLE AS fp,
    count(*) FILTER (ProdTaken = 1 AND score < {threshold})::DOUBLE AS fn,
    count(*) FILTER (ProdTaken = 0 AND score < {threshold})::DOUBLE AS tn FROM scored)"""


_ORDER = {
    "profile": [PROFILE],
    "recoded": [PROFILE, RECODED],
    "imputed": [PROFILE, RECODED, IMPUTED],
    "cleaned": [PROFILE, RECODED, IMPUTED, CLEANED],
    "variant": [PROFILE, RECODED, VARIANT],
    "derived": [PROFILE, RECODED, DERIVED],
    "split": [PROFILE, RECODED, DERIVED, SPLIT],
    "filled": [PROFILE, RECODED, DERIVED, SPLIT, FILLS],
    "matrix": [PROFILE, RECODED, DERIVED, SPLIT, FILLS, MATRIX],
    "scored": [PROFILE, SCORED],
    "curve": [PROFILE, SCORED, CURVE],
}


def using(base: str, body: str, *more: str) -> str:
    """A statement over the named input: its common table expressions, then ``body``."""
    return "WITH " + ",".join([*_ORDER[base], *more]) + "\n" + body.strip()
