"""Column expressions for cleaning, deriving and judging customer rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from propensa.functions.hashing import uniform

# Dirty category spellings and what they stand for.
RECODES = {
    "Gender": {"Fe Male": "Female"},
    "MaritalStatus": {"Single": "Unmarried"},
}

# Age bands, right-closed upper edges and labels in order.
AGE_EDGES = [0, 25, 35, 45, 60, 100]
AGE_LABELS = ["<25", "25-35", "35-45", "45-60", "60+"]

# Label texts.
PURCHASE_LABELS = {0: "Not Purchased", 1: "Purchased"}
PASSPORT_LABELS = {0: "No Passport", 1: "Has Passport"}


def recode(column: str, mapping: dict) -> Column:
    """Replace listed values, keep all others."""
    value = F.col(column)
    out = reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), mapping.items(), F)
    return out.otherwise(value)


def map_labels(column: str | Column, mapping: dict) -> Column:
    """Look every value up in ``mapping``; values without an entry become null."""
    value = F.col(column) if isinstance(column, str) else column
    return reduce(lambda acc, kv: acc.when(value == kv[0], F.lit(kv[1])), mapping.items(), F)


def total_visiting(null_policy: str = "propagate") -> Column:
    """Adults plus children; ``zero`` counts a missing number of children as none."""
    children = F.col("NumberOfChildrenVisiting")
    if null_policy == "zero":
        children = F.coalesce(children, F.lit(0.0))
    elif null_policy != "propagate":
        raise ValueError(f"unknown null policy {null_policy!r}")
    return F.col("NumberOfPersonVisiting") + children


def income_per_trip(zero_guard: bool = True, truncate: bool = False) -> Column:
    """Income divided by trips; zero trips count as one, or give null without the guard."""
    trips = F.col("NumberOfTrips")
    trips = F.when(trips == 0, F.lit(1.0 if zero_guard else None)).otherwise(trips)
    ratio = F.col("MonthlyIncome") / trips
    return ratio.cast("int") if truncate else ratio


def age_group(column: str = "Age", closed: str = "right") -> Column:
    """Age band label. ``right`` is the modelling rule, ``left`` the rule of the entry form."""
    age = F.col(column)
    if closed == "right":
        out = F
        for low, high, label in zip(AGE_EDGES, AGE_EDGES[1:], AGE_LABELS):
            out = out.when((age > low) & (age <= high), F.lit(label))
        return out
    if closed == "left":
        out = F
        for high, label in zip(AGE_EDGES[1:-1], AGE_LABELS):
            out = out.when(age < high, F.lit(label))
        return out.when(age.isNotNull(), F.lit(AGE_LABELS[-1]))
    raise ValueError(f"closed must be 'right' or 'left', not {closed!r}")


def clip(column: str | Column, low=None, high=None) -> Column:
    """Clamp to [low, high]; null stays null."""
    value = F.col(column) if isinstance(column, str) else column
    out = value
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(value.isNotNull(), out)


def rounded(column: str | Column, digits: int, mode: str = "half_up") -> Column:
    """Round half away from zero (``half_up``) or to the even neighbour (``half_even``)."""
    value = F.col(column) if isinstance(column, str) else column
    if mode == "half_even":
        return F.bround(value, digits)
    if mode == "half_up":
        return F.round(value, digits)
    raise ValueError(f"unknown rounding mode {mode!r}")


def apply_threshold(score: str | Column, threshold: float | Column) -> Column:
    """1 where the score reaches the threshold, else 0."""
    score = F.col(score) if isinstance(score, str) else score
    return (score >= threshold).cast("int")


def propensity_rules(pitch_limit: float = 7) -> list[tuple[float, Column]]:
    """Weight and condition of each additive propensity term."""
    return [
        (0.12, F.col("MonthlyIncome") > 60000),
        (0.10, F.col("Passport") == 1),
        (0.08, F.col("NumberOfTrips") >= 5),
        (0.06, F.col("Age") < 35),
        (0.05, F.col("NumberOfChildrenVisiting") > 0),
        (-0.04, F.col("MaritalStatus") == "Divorced"),
        (0.03, F.col("PitchSatisfactionScore") > pitch_limit),
    ]


def propensity(pitch_limit: float = 7, base: float = 0.05) -> Column:
    """Additive purchase propensity within [0, 1]; a rule on a null value adds nothing."""
    total = F.lit(base)
    for weight, rule in propensity_rules(pitch_limit):
        total = total + F.when(rule, F.lit(weight)).otherwise(F.lit(0.0))
    return clip(total, 0.0, 1.0)


def drawn_label(score: Column, key: str = "CustomerID", salt: str = "label") -> Column:
    """Bernoulli label drawn from the score with the row's own uniform number."""
    return (uniform(key, salt, digits=4) < score).cast("int")


def key_factor_rules(pitch_limit: float = 8) -> list[tuple[str, str, Column]]:
    """Title, direction and condition of each explanation."""
    income, trips = F.col("MonthlyIncome"), F.col("NumberOfTrips")
    return [
        ("High Income", "up", income > 60000),
        ("Has Passport", "up", F.col("Passport") == 1),
        ("Frequent Traveller", "up", trips >= 5),
        ("Young Demographic", "up", F.col("Age") < 35),
        ("High Pitch Score", "up", F.col("PitchSatisfactionScore") >= pitch_limit),
        ("Lower Income", "down", income <= 40000),
        ("No Passport", "down", F.col("Passport") == 0),
        ("Infrequent Traveller", "down", trips < 2),
    ]


def key_factors(pitch_limit: float = 8) -> Column:
    """Array of (title, direction) for the rules that hold in the row."""
    entries = [
        F.when(rule, F.struct(F.lit(title).alias("title"), F.lit(way).alias("direction")))
        for title, way, rule in key_factor_rules(pitch_limit)
    ]
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def risk_band(score: str | Column, edges=(0.30, 0.70), labels=("low", "medium", "high")) -> Column:
    """Band of a probability: each edge is the exclusive upper end of the band before it."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    score = F.col(score) if isinstance(score, str) else score
    out = F
    for edge, label in zip(edges, labels):
        out = out.when(score < edge, F.lit(label))
    return out.when(score.isNotNull(), F.lit(labels[-1]))
