"""Queries over the first rounds of the boosted models, whose every number SQL can state."""

from __future__ import annotations

from propensa.operators import boosting
from propensa.operators.features import with_class_weights
from propensa.plans import sql
from propensa.plans.common import rounded, trained_matrix
from propensa.plans.registry import query
from propensa.session import cached
from propensa.sources.schemas import LABEL

#: Settings of these queries.
_CUTS, _L1, _L2, _CHILD, _RATE = 16, 0.5, 1.0, 1.0, 0.05
_ADA_RATE = 0.5

_ORDER = "list_position([" + ", ".join(f"'{f}'" for f in sql.FEATURES) + "], feature)"
_LONG = f"""
wide AS MATERIALIZED (
  SELECT CustomerID, ProdTaken AS y, {", ".join(f'"{f}"' for f in sql.FEATURES)} FROM matrix WHERE split = 'train'),
long AS MATERIALIZED (
  SELECT CustomerID, y, feature, x FROM (
    UNPIVOT wide ON COLUMNS(* EXCLUDE (CustomerID, y)) INTO NAME feature VALUE x)),
cuts AS MATERIALIZED (
  SELECT feature, c::INT AS c, lo + (hi - lo) * (c - 0.37::DOUBLE) / {_CUTS} AS cut
  FROM (SELECT feature, min(x) AS lo, max(x) AS hi FROM long GROUP BY 1), range(1, {_CUTS} + 1) AS r(c) WHERE lo < hi)"""

_POSITIVE = "(SELECT count(*) FILTER (y = 0) / (count(*) FILTER (y = 1))::DOUBLE FROM wide)"
_GRADIENTS = f"""
graded AS MATERIALIZED (
  SELECT l.*, w * (0.5::DOUBLE - y) AS g, w * 0.25::DOUBLE AS h
  FROM (SELECT *, CASE WHEN y = 1 THEN {_POSITIVE} ELSE 1 END AS w FROM long) l)"""


def _strength(g: str, h: str) -> str:
    return f"pow(greatest(abs({g}) - {_L1}::DOUBLE, 0), 2) / ({h} + {_L2}::DOUBLE)"


def _gains(source: str, by: str) -> str:
    """Gain of every allowed cut of every node in ``by`` over graded rows."""
    return f"""
  SELECT *, {_strength('gl', 'hl')} + {_strength('g_all - gl', 'h_all - hl')} - {_strength('g_all', 'h_all')} AS gain
  FROM (SELECT {by}feature, c, cut, coalesce(sum(g) FILTER (x < cut), 0) AS gl, coalesce(sum(h) FILTER (x < cut), 0) AS hl,
      sum(g) AS g_all, sum(h) AS h_all FROM {source} JOIN cuts USING (feature) GROUP BY {by}feature, c, cut)
  WHERE hl >= {_CHILD} - 1e-9 AND h_all - hl >= {_CHILD} - 1e-9"""


def _ratio_matrix(spark, sf_dir):
    train, _, pre = trained_matrix(spark, sf_dir)
    return cached(with_class_weights(train, LABEL, "ratio", "ratio")), pre


def _edges(arrays, width):
    return boosting.even_edges(arrays, width, _CUTS)


@query(
    "boosted_split_gains",
    sql.using(
        "matrix",
        f"""SELECT feature, c AS cut, round(gl, 6) AS gradient_below, round(hl, 6) AS hessian_below, round(gain, 6) AS gain
        FROM ({_gains('graded', '')})""",
        _LONG,
        _GRADIENTS,
    ),
)
def boosted_split_gains(spark, sf_dir):
    """Gradient and hessian sums below every cut of the first root, and what the split would gain."""
    train, pre = _ratio_matrix(spark, sf_dir)
    found = boosting.first_gains(
        train, LABEL, "ratio", l1=_L1, l2=_L2, child_weight=_CHILD, edges=_edges
    )
    names = pre.feature_names()
    rows = [(names[j], c, g, h, gain) for j, c, g, h, gain in found]
    schema = "feature string, cut int, gradient_below double, hessian_below double, gain double"
    return rounded(spark.createDataFrame(rows, schema))


_BEST = f"QUALIFY row_number() OVER (PARTITION BY {{by}} ORDER BY round(gain, 7) DESC, {_ORDER}, c) = 1"
_LEAF = f"round(-sign({{g}}) * greatest(abs({{g}}) - {_L1}::DOUBLE, 0) / ({{h}} + {_L2}::DOUBLE) * {_RATE}::DOUBLE, 6)"


@query(
    "boosted_first_tree",
    sql.using(
        "matrix",
        f"""SELECT '' AS path, feature, round(cut, 6) AS cut, NULL::DOUBLE AS value FROM root
        UNION ALL SELECT path, feature, round(cut, 6), NULL FROM inner_nodes
        UNION ALL SELECT path || 'L', NULL, NULL, {_LEAF.format(g='gl', h='hl')} FROM inner_nodes
        UNION ALL SELECT path || 'R', NULL, NULL, {_LEAF.format(g='(g_all - gl)', h='(h_all - hl)')} FROM inner_nodes
        UNION ALL SELECT path, NULL, NULL, {_LEAF.format(g='sum(g)', h='sum(h)')}
          FROM sided WHERE feature = '{sql.FEATURES[0]}' AND path NOT IN (SELECT path FROM inner_nodes) GROUP BY path""",
        _LONG,
        _GRADIENTS,
        f"""
root AS MATERIALIZED (SELECT * FROM ({_gains('graded', '')}) WHERE gain > 1e-9 {_BEST.format(by='1')}),
sided AS MATERIALIZED (
  SELECT d.*, CASE WHEN s.x < root.cut THEN 'L' ELSE 'R' END AS path
  FROM root JOIN graded s ON s.feature = root.feature JOIN graded d ON d.CustomerID = s.CustomerID),
inner_nodes AS MATERIALIZED (SELECT * FROM ({_gains('sided', 'path, ')}) WHERE gain > 1e-9 {_BEST.format(by='path')})""",
    ),
)
def boosted_first_tree(spark, sf_dir):
    """Splits and leaf values of the first tree, two levels deep."""
    train, pre = _ratio_matrix(spark, sf_dir)
    model = boosting.boost(
        train, LABEL, "ratio", rounds=1, rate=_RATE, depth=2, l1=_L1, l2=_L2, child_weight=_CHILD, edges=_edges
    )
    nodes, names, rows = model.nodes()[0], pre.feature_names(), []
    todo = [(0, "")]
    while todo:
        at, path = todo.pop()
        feature, cut, left, right, value = nodes[at]
        inner = feature >= 0
        rows.append((path, names[feature] if inner else None, cut if inner else None, None if inner else value))
        todo += [(left, path + "L"), (right, path + "R")] if inner else []
    return rounded(spark.createDataFrame(rows, "path string, feature string, cut double, value double"))


def _ada_round(r: int) -> str:
    """Best stump of round ``r`` and the weights of the next one."""
    pure = "(pow({a}, 2) + pow({b} - {a}, 2)) / {b}"
    return f"""
stump{r} AS MATERIALIZED (
  SELECT *, (CASE WHEN 2 * pl > ml THEN ml - pl ELSE pl END
    + CASE WHEN 2 * (p - pl) > m - ml THEN m - ml - (p - pl) ELSE p - pl END) / m AS error
  FROM (SELECT feature, c, cut, coalesce(sum(w * y) FILTER (x < cut), 0) AS pl, coalesce(sum(w) FILTER (x < cut), 0) AS ml,
      sum(w * y) AS p, sum(w) AS m FROM long JOIN w{r} USING (CustomerID) JOIN cuts USING (feature) GROUP BY ALL)
  WHERE ml > 1e-12 AND m - ml > 1e-12
  QUALIFY row_number() OVER (ORDER BY
    round({pure.format(a='pl', b='ml')} + {pure.format(a='(p - pl)', b='(m - ml)')}, 6) DESC, {_ORDER}, c) = 1),
w{r + 1} AS MATERIALIZED (
  SELECT CustomerID, w * CASE WHEN (CASE WHEN x < cut THEN 2 * pl > ml ELSE 2 * (p - pl) > m - ml END) != (y = 1)
    THEN pow((1 - error) / error, {_ADA_RATE}::DOUBLE) ELSE 1 END AS w
  FROM long JOIN w{r} USING (CustomerID) JOIN stump{r} s USING (feature))"""


@query(
    "adaboost_rounds",
    sql.using(
        "matrix",
        " UNION ALL ".join(
            f"""SELECT {r}::INT AS round, feature, round(cut, 6) AS cut, round(error, 6) AS error,
            round({_ADA_RATE}::DOUBLE * ln((1 - error) / error), 6) AS alpha FROM stump{r}"""
            for r in (1, 2, 3)
        ),
        _LONG,
        "\nw1 AS (SELECT CustomerID, 1::DOUBLE AS w FROM wide)",
        *[_ada_round(r) for r in (1, 2, 3)],
    ),
)
def adaboost_rounds(spark, sf_dir):
    """Stump, error and say of the first three rounds."""
    train, _, pre = trained_matrix(spark, sf_dir)
    _, said = boosting.stumps(cached(train), LABEL, rounds=3, rate=_ADA_RATE, edges=_edges)
    names = pre.feature_names()
    rows = [(i, names[j], cut, error, alpha) for i, (j, cut, error, alpha) in enumerate(said, 1)]
    return rounded(spark.createDataFrame(rows, "round int, feature string, cut double, error double, alpha double"))

