"""Exact searches over integer vectors against plain Python."""

import math
import random

import numpy as np
import pytest

from propensa.llm import negatives, topk, vectors

LIMIT = (1 << 63) - 1


def whole(v, scale):
    return [min(max(math.floor(float(np.float32(x)) * scale), -LIMIT - 1), LIMIT) for x in v]


def taking_part(rows, scale):
    out = []
    for r in rows:
        v = r[1]
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            out.append((r[0], whole(v, scale), *r[2:]))
    return out


def inner(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -LIMIT - 1), LIMIT)


def by_rank(found):
    """Highest score first, then the smaller id, null last."""
    return sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))


def plain_search(rows, k=10, every=100, scale=1024):
    rows = taking_part(rows, scale)
    out = []
    for i, (q, v, *_) in enumerate(rows):
        if q is not None and q % every == 0:
            found = by_rank([(c, inner(v, u)) for j, (c, u, *_) in enumerate(rows) if j != i])[:k]
            out += [(q, r, c, s) for r, (c, s) in enumerate(found, 1)]
    return sorted(out, key=repr)


def plain_negatives(rows, positives=5, wanted=10):
    rows = [(i, v, (y + 1) % 10 if i is not None and i % 7 == 0 else y) for i, v, y in taking_part(rows, 256) if y is not None]
    out = []
    for a, (q, v, y) in enumerate(rows):
        if q is None or q % 100:
            continue
        near = by_rank([(c, inner(v, u)) for b, (c, u, z) in enumerate(rows) if b != a and z == y])[:positives]
        for p, s in near:
            hard = [(c, inner(v, u)) for c, u, z in rows if z != y and 30 * s <= 100 * inner(v, u) <= 90 * s]
            out += [(q, p, r, c, s, t) for r, (c, t) in enumerate(by_rank(hard)[:wanted], 1)]
    return sorted(out, key=repr)


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def searched(spark, rows, schema=SCHEMA, **how):
    found = topk.search(spark.createDataFrame(rows, schema).repartition(3), **how)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def mined(spark, rows, schema=SCHEMA):
    found = negatives.hard_negatives(spark.createDataFrame(rows, schema).repartition(3))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def table(n=400, d=9, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(scale=0.2, size=(n, d)).round(2)
    return [(i * 5, [float(x) for x in v[i]], int(rng.integers(0, 4))) for i in range(n)]


def awkward():
    rows = table(120, 4)
    rows += [(100, [0.5, 0.5, 0.0, 0.0], 1), (100, [0.5, 0.5, 0.0, 0.0], 1), (100, [1.0, 0.0, 0.0, 0.0], 2)]
    rows += [(None, [0.9, 0.9, 0.9, 0.9], 1), (None, [0.9, 0.9, 0.9, 0.9], 2), (700, None, 1), (800, [0.1, None], 1)]
    rows += [(900, [float("nan")], 1), (1000, [float("inf"), 0.0], 1), (1100, [0.1, 0.2, 0.3, 0.4], None)]
    # Ties over many ids, an empty vector, a short and a long one.
    rows += [(i, [0.25, 0.25, 0.25, 0.25], i % 3) for i in range(2001, 2060)]
    rows += [(3000, [], 0), (3100, [0.5], 0), (3200, [0.1] * 7, 0)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [table(), awkward()], ids=["plain", "awkward"])
def test_search_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "PROBES", 2)
    monkeypatch.setattr(vectors, "LEAST_ROWS", 50)
    assert searched(spark, rows) == plain_search(rows)


@pytest.mark.parametrize("rows", [table(), awkward()], ids=["plain", "awkward"])
def test_negatives_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(negatives, "LEAF", 2)
    monkeypatch.setattr(negatives, "CANDIDATES", 37)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    monkeypatch.setattr(vectors, "LEAST_ROWS", 50)
    assert mined(spark, rows) == plain_negatives(rows)


def test_huge_components(spark):
    rows = [(100 * i, [s * x, 1.0], i % 2) for i, (s, x) in enumerate([(1, 3e38), (-1, 3e38), (1, 1e17), (1, 2.0), (-1, 5e12)])]
    assert searched(spark, rows) == plain_search(rows)
    mined(spark, rows)


def test_tables_without_rows(spark):
    assert searched(spark, []) == [] and mined(spark, []) == []
    assert searched(spark, [(100, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1)]) == []


def test_other_columns_play_no_part(spark):
    wide = [(*r, 1, 2.0, "x", 4) for r in table(60)]
    schema = SCHEMA + ", id int, score double, qid string, rank int"
    assert searched(spark, wide, schema) == plain_search(table(60))
    assert mined(spark, wide, schema) == plain_negatives(table(60))


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 64, 100), (17, 65, 31), (40, 0, 20), (0, 5, 3)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    a = rng.integers(-(1 << 20), 1 << 20, shape[:2])
    b = rng.integers(-(1 << 20), 1 << 20, shape[1:])
    got = negatives.product(a, b)
    assert got.dtype == np.int64 and (got == a @ b).all()


def test_strassen_cuts(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 1)
    rng = np.random.default_rng(1)
    a, b = rng.integers(-9, 9, (13, 7)), rng.integers(-9, 9, (7, 11))
    assert (negatives.product(a, b) == a @ b).all()


def test_maxscore_skips_rows_that_cannot_compete():
    rng = np.random.default_rng(7)
    values = np.where(rng.random((2_000, 40)) < 0.05, rng.integers(1, 50, (2_000, 40)), 0)
    values[:, 0] = np.where(np.arange(2_000) < 5, 4_000, 0)
    block = topk.Postings(values)
    query = np.r_[10, np.ones(39, dtype=int)]
    scores = values @ query
    kth = np.sort(scores)[-4]
    rows, found = block.above(query, kth)
    assert sorted(rows) == sorted(np.flatnonzero(scores > kth)) and (found == scores[rows]).all()
    bounds = block.bounds(query)
    assert (np.cumsum(np.sort(bounds)) <= kth).sum() >= 30, "terms that are not essential"
    assert not len(block.above(query, bounds.sum())[0])
    for least in (-5, 0, None):
        rows, found = block.above(query, least)
        assert (found == scores[rows]).all()
        assert len(rows) == (2_000 if least is None else (scores > least).sum())


def test_heaps_keep_the_first_of_equal_scores():
    heap = negatives.Heap(3)
    for start, part in ((0, [5, 5]), (2, [5, 5]), (4, [9, 5])):
        heap.add(np.array(part), np.arange(start, start + len(part)))
    assert heap.scores.tolist() == [9, 5, 5] and heap.places.tolist() == [4, 0, 1]
