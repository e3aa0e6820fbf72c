"""Hard negatives against scoring every row, and the tree's bounds against the distances they stand for."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactus.llm import hard_negatives as hn


def _mined(rows, positives=5, negatives=3):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        out = [math.floor(256 * x) for x in v]
        return None if any(abs(x) >= 1 << 23 for x in out) else out

    live = [(i, lab, e) for i, lab, v in rows if i is not None and lab is not None and (e := ints(v)) is not None]
    out = Counter()
    for i, lab, e in live:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(e, f, strict=False)), j, other) for j, other, f in live if j != i]
        for s, j, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            fits = sorted((t, n) for t, n, other in scored if other != lab and 50 * -s <= 100 * -t <= 95 * -s)[:negatives]
            out.update((i, j, rank + 1, n, -s, -t) for rank, (t, n) in enumerate(fits))
    return out


def _rows(rng, n, size, groups):
    centres = rng.standard_normal((groups, size))
    x = centres[rng.integers(0, groups, n)] + 0.3 * rng.standard_normal((n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(int(i) * 5, int(rng.integers(0, 4)), [float(v) for v in x[i]]) for i in range(n)]


def _ran(spark, rows, **kw):
    table = spark.createDataFrame([(*r, "x", None) for r in rows], "vec_id long, label int, embedding array<double>, row string, query string")
    found = hn.hard_negatives(table.repartition(3), F.col("vec_id") % 50 == 0, **kw)
    return Counter(map(tuple, found.collect()))


@pytest.mark.parametrize(("size", "groups", "tile", "lot"), [(3, 6, 12, 7), (16, 5, 25, 400), (64, 400, 1500, 400)])
def test_hard_negatives(spark, monkeypatch, size, groups, tile, lot):
    monkeypatch.setattr(hn, "TILE", tile)
    monkeypatch.setattr(hn, "LOT", lot)
    rows = _rows(np.random.default_rng(size), 400, size, groups)
    expected = _mined(rows)
    assert sum(expected.values()) > 40
    assert _ran(spark, rows) == expected


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(hn, "TILE", 10)
    rows = _rows(np.random.default_rng(5), 120, 4, 3)
    same = rows[10]
    rows += [(1000 + i, i % 2, same[2]) for i in range(60)]  # equal vectors of two labels: all scores tie
    rows += [(50, 1, rows[0][2]), (50, 1, rows[0][2]), (7, 1, rows[3][2]), (7, 1, rows[3][2])]  # repeated ids and rows
    rows += [(2000, None, same[2]), (None, 1, same[2]), (2050, 1, None), (2100, 1, [1.0, None, 0.0, 0.0])]
    rows += [(2150, 1, [math.nan] * 4), (2200, 1, [math.inf, 0.0, 0.0, 0.0]), (2250, 1, [1e300, 0.0, 0.0, 0.0])]
    rows += [(2300, 1, []), (2350, 2, [0.0] * 4), (2400, 2, [0.9, 0.1]), (2450, 3, [-1.0, -1.0, -1.0, -1.0])]
    expected = _mined(rows)
    assert any(a == 50 for a, *_ in expected)
    assert _ran(spark, rows) == expected


def test_few_rows_and_empty_tables(spark):
    assert not _ran(spark, [])
    assert not _ran(spark, [(50, 1, [1.0, 0.0])])
    rows = [(50, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.0]), (3, 2, [1.0, 0.0]), (4, None, [0.8, 0.0])]
    assert _ran(spark, rows) == Counter({(50, 1, 1, 2, 65536, 58880): 1})


def test_hundredths():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    values = [-(10**17), -201, -200, -199, -1, 0, 1, 99, 100, 101, 10**17 + 1]
    rows = spark.createDataFrame([(v,) for v in values], "x long").select("x", hn._floor(F.col("x")), hn._ceiling(F.col("x"))).collect()
    assert [(lo, up) for _, lo, up in rows] == [(v // 100, -(-v // 100)) for v in values]


@pytest.mark.parametrize("size", [2, 5, 32])
def test_tree_passes_by_only_what_cannot_match(size):
    rng = np.random.default_rng(size)
    x = np.floor(256 * rng.standard_normal((800, size)))
    radius = float(np.sqrt((x**2).sum(1).max()))
    tree = hn.fit(x[:400], radius, 10)
    lifted = tree.lift(x)
    leaf = hn._routed(tree, lifted, lambda node, j, d: (np.minimum(node.near[:, j], d.min(0), out=node.near[:, j]), np.maximum(node.far[:, j], d.max(0), out=node.far[:, j])))
    assert tree.leaves > 8 and set(leaf) <= set(range(tree.leaves))
    queries = x[::40]
    scores = queries @ x.T
    order = np.sort(scores, axis=1)
    low, high = order[:, -12], order[:, -3]
    square = radius**2 + (queries**2).sum(1)
    which, where = hn.reached(tree, queries, np.sqrt(np.maximum(square - 2 * high, 0)), np.sqrt(np.maximum(square - 2 * low, 0)))
    visited = set(zip(which.tolist(), where.tolist(), strict=True))
    for q in range(len(queries)):
        for i in np.flatnonzero((scores[q] >= low[q]) & (scores[q] <= high[q])):
            assert (q, int(leaf[i])) in visited
    if size == 2:
        assert len(visited) < 0.5 * len(queries) * tree.leaves
