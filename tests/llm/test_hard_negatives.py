"""Hard negatives against brute force; ties, hot copies, odd vectors and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternpost.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, id string, cell string, rank int"


def brute(rows, positives=5, negatives=5):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) or abs(x) * 256 > 2**24 for x in v):
            continue
        ints = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        best[i] = min(best.get(i, (label, ints)), (label, ints))
    out = set()
    for a, (label, av) in best.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, bv)), b, bl) for b, (bl, bv) in best.items() if b != a and len(bv) == len(av))
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(n, -ns) for ns, n, nl in scored if nl != label and 80 * -ps <= 100 * -ns <= 100 * -ps]
            out |= {(a, p, r, n, -ps, s) for r, (n, s) in enumerate(fit[:negatives], 1)}
    return out


def mined(spark, rows, **kw):
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(7)
    found = hn.mine(hn.scaled_rows(table, "vec_id", "embedding", F.col("label")), F.col("id") % 100 == 0, **kw).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def clustered(rng, n, dim=12, hot=0):
    centres = rng.normal(size=(6, dim))
    rows = [(i, (centres[i % 6] + rng.normal(size=dim) * 0.4).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    return rows + [(n + i, rows[0][1], i % 3) for i in range(hot)]


def test_equals_brute_force_with_hot_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = clustered(rng, 900, hot=400)
    zero, nan = [0.0] * 12, [float("nan")] + [1.0] * 11
    rows += [(5000, zero, 1), (5100, zero, 0), (5200, [1.0, 2.0], 1), (5201, [1.0, 2.0], 1), (5202, [1.0, 1.9], 0), (5300, None, 1), (5400, [], 1)]
    rows += [(5500, nan, 0), (5501, [None] + [1.0] * 11, 0), (5600, rows[3][1], None), (None, rows[3][1], 1), (5700, [1e30] * 12, 1)]
    rows += [rows[100], rows[100], (200, rows[7][1], 2), (200, rows[8][1], 0)]
    assert mined(spark, rows) == brute(rows)


def test_many_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_ROWS", 64)
    monkeypatch.setattr(hn, "SLICE_ROWS", 2)
    rows = clustered(np.random.default_rng(4), 1200)
    assert mined(spark, rows, positives=3, negatives=4) == brute(rows, 3, 4)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i * 50, (rng.normal(size=8) * 60000).clip(-65000, 65000).astype(np.float32).tolist(), i % 2) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_no_anchors_no_partners_no_rows(spark):
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == set()
    assert mined(spark, [(100, [1.0], 0)]) == set()
    assert mined(spark, []) == set()


def test_walk_leaves_early():
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(5000, 16)) * 20 + np.r_[200, [0] * 15]).astype(np.int64)
    x[4000:] *= -1
    seen = []
    tops = hn.Tops(np.full(1, hn.LEAST), 5)
    scores = hn._scores
    try:
        hn._scores = lambda a, b: seen.append(len(b)) or scores(a, b)
        anchors = {"x": x[:1], "id": np.array([-1]), "label": np.array([0]), "top": np.array([hn.NEVER - 1])}
        hn.walk(anchors, {"x": x, "id": np.arange(5000), "label": np.zeros(5000, np.int64)}, hn._unit(x[:1])[0][0], tops, 1, True)
    finally:
        hn._scores = scores
    exact = np.lexsort((np.arange(5000), -(x @ x[0])))[:5]
    assert tops.id.tolist() == exact.tolist()
    assert sum(seen) < 2500


def test_centroids_are_units_and_bounded():
    rng = np.random.default_rng(7)
    c = hn.fit_centroids(rng.integers(-50, 50, (300, 9)), 8)
    assert c.shape == (8, 9) and np.allclose((c * c).sum(axis=1), 1)
    assert hn.fit_centroids(np.zeros((4, 3), np.int64), 8).shape == (1, 3)


@pytest.mark.parametrize("keep", [1, 3])
def test_tops_breaks_ties_by_id(keep):
    tops = hn.Tops(np.full(2, hn.LEAST), keep)
    tops.add(np.array([0, 0, 1]), np.array([9, 4, 2]), np.array([7, 7, 1]))
    tops.add(np.array([0, 0]), np.array([1, 8]), np.array([7, 9]))
    assert tops.id[tops.lane == 0].tolist() == [8, 1, 4][:keep]
