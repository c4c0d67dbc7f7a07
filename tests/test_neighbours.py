"""Both neighbour plans against a full sort, with dense cells, ties and zero vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternpost.operators import neighbours, vector_index


def brute(queries, kb, k, floor=None):
    out = {}
    for qid, q in queries:
        sims = []
        for kid, v in kb:
            size = np.linalg.norm(q) * np.linalg.norm(v)
            sims.append((-(round(float(np.dot(q, v) / size), 9) if size else 0.0), kid))
        sims.sort()
        out[qid] = [(kid, -s) for s, kid in sims[:k] if floor is None or -s >= floor]
    return out


def run(spark, queries, kb, k, plan, id_type="long", **options):
    schema = f"id {id_type}, v array<double>"
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries], schema).repartition(3)
    b = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in kb], schema).repartition(4)
    hits = neighbours.nearest(q, b, k, query_id="id", query_vector="v", kb_id="id", kb_vector="v", plan=plan, **options)
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["kb_id"], r["similarity"]))
    return out


def same(got, want):
    want = {k: v for k, v in want.items() if v}
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in v] for k, v in want.items()}
    for k in want:
        np.testing.assert_allclose([s for _, s in got[k]], [s for _, s in want[k]], atol=2e-9)


@pytest.fixture
def data():
    rng = np.random.default_rng(5)
    dense = rng.normal(size=6) + rng.normal(scale=0.01, size=(120, 6))  # a third of the rows in one spot
    spread = rng.normal(size=(200, 6))
    copies = np.repeat(spread[:1], 30, axis=0)
    zeros = np.zeros((5, 6))
    kb = list(enumerate(np.vstack([dense, spread, copies, zeros]), 10))
    queries = list(enumerate(np.vstack([rng.normal(size=(25, 6)), dense[:5], zeros[:1]])))
    return queries, kb


@pytest.mark.parametrize("plan", ["broadcast", "cells"])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_equals_full_sort(spark, data, plan, k):
    queries, kb = data
    same(run(spark, queries, kb, k, plan), brute(queries, kb, k))


@pytest.mark.parametrize("plan", ["broadcast", "cells"])
def test_floor(spark, data, plan):
    queries, kb = data
    same(run(spark, queries, kb, 9, plan, floor=0.4), brute(queries, kb, 9, 0.4))


@pytest.mark.parametrize("plan", ["broadcast", "cells"])
def test_small_blocks_and_string_ids(spark, data, plan, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "QUERY_STEP", 4)
    queries = [(f"q{i:03d}", v) for i, v in data[0]]
    kb = [(f"d{i:03d}", v) for i, v in data[1]]
    same(run(spark, queries, kb, 6, plan, "string"), brute(queries, kb, 6))


def test_all_zero_knowledge_base(spark):
    queries, kb = [(1, [1.0, 0.0]), (2, [0.0, 0.0])], [(i, [0.0, 0.0]) for i in range(4)]
    for plan in ("broadcast", "cells"):
        same(run(spark, queries, kb, 2, plan), brute(queries, kb, 2))


def test_no_pair_table_in_plan(spark, data):
    queries, kb = data
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in kb], "id long, v array<double>")
    for plan in ("broadcast", "cells"):
        hits = neighbours.nearest(q, q, 3, query_id="id", query_vector="v", kb_id="id", kb_vector="v", plan=plan)
        text = hits._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_auto_picks_by_size(spark, monkeypatch):
    q = spark.range(10).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("v"))
    hit = dict(query_id="id", query_vector="v", kb_id="id", kb_vector="v")
    monkeypatch.setattr(neighbours, "BROADCAST_BYTES", 1)
    built = []
    build = neighbours.build
    monkeypatch.setattr(neighbours, "build", lambda *a, **k: built.append(1) or build(*a, **k))
    assert neighbours.nearest(q, q, 2, **hit).count() == 20 and built
