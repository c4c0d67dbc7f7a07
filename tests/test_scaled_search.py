"""Encoding in batches, the best hits over blocks, and what a search in rounds ships."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternpost.functions import vectors
from lanternpost.functions.text import SPACE_CHARS
from lanternpost.operators import knowledge, scoring, vector_index
from lanternpost.sources.storage import shared_folder

TEXTS = ["", None, "   ", "One two  two\tONE\n", "ÀÉ straße İstanbul ΣΑΣ 🙂 🙂", SPACE_CHARS.join("abc"), "x" * 5000, " ".join(f"w{i % 97}" for i in range(3000))]


def test_batches_encode_like_the_expression(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 3)], "i int, t string").coalesce(1)
    for step in (5, 1024):
        monkeypatch.setattr(vectors, "ENCODED_ROWS", step)
        for dim in (64, 7):
            both = rows.select(vectors.encoded(F.col("t"), dim).alias("a"), vectors.encoded_in_batches(F.col("t"), dim).alias("b")).collect()
            assert [r["a"] for r in both] == [r["b"] for r in both]


def test_digests_of_many_words_are_those_of_each():
    import hashlib

    import pyarrow as pa

    rng = np.random.default_rng(2)
    words = [rng.bytes(i % 140) for i in range(9000)]
    column = pa.array(words, pa.binary()).slice(1)
    assert vectors.digest_heads(column).tolist() == [int(hashlib.md5(w).hexdigest()[:8], 16) for w in words[1:]]
    assert vectors.digest_heads(pa.array([b"", b""], pa.large_binary())).tolist() == [0xD41D8CD9] * 2


def test_an_index_lists_its_folders_once(spark, monkeypatch):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))]) for i in range(60)]
    made = vector_index.build(spark.createDataFrame(rows, "id int, v array<double>"), shared_folder(spark, "index"), "id", "v")
    assert made.table() is made.table()
    opened = vector_index.VectorIndex(spark, made.path)
    assert opened.table() is opened.table()
    assert sorted(opened.table().select("id").collect()) == sorted(made.table().select("id").collect())


@pytest.mark.parametrize("strings", [False, True])
def test_best_over_blocks_equals_a_full_sort(monkeypatch, strings):
    monkeypatch.setattr(scoring, "PENDING", 50)
    monkeypatch.setattr(scoring, "KB_STEP", 16)
    rng = np.random.default_rng(3)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    kb = unit(rng.normal(size=(400, 6)))
    kb[100:250] = kb[3]
    near = unit(kb[:150] + rng.normal(scale=1e-8, size=(150, 6)))
    kb = np.vstack([kb, near])
    ids = rng.permutation(len(kb))
    ids = np.array([f"d{i:04d}" for i in ids], object) if strings else ids
    q = np.vstack([unit(rng.normal(size=(30, 6))), kb[:8], np.zeros((1, 6))])
    reached = np.where(np.arange(len(q)) % 3 == 0, 0.5, -2.0)
    best = scoring.Best(q, 7, reached, 8)
    for at in range(0, len(kb), 90):
        best.add(ids[at : at + 90], kb[at : at + 90])
    rows, found, sims = best.hits()
    exact = np.round(q @ kb.T, scoring.DIGITS) + 0.0
    for r in range(len(q)):
        want = sorted((-s, i) for s, i in zip(exact[r], ids) if s >= reached[r])[:7]
        got = [(-s, i) for s, i in zip(sims[rows == r], found[rows == r])]
        assert [i for _, i in got] == [i for _, i in want]


@pytest.mark.parametrize("shape", [(0, 5), (1, 1), (3, 7), (8, 8), (5, 511), (64, 100)])
def test_places_of_hits(shape):
    for share in (0, 0.01, 0.5, 1):
        hit = np.random.default_rng(1).random(shape) < share
        assert scoring.true_places(hit).tolist() == np.flatnonzero(hit).tolist()


def test_a_row_carries_its_chunk_and_not_all_of_its_text(spark):
    source = spark.createDataFrame([(1, " ".join(f"w{i}." for i in range(700)))], "doc_id long, output string")
    rows = knowledge.chunk_rows(source, intent_col=None, concern_col=None)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    passed_on = re.search(r"Generate posexplode\(__pieces#\d+\), \[([^]]*)\]", plan).group(1)
    assert "n_pieces" in passed_on and "__pieces" not in passed_on
    assert rows.count() == 5


def test_the_encoder_runs_once_for_a_row_of_the_index(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def encode(i):
        seen.add(1)
        return None if i % 10 == 0 else [float(i), 1.0]

    rows = spark.range(200).select("id", encode("id").alias("v"))
    index = vector_index.build(rows, shared_folder(spark, "index"), "id", "v")
    assert seen.value == 200 and index.table().count() == 180


def test_a_vector_goes_once_to_a_block_not_to_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 16)))], "id long, v array<double>")
    index = vector_index.build(rows, shared_folder(spark, "index"), "id", "v")
    shipped, visited = [], []
    meet = vector_index.VectorIndex._meet

    def counted(self, visits, counts, k, schema):
        shipped.append(visits.table.count())
        visited.append(sum(counts.values()))
        return meet(self, visits, counts, k, schema)

    monkeypatch.setattr(vector_index.VectorIndex, "_meet", counted)
    hits = index.search(rows.limit(200), 5, query_id="id", query_vector="v")
    assert hits.count() == 1000 and len(index.cells) >= 25
    assert sum(visited) > 15 * 200 and sum(shipped) <= 2 * 200


def test_a_first_round_goes_to_one_block(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "LEAST_BLOCK", 64)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(900, 12))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<double>")
    index = vector_index.build(rows, shared_folder(spark, "index"), "id", "v")
    shipped = []
    meet = vector_index.VectorIndex._meet

    def counted(self, visits, counts, k, schema):
        shipped.append((visits.table.count(), len(visits.blocks.starts)))
        return meet(self, visits, counts, k, schema)

    monkeypatch.setattr(vector_index.VectorIndex, "_meet", counted)
    got = {}
    for r in index.search(rows, 4, query_id="id", query_vector="v").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["kb_id"])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, scoring.DIGITS)
    assert got == {i: np.lexsort((np.arange(900), -sims[i]))[:4].tolist() for i in range(900)}
    assert len(shipped) == 2 and shipped[0][1] > 4 and shipped[0][0] == 900


def test_near_centroids_stand_together():
    rng = np.random.default_rng(7)
    m = np.repeat(rng.normal(size=(8, 5)), 16, axis=0) + rng.normal(scale=0.01, size=(128, 5))
    m = m[rng.permutation(128)]
    order = vector_index.side_by_side(m)
    assert sorted(order.tolist()) == list(range(128))
    steps = np.linalg.norm(np.diff(m[order], axis=0), axis=1)
    assert (steps > 0.2).sum() <= 14
    assert len(vector_index.side_by_side(np.zeros((0, 3)))) == 0
