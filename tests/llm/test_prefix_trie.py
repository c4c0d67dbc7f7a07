"""Prefix trie against a brute-force tree; long, turnless, repeated and hot conversations."""

import hashlib
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternpost.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos string, k string, depth int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """``convs``: conversation to its list of (role, text)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, below = {}, {p: [0, 0] for p in members}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            below[p[:d]][0] += p not in kids
            below[p[:d]][1] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids.get(p, 0), *below[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def built(spark, rows, graft=False):
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(5)
    turns = prefix_trie.storage.stored(prefix_trie.ordered_turns(table, "conv_id", "turn", "role", "text"), "ordered")
    convs = turns.select("conv").distinct()
    nodes = prefix_trie.trie(prefix_trie.grafted(turns, convs) if graft else turns, convs)
    return sorted(tuple(-1 if v is None else v for v in r) for r in nodes.select(*COLUMNS).collect())


def rows_of(convs):
    return [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]


def conversations():
    said = [("user", "hi"), ("assistant", "hello"), ("user", "é🙂"), ("", "")]
    convs = {c: [said[(c >> (2 * i)) % 4] for i in range(c % 7 + 1)] for c in range(60)}
    convs |= {100 + c: said * 3 + [("user", str(c % 5))] * (c % 4) for c in range(40)}
    convs |= {200 + c: said[:2] for c in range(300)}
    convs[600] = [("user", str(i)) for i in range(300)]
    convs |= {601 + i: convs[600][: 20 * i + 1] + [("user", "leaves")] * (i % 3) for i in range(14)}
    return convs


def test_equals_brute_force(spark):
    convs = conversations()
    assert built(spark, rows_of(convs)) == brute(convs)


def test_grafted_conversations(spark):
    convs = {c: t for c, t in conversations().items() if c not in (100, 200)}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    assert any(not t for t in rebuilt.values())
    assert built(spark, rows_of(convs), graft=True) == brute(rebuilt)


def test_order_nulls_and_repeated_rows(spark):
    rows = [(1, 1, "user", "b"), (1, None, None, "a"), (1, 2, "user", None), (None, 0, "user", "lost"), (2, 5, "", "a"), (2, 9, "user", "b"), (2, 9, "user", "b")]
    convs = {1: [("", "a"), ("user", "b"), ("user", "")], 2: [("", "a"), ("user", "b"), ("user", "b")]}
    assert built(spark, rows) == brute(convs)


def test_role_and_text_do_not_run_together(spark):
    convs = {1: [("user", "1:x")], 2: [("user1", ":x")], 3: [("use", "r1:x")]}
    assert built(spark, rows_of(convs)) == brute(convs)


def test_very_long_text_and_empty_table(spark):
    convs = {7: [("user", "long " * 400_000)], 8: [("user", "long " * 400_000)]}
    assert built(spark, rows_of(convs)) == brute(convs)
    assert built(spark, []) == []


def test_many_members_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_BYTES", 40)
    convs = {c: [("user", "same")] for c in range(500)}
    assert built(spark, rows_of(convs)) == brute(convs)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 500), st.lists(st.sampled_from([("u", "a"), ("u", "b"), ("a", "a")]), min_size=1, max_size=10), min_size=1, max_size=30))
def test_random_tries(spark, convs):
    assert built(spark, rows_of(convs)) == brute(convs)


@pytest.mark.parametrize("text", ["a", ""])
def test_one_turn(spark, text):
    assert built(spark, [(5, 0, "user", text)]) == brute({5: [("user", text)]})


def test_block_digests_tell_blocks_apart(spark):
    turns = spark.range(9).select(F.lit(1).alias("conv"), (F.col("id") + 1).alias("pos"), F.unhex(F.lit("00" * 32)).alias("digest"), F.lit(1).alias("size"))
    keys = prefix_trie._keyed(prefix_trie._blocks(turns)).collect()
    assert len(keys) == 3 == len({bytes(r["key"]) for r in keys}) and {r["m"] for r in keys} == {4, 1}
