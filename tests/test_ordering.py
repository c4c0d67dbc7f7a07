"""Distributed numbering and running sums against plain Python, with skewed groups."""

import random
from itertools import accumulate

from lanternpost.operators import ordering


def test_row_numbers_of_strings_and_groups(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(10**9):09d}", "hot" if i % 3 else f"g{i % 7}") for i in range(900)]
    df = spark.createDataFrame(rows, "key string, grp string").repartition(5)
    got = {r["key"]: r["n"] for r in ordering.with_row_number(df, "key", "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(k for k, _ in rows), 1)}
    inside = ordering.with_row_number(df, "key", "n", within=["grp"]).collect()
    for g in {g for _, g in rows}:
        keys = sorted(k for k, x in rows if x == g)
        assert {r["key"]: r["n"] for r in inside if r["grp"] == g} == {k: i for i, k in enumerate(keys, 1)}


def test_running_sums_both_ways(spark):
    rows = [("a", i / 7, i % 3) for i in range(500)] + [("b", 1.0, 5)]
    df = spark.createDataFrame(rows, "g string, x double, v long").repartition(4)
    for down in (False, True):
        got = ordering.with_running_sums(df, "x", {"s": "v"}, ["g"], descending=down).collect()
        line = sorted([r for r in rows if r[0] == "a"], reverse=down)
        want = dict(zip([r[1] for r in line], accumulate(r[2] for r in line)))
        assert {r["x"]: r["s"] for r in got if r["g"] == "a"} == want


def test_empty_and_single(spark):
    df = spark.createDataFrame([(5,)], "key long")
    assert [r["n"] for r in ordering.with_row_number(df, "key", "n").collect()] == [1]
    assert ordering.with_row_number(df.where("key < 0"), "key", "n").count() == 0


def test_no_global_window(spark):
    df = spark.range(1000).withColumnRenamed("id", "key")
    plan = ordering.with_row_number(df, "key", "n")._jdf.queryExecution().executedPlan().toString()
    rows = [line for line in plan.splitlines() if "row_number()" in line]
    assert rows and all("__range" in line for line in rows)
