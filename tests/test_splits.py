"""Split sizes, coverage and balance; sampling."""

import math
from collections import Counter

import pytest

from lanternpost.operators import splits


def largest_remainder(counts, drawn):
    total = sum(counts.values())
    exact = {k: n / total * drawn for k, n in counts.items()}
    out = {k: math.floor(x) for k, x in exact.items()}
    order = sorted(counts, key=lambda k: (-(exact[k] - out[k]), k))
    for k in order[: int(drawn - sum(out.values()))]:
        out[k] += 1
    return out


@pytest.fixture
def skewed(spark):
    rows = [(i, "low" if i % 3 else "high" if i % 2 else "medium") for i in range(701)]
    return rows, spark.createDataFrame(rows, "id long, level string").repartition(6)


def test_three_way(spark, skewed):
    rows, df = skewed
    out = splits.three_way_split(df, "id", stratum="level").collect()
    assert sorted(r["id"] for r in out) == sorted(i for i, _ in rows)
    sizes = Counter((r["level"], r["split"]) for r in out)
    counts = Counter(level for _, level in rows)
    train = largest_remainder(counts, 701 - math.ceil(0.3 * 701))
    rest = {k: counts[k] - train[k] for k in counts}
    val = largest_remainder(rest, sum(rest.values()) - math.ceil(0.5 * sum(rest.values())))
    for k in counts:
        assert sizes[(k, "train")] == train[k]
        assert sizes[(k, "val")] == val[k]
        assert sizes[(k, "test")] == rest[k] - val[k]


def test_same_split_whatever_the_partitions(skewed):
    _, df = skewed
    a = splits.three_way_split(df, "id", stratum="level").collect()
    b = splits.three_way_split(df.repartition(2).orderBy("id"), "id", stratum="level").collect()
    assert {tuple(r) for r in a} == {tuple(r) for r in b}
    c = splits.three_way_split(df, "id", stratum="level", seed=7).collect()
    assert {tuple(r) for r in a} != {tuple(r) for r in c}


def test_two_step_plain(skewed):
    _, df = skewed
    sizes = Counter(r["split"] for r in splits.two_step_split(df, "id").collect())
    test = math.ceil(0.15 * 701)
    val = math.ceil(0.1765 * (701 - test))
    assert sizes == {"test": test, "val": val, "train": 701 - test - val}


def test_missing_stratum_is_a_stratum(spark):
    df = spark.createDataFrame([(i, None) for i in range(20)], "id long, level string")
    sizes = Counter(r["split"] for r in splits.three_way_split(df, "id", stratum="level").collect())
    assert sizes == {"train": 14, "val": 3, "test": 3}


def test_tiny_inputs(spark):
    one = spark.createDataFrame([(1,)], "id long")
    assert [r["split"] for r in splits.three_way_split(one, "id").collect()] == ["test"]
    assert splits.three_way_split(one.where("id > 5"), "id").count() == 0


def test_sample(spark):
    df = spark.range(50)
    assert splits.sample_rows(df, "id", 7).count() == 7
    assert splits.sample_rows(df, "id", 70).count() == 50
