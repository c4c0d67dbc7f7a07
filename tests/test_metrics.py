"""Metrics and thresholds against published confusion matrices and small loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternpost.operators import metrics, summaries, thresholds
from lanternpost.functions import lexicon as lx

LABELS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(300):
        prob = [round(rng.random(), 2) for _ in LABELS]
        truth = [int(rng.random() < p) for p in prob]
        truth[2] = 0  # a label without positives
        out.append((i, truth, prob))
    return out


@pytest.fixture
def wide(spark, rows):
    return spark.createDataFrame(rows, "row_id int, truth array<int>, prob array<double>").repartition(4)


@pytest.mark.parametrize(
    "order, cells, accuracy, macro, scores",
    [
        (["high", "low", "medium"], [[103, 3, 17], [12, 217, 64], [44, 113, 219]], 0.680556, 0.690572, [0.730496, 0.693291, 0.647929]),
        (["low", "medium", "high"], [[222, 65, 6], [81, 277, 18], [4, 12, 107]], 0.765152, 0.780475, None),
    ],
)
def test_published_confusions(spark, order, cells, accuracy, macro, scores):
    pairs = [(order[i], order[j]) for i in range(3) for j in range(3) for _ in range(cells[i][j])]
    counted = metrics.confusion(spark.createDataFrame(pairs, "t string, p string"), "t", "p", order)
    got = {(r["true"], r["pred"]): r["n"] for r in counted.collect()}
    assert got == {(order[i], order[j]): cells[i][j] for i in range(3) for j in range(3)}
    report = metrics.accuracy_report(counted).first()
    assert report["accuracy"] == pytest.approx(accuracy, abs=1e-6)
    assert report["macro_f1"] == pytest.approx(macro, abs=1e-6)
    if scores:
        each = {r["label"]: r["f1"] for r in metrics.per_label_f1(metrics.class_counts_from(counted)).collect()}
        assert [each[o] for o in order] == pytest.approx(scores, abs=1e-6)


def test_published_tag_summary(spark):
    counts = dict(zip(lx.TAGS, [1703, 1126, 1085, 932, 820, 712, 676, 646, 0]))
    rows = spark.createDataFrame([(t, n) for t, n in counts.items()], "tag string, n int")
    repeated = rows.select("tag", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
    got = {r["Tag"]: (r["Count"], r["Percent"]) for r in summaries.tag_summary(repeated, "tag").collect()}
    total = sum(counts.values())
    assert got == {t: (n, round(100 * n / total, 2)) for t, n in counts.items()}


def test_summary_of_nothing(spark):
    got = summaries.tag_summary(spark.createDataFrame([(None,)], "tag string"), "tag").collect()
    assert len(got) == 9 and all(r["Percent"] == 0.0 for r in got)


def test_f1(wide, rows):
    counts = metrics.label_counts(metrics.long_form(wide, LABELS), metrics.decided(F.col("prob"), 0.5))
    got = metrics.f1_scores(counts).first()
    each, total = [], [0, 0, 0]
    for j in range(3):
        tp = sum(t[j] and p[j] >= 0.5 for _, t, p in rows)
        fp = sum((not t[j]) and p[j] >= 0.5 for _, t, p in rows)
        fn = sum(t[j] and p[j] < 0.5 for _, t, p in rows)
        each.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0)
        total = [a + b for a, b in zip(total, (tp, fp, fn))]
    assert got["macro_f1"] == pytest.approx(sum(each) / 3)
    assert got["micro_f1"] == pytest.approx(2 * total[0] / (2 * total[0] + total[1] + total[2]))
    assert 0 <= got["macro_f1"] <= 1


def test_average_precision_with_ties(wide, rows):
    got = {r["label"]: r["average_precision"] for r in metrics.average_precision(metrics.long_form(wide, LABELS)).collect()}
    for j, name in enumerate(LABELS):
        positives, area, before = sum(t[j] for _, t, _ in rows), 0.0, 0.0
        for cut in sorted({p[j] for _, _, p in rows}, reverse=True):
            above = [t[j] for _, t, p in rows if p[j] >= cut]
            recall = sum(above) / positives if positives else 0.0
            area += (recall - before) * sum(above) / len(above)
            before = recall
        assert got[name] == pytest.approx(area, abs=1e-12)


def macro_at(rows, t):
    each = []
    for j in range(3):
        tp = sum(x[j] and p[j] > t for _, x, p in rows)
        fp = sum((not x[j]) and p[j] > t for _, x, p in rows)
        fn = sum(x[j] and not p[j] > t for _, x, p in rows)
        each.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0)
    return sum(each) / 3


def test_sweep_equals_ninety_evaluations(wide, rows):
    grid = np.arange(0.05, 0.95, 0.01)
    assert len(grid) == thresholds.SWEEP_SIZE
    swept = thresholds.sweep(metrics.long_form(wide, LABELS), LABELS)
    got = {r["i"]: r for r in swept.collect()}
    best = (0.0, 0.0)
    for i, t in enumerate(grid):
        assert got[i]["threshold"] == t
        assert got[i]["macro_f1"] == pytest.approx(macro_at(rows, t), abs=1e-11)
        if macro_at(rows, t) > best[1] + 1e-12:
            best = (t, macro_at(rows, t))
    chosen = thresholds.best_global(swept).first()
    assert (chosen["threshold"], chosen["macro_f1"]) == pytest.approx(best)


def test_sweep_without_positives(spark):
    none = spark.createDataFrame([(1, [0, 0, 0], [0.5, 0.5, 0.5])], "row_id int, truth array<int>, prob array<double>")
    chosen = thresholds.best_global(thresholds.sweep(metrics.long_form(none, LABELS), LABELS)).first()
    assert tuple(chosen) == (0.0, 0.0)


def test_label_thresholds(wide, rows):
    got = {r["label"]: (r["threshold"], r["f1"]) for r in thresholds.best_per_label(metrics.long_form(wide, LABELS)).collect()}
    for j, name in enumerate(LABELS):
        best = (-1.0, None)
        for cut in sorted({p[j] for _, _, p in rows}):
            above = [t[j] for _, t, p in rows if p[j] >= cut]
            precision, positives = sum(above) / len(above), sum(t[j] for _, t, _ in rows)
            recall = sum(above) / positives if positives else 1.0
            score = 2 * precision * recall / (precision + recall + 1e-9)
            if score > best[0]:
                best = (score, cut)
        assert got[name] == pytest.approx((best[1], best[0]))


def test_tags_or_best(column):
    got = column([[0.2, 0.7, 0.7], [0.1, 0.3, 0.3]], lambda p: thresholds.tags_or_best(p, 0.5, LABELS), "array<double>")
    assert got == [["b", "c"], ["b"]]


def test_no_labels_is_a_clear_error(wide):
    with pytest.raises(ValueError, match="labelled"):
        thresholds.threshold_array(wide, [])


def test_losses(spark):
    xs = [(-40.0, 1), (-2.0, 0), (0.0, 1), (3.5, 1), (40.0, 0)]
    df = spark.createDataFrame(xs, "x double, y int")
    out = df.select(
        "x", "y", metrics.weighted_bce(F.col("x"), F.col("y"), F.lit(2.0)).alias("b"), metrics.focal(F.col("x"), F.col("y"), F.lit(2.0)).alias("f")
    ).collect()
    for r in out:
        p = 1 / (1 + math.exp(-r["x"]))
        if abs(r["x"]) < 30:
            want = -(2 * r["y"] * math.log(p) + (1 - r["y"]) * math.log(1 - p))
            assert r["b"] == pytest.approx(want)
            assert r["f"] == pytest.approx((1 - (p if r["y"] else 1 - p)) ** 2 * want)
        else:
            assert math.isfinite(r["b"]) and r["b"] >= 40


def test_report_rows(wide):
    decided = F.transform("prob", lambda p: metrics.decided(p, 0.5))
    names = [r["name"] for r in metrics.classification_report(wide, LABELS, decided).collect()]
    assert set(names) == {*LABELS, "micro avg", "macro avg", "weighted avg", "samples avg"}


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "label string")
    counts = summaries.class_counts(df, "label", LABELS)
    weights = {r["label"]: r["weight"] for r in summaries.inverse_weights(counts).collect()}
    raw = [1 / (n + 1e-5) for n in (3, 1, 0)]
    assert [weights[x] for x in LABELS] == pytest.approx([w / sum(raw) * 3 for w in raw])
    balanced = {r["label"]: r["weight"] for r in summaries.balanced_weights(counts).collect()}
    assert balanced["a"] == pytest.approx(4 / 9) and balanced["c"] is None
