"""Evaluation of multi-label and single-label predictions.

Multi-label input is wide, one row per example: ``truth array<int>`` and
``prob array<double>`` in label order.  Row-wise results (decisions, argmax, sample
averages) need no shuffle; per-label results explode and aggregate with map-side
combining, so a hot label costs no more than a rare one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import stored
from .ordering import with_running_sums


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2.0 * tp, 2.0 * tp + fp + fn)


def long_form(wide: DataFrame, labels: list, *keep: str) -> DataFrame:
    """(…, position, label, truth, prob): one row per example and label.

    The outer explode keeps Spark from testing the array below it, which would compute the
    probabilities twice.
    """
    names = F.array(*[F.lit(x) for x in labels])
    cells = F.arrays_zip(names.alias("label"), F.col("truth").alias("truth"), F.col("prob").alias("prob"))
    exploded = wide.select(*keep, F.posexplode_outer(cells).alias("position", "cell")).where(F.col("position").isNotNull())
    return exploded.select(
        *keep, "position", F.col("cell.label").alias("label"), F.col("cell.truth").alias("truth"), F.col("cell.prob").alias("prob")
    )


def decided(prob: Column, threshold: float | Column, strict: bool = False) -> Column:
    """1 where the probability reaches the threshold (or exceeds it, if strict)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return ((prob > t) if strict else (prob >= t)).cast("int")


def label_counts(long: DataFrame, predicted: Column) -> DataFrame:
    """tp, fp, fn and support per label; ``predicted`` is a 0/1 column."""
    hit = long.withColumn("__p", predicted)
    return hit.groupBy("position", "label").agg(
        F.count_if((F.col("__p") == 1) & (F.col("truth") == 1)).alias("tp"),
        F.count_if((F.col("__p") == 1) & (F.col("truth") == 0)).alias("fp"),
        F.count_if((F.col("__p") == 0) & (F.col("truth") == 1)).alias("fn"),
        F.count_if(F.col("truth") == 1).alias("support"),
    )


def per_label_f1(counts: DataFrame) -> DataFrame:
    return counts.select("label", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), "support")


def f1_scores(counts: DataFrame) -> DataFrame:
    """One row: macro and micro F1."""
    return counts.agg(
        F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"),
        f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"),
    )


def score_table(long: DataFrame) -> DataFrame:
    """Rows and positives per label and distinct score, kept so that scoring runs once."""
    grouped = long.groupBy("label", "prob").agg(F.sum("truth").alias("pos"), F.count(F.lit(1)).alias("n"))
    return stored(grouped, "scores")


def score_steps(grouped: DataFrame) -> DataFrame:
    """Rows and positives at or above each distinct score of a label."""
    return with_running_sums(grouped, "prob", {"pos_above": "pos", "n_above": "n"}, ["label"], descending=True)


def average_precision(long: DataFrame) -> DataFrame:
    """Step-wise average precision per label; equal scores form one step; 0 without positives."""
    precision = F.col("pos") * (F.col("pos_above") / F.col("n_above"))
    return score_steps(score_table(long)).groupBy("label").agg(ratio(F.sum(precision), F.sum("pos")).alias("average_precision"))


def classification_report(wide: DataFrame, labels: list, predicted: Column) -> DataFrame:
    """precision, recall, f1, support per label, then micro, macro, weighted and samples averages.

    ``predicted`` is an ``array<int>`` column in label order.  One pass collects all counts in
    a single row; the averages are computed from that row.
    """
    rows = wide.select("truth", predicted.alias("said"))

    def both(i: int, truth: int, said: int) -> Column:
        return F.count_if((F.element_at("truth", i + 1) == truth) & (F.element_at("said", i + 1) == said))

    counts = [
        F.struct(
            F.lit(str(label)).alias("name"), both(i, 1, 1).alias("tp"), both(i, 0, 1).alias("fp"), both(i, 1, 0).alias("fn")
        )
        for i, label in enumerate(labels)
    ]
    ones = F.lit(1)
    hits = F.size(F.filter(F.zip_with("truth", "said", lambda t, p: t + p), lambda x: x == 2))
    true = F.size(F.filter("truth", lambda x: x == ones))
    said = F.size(F.filter("said", lambda x: x == ones))
    totals = rows.agg(
        F.array(*counts).alias("c"),
        F.avg(ratio(hits, said)).alias("sp"),
        F.avg(ratio(hits, true)).alias("sr"),
        F.avg(ratio(2.0 * hits, true + said)).alias("sf"),
    )

    def line(name, precision, recall, score, support) -> Column:
        return F.struct(
            name.alias("name"), precision.alias("precision"), recall.alias("recall"), score.alias("f1"),
            support.cast("bigint").alias("support"),
        )

    def scored(tp: Column, fp: Column, fn: Column, name: Column) -> Column:
        return line(name, ratio(tp, tp + fp), ratio(tp, tp + fn), f1(tp, fp, fn), tp + fn)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    per_label = totals.withColumn("r", F.transform("c", lambda x: scored(x["tp"], x["fp"], x["fn"], x["name"])))
    r, c, n = F.col("r"), F.col("c"), F.lit(len(labels))
    support = total(r["support"])

    def weighted(field: str) -> Column:
        return ratio(total(F.zip_with(r[field], r["support"], lambda v, s: v * s)), support)

    averages = F.array(
        scored(total(c["tp"]), total(c["fp"]), total(c["fn"]), F.lit("micro avg")),
        line(F.lit("macro avg"), total(r["precision"]) / n, total(r["recall"]) / n, total(r["f1"]) / n, support),
        line(F.lit("weighted avg"), weighted("precision"), weighted("recall"), weighted("f1"), support),
        line(F.lit("samples avg"), F.col("sp"), F.col("sr"), F.col("sf"), support),
    )
    return per_label.select(F.inline(F.concat("r", averages)))


# --- single label -------------------------------------------------------------


def argmax(prob: Column) -> Column:
    """Zero-based position of the largest entry, the first one on ties; -1 without entries.

    Never NULL, so a later join on it adds no null test that would score every row again.
    """
    return F.coalesce(F.array_position(prob, F.array_max(prob)).cast("int"), F.lit(0)) - 1


def confusion(df: DataFrame, true: str, pred: str, labels: list, kind: str = "string") -> DataFrame:
    """(true, pred, n) for every pair of labels, zeros included."""
    counted = df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(x) for x in labels]).cast(f"array<{kind}>")
    grid = df.sparkSession.range(1).select(F.explode(names).alias("true")).select("true", F.explode(names).alias("pred"))
    return grid.join(counted, ["true", "pred"], "left").select("true", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_matrix(cells: DataFrame, labels: list) -> DataFrame:
    """One row per true label with a column per predicted label."""
    return cells.groupBy("true").pivot("pred", labels).agg(F.sum("n"))


def class_counts_from(cells: DataFrame) -> DataFrame:
    """tp, fp, fn and support per class from confusion cells."""
    marked = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("true").alias("label"), F.lit(True).alias("as_true")),
                F.struct(F.col("pred").alias("label"), F.lit(False).alias("as_true")),
            )
        ).alias("side"),
        (F.col("true") == F.col("pred")).alias("same"),
        "n",
    )

    def total(when: Column) -> Column:
        return F.sum(F.when(when, F.col("n")).otherwise(0))

    as_true, same = F.col("side.as_true"), F.col("same")
    return marked.groupBy(F.col("side.label").alias("label")).agg(
        total(as_true & same).alias("tp"),
        total(~as_true & ~same).alias("fp"),
        total(as_true & ~same).alias("fn"),
        total(as_true).alias("support"),
    )


def accuracy_report(cells: DataFrame) -> DataFrame:
    """One row: accuracy and macro F1 over classes that occur as truth or prediction."""
    seen = class_counts_from(cells).where(F.col("tp") + F.col("fp") + F.col("fn") > 0)
    return seen.agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"),
    )


# --- losses -------------------------------------------------------------------


def log_sigmoid(x: Column) -> Column:
    return -(F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0)))


def weighted_bce(logit: Column, truth: Column, weight: Column) -> Column:
    return -(weight * truth * log_sigmoid(logit) + (1 - truth) * log_sigmoid(-logit))


def focal(logit: Column, truth: Column, weight: Column, gamma: float = 2.0) -> Column:
    """Weighted BCE scaled by (1 - p_t) ** gamma."""
    p = 1.0 / (1.0 + F.exp(-logit))
    p_true = F.when(truth > 0, p).otherwise(1.0 - p)
    return F.pow(1.0 - p_true, F.lit(gamma)) * weighted_bce(logit, truth, weight)


def log_softmax_at(logits: Column, position: Column) -> Column:
    """Log probability of the class at a zero-based position."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.element_at(logits, position + 1) - top - F.log(total)


def reduced(loss: Column, how: str) -> Column:
    return {"mean": F.avg, "sum": F.sum}[how](loss)
