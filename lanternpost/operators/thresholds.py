"""Decision thresholds: fixed, one for all labels, and one per label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from .metrics import f1, score_steps, score_table
from .summaries import vocabulary

# Grid of the global sweep: start, step and number of values of 0.05 ... 0.94.
SWEEP_START, SWEEP_STEP, SWEEP_SIZE = 0.05, 0.01, 90


def sweep_value(i: Column) -> Column:
    """Grid value; start + i * ((start + step) - start), as an arange of doubles is filled."""
    return F.lit(SWEEP_START) + i * F.lit((SWEEP_START + SWEEP_STEP) - SWEEP_START)


def _grid_below(prob: Column) -> Column:
    """How many grid values lie strictly below ``prob``: an estimate, settled by four comparisons."""
    guess = F.floor((prob - SWEEP_START) / SWEEP_STEP) - 1
    base = F.greatest(F.lit(0), F.least(guess, F.lit(SWEEP_SIZE - 1))).cast("int")
    checks = [((base + d < SWEEP_SIZE) & (prob > sweep_value(base + d))).cast("int") for d in range(4)]
    return base + checks[0] + checks[1] + checks[2] + checks[3]


def sweep(long: DataFrame, labels: list, kind: str = "string") -> DataFrame:
    """Macro F1 for every grid value, from one histogram of scores per label."""
    histogram = long.groupBy("label", _grid_below(F.col("prob")).alias("below")).agg(
        F.sum("truth").alias("pos"), F.count(F.lit(1)).alias("n")
    )
    slots = vocabulary(long.sparkSession, labels, "label", kind).select(
        "label", F.explode(F.sequence(F.lit(0), F.lit(SWEEP_SIZE))).alias("below")
    )
    dense = slots.join(histogram, ["label", "below"], "left").fillna(0, ["pos", "n"])
    per_label = Window.partitionBy("label")
    above = per_label.orderBy(F.desc("below")).rowsBetween(Window.unboundedPreceding, -1)
    # A row counts as positive at grid value i when more than i values lie below its score.
    stepped = dense.select(
        "label",
        F.col("below").alias("i"),
        F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("n").over(above), F.lit(0)).alias("said"),
        F.sum("pos").over(per_label).alias("support"),
    ).where(F.col("i") < SWEEP_SIZE)
    tp = F.col("tp")
    score = F.avg(f1(tp, F.col("said") - tp, F.col("support") - tp))
    return stepped.groupBy("i").agg(F.round(score, 12).alias("macro_f1")).withColumn("threshold", sweep_value(F.col("i")))


def best_global(swept: DataFrame) -> DataFrame:
    """One row: the first threshold with the best macro F1; (0, 0) if nothing scores above 0."""
    best = F.max_by(F.struct("threshold", "macro_f1"), F.struct("macro_f1", -F.col("i")))
    picked = swept.where(F.col("macro_f1") > 0).agg(best.alias("b"))
    return picked.select(
        F.coalesce("b.threshold", F.lit(0.0)).alias("threshold"), F.coalesce("b.macro_f1", F.lit(0.0)).alias("macro_f1")
    )


def best_per_label(long: DataFrame) -> DataFrame:
    """(label, threshold, f1): best F1 along the precision-recall curve, the lowest threshold on ties."""
    grouped = score_table(long)
    steps = score_steps(grouped)
    support = grouped.groupBy("label").agg(F.sum("pos").alias("support"))
    precision = F.col("pos_above") / F.col("n_above")
    recall = F.when(F.col("support") > 0, F.col("pos_above") / F.col("support")).otherwise(1.0)
    score = 2 * precision * recall / (precision + recall + F.lit(1e-9))
    scored = steps.join(support, "label").withColumn("f1", score)
    best = F.max_by(F.struct("prob", "f1"), F.struct("f1", -F.col("prob")))
    return scored.groupBy("label").agg(best.alias("b")).select(
        "label", F.col("b.prob").alias("threshold"), F.col("b.f1").alias("f1")
    )


def threshold_array(thresholds: DataFrame, labels: list) -> Column:
    """Thresholds in label order as a scalar, for use in a projection."""
    if not labels:
        raise ValueError("no labels: thresholds need at least one labelled row")
    table = thresholds.agg(F.map_from_entries(F.collect_list(F.struct("label", "threshold"))).alias("m"))
    return table.select(F.array(*[F.try_element_at("m", F.lit(x)) for x in labels])).scalar()


def tags_reaching(prob: str, thresholds: str, labels: list) -> Column:
    """Labels whose probability reaches their threshold, default Miscellaneous."""
    names = F.array(*[F.lit(x) for x in labels])
    cells = F.arrays_zip(names.alias("label"), F.col(prob).alias("p"), F.col(thresholds).alias("t"))
    chosen = F.transform(F.filter(cells, lambda c: c["p"] >= c["t"]), lambda c: c["label"])
    return F.when(F.size(chosen) == 0, F.array(F.lit(lx.DEFAULT_TAG))).otherwise(chosen)


def tags_or_best(prob: Column, threshold: float | Column, labels: list) -> Column:
    """Labels reaching one threshold, else the single most probable one."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    names = F.array(*[F.lit(x) for x in labels])
    chosen = F.filter(names, lambda x, i: F.element_at(prob, i + 1) >= t)
    best = F.element_at(names, F.array_position(prob, F.array_max(prob)).cast("int"))
    return F.when(F.size(chosen) == 0, F.array(best)).otherwise(chosen)
