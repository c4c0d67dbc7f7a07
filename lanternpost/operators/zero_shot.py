"""Zero-shot label scores and the semi-automatic tagging pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb, lexicon as lx
from ..functions.text import filled
from ..functions.vectors import DEFAULT_DIM, bound, dot, encoded
from .metrics import long_form
from .thresholds import best_per_label, tags_reaching, threshold_array

SCORED_LABELS = [name for name, _ in lx.LABEL_DESCRIPTIONS]


def description_vectors(spark: SparkSession, dim: int = DEFAULT_DIM) -> Column:
    """Encoded label descriptions in label order, as a scalar."""
    texts = F.array(*[F.lit(text) for _, text in lx.LABEL_DESCRIPTIONS])
    return spark.range(1).select(F.transform(texts, lambda t: encoded(t, dim))).scalar()


def with_label_scores(df: DataFrame, text: str, name: str = "prob", dim: int = DEFAULT_DIM, digits: int = 6) -> DataFrame:
    """Default scorer: similarity of the text with each label description, in label order."""
    scores = bound(
        encoded(F.col(text), dim),
        lambda v: F.transform("__labels", lambda d: F.round(dot(v, d), digits)),
    )
    return df.withColumn("__labels", description_vectors(df.sparkSession, dim)).withColumn(name, scores).drop("__labels")


def semi_auto_tags(
    df: DataFrame, *, text: str = "Text", tag: str = "Tag", scores: str | None = None, thresholds: DataFrame | None = None
) -> DataFrame:
    """Keep human tags where there are any; tag the rest with thresholds tuned on them.

    ``scores`` names an ``array<double>`` column of a model; without it the default
    scorer runs.  ``thresholds`` (label, threshold) replaces the tuning.
    """
    base = df.withColumn(text, filled(text)).withColumn(tag, filled(tag))
    scored = base.withColumnRenamed(scores, "prob") if scores else with_label_scores(base, text)
    labelled, rest = scored.where(F.col(tag) != ""), scored.where(F.col(tag) == "")
    gold = labelled.withColumn("Human_Tags", lb.human_tags(F.col(tag)))
    if thresholds is None:
        truth = gold.withColumn("truth", lb.indicator(F.col("Human_Tags"), SCORED_LABELS))
        thresholds = best_per_label(long_form(truth.select("truth", "prob"), SCORED_LABELS))
    others = [c for c in df.columns if c not in (text, tag, scores)]
    kept = gold.select(
        *others, text, tag, F.col("Human_Tags").alias("Final_Tags"), F.lit("Human_Gold").alias("Tag_Source")
    )
    tagged = (
        rest.withColumn("__t", threshold_array(thresholds, SCORED_LABELS))
        .withColumn("Final_Tags", tags_reaching("prob", "__t", SCORED_LABELS))
        .select(*others, text, tag, "Final_Tags", F.lit("Model_Optimal").alias("Tag_Source"))
    )
    return kept.unionByName(tagged, allowMissingColumns=True)


def evaluated_tags(df: DataFrame, *, text: str = "Text", tag: str = "Tag") -> DataFrame:
    """Human and model tags side by side for the labelled rows."""
    base = with_label_scores(df.withColumn(text, filled(text)).withColumn(tag, filled(tag)).where(F.col(tag) != ""), text)
    gold = base.withColumn("Human_Tags", lb.human_tags(F.col(tag)))
    truth = gold.withColumn("truth", lb.indicator(F.col("Human_Tags"), SCORED_LABELS))
    thresholds = best_per_label(long_form(truth.select("truth", "prob"), SCORED_LABELS))
    return gold.withColumn("__t", threshold_array(thresholds, SCORED_LABELS)).withColumn(
        "Model_Tags", tags_reaching("prob", "__t", SCORED_LABELS)
    ).drop("__t", "prob")
