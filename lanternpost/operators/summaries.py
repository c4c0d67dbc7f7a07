"""Counts and shares: value counts, tag summaries, class weights, proportions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import labels, lexicon as lx



def everything() -> WindowSpec:
    """Window over a whole table; only for tables of a few rows, such as class counts."""
    return Window.partitionBy()


def vocabulary(spark: SparkSession, values: list, name: str, kind: str = "string") -> DataFrame:
    """A literal list as a table, in list order."""
    items = F.array(*[F.lit(v) for v in values])
    return spark.range(1).select(F.posexplode(items).alias("position", name)).select(F.col(name).cast(kind), "position")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def _pieces(df: DataFrame, tags: str, delimiters: str) -> DataFrame:
    raw = labels.comma_tags(F.col(tags), delimiters)
    return df.select(
        F.transform(raw, lambda t: F.struct(t.alias("raw"), labels.summary_tag(t).alias("tag"))).alias("pieces")
    )


def tag_summary(df: DataFrame, tags: str, delimiters: str = ",") -> DataFrame:
    """Count and percent of every vocabulary tag; a tag counts once per row, absent tags show zero."""
    known = F.array_distinct(F.filter(F.col("pieces")["tag"], lambda t: t.isNotNull()))
    counted = _pieces(df, tags, delimiters).select(F.explode(known).alias("Tag")).groupBy("Tag").agg(
        F.count(F.lit(1)).alias("n")
    )
    vocab = vocabulary(df.sparkSession, lx.TAGS, "Tag")
    filled = vocab.join(counted, "Tag", "left").select("Tag", "position", F.coalesce("n", F.lit(0)).alias("Count"))
    total = F.sum("Count").over(everything())
    percent = F.when(total > 0, F.round(100 * F.col("Count") / total, 2)).otherwise(0.0)
    return filled.withColumn("Percent", percent).orderBy(F.desc("Count"), "position").drop("position")


def unknown_tags(df: DataFrame, tags: str, delimiters: str = ",") -> DataFrame:
    """Every occurrence of a tag outside the vocabulary, as written."""
    unknown = F.filter("pieces", lambda p: p["tag"].isNull())["raw"]
    return value_counts(_pieces(df, tags, delimiters).select(F.explode(unknown).alias("UnknownTag")), "UnknownTag")


def class_counts(df: DataFrame, column: str, classes: list, kind: str = "string") -> DataFrame:
    """Rows per class in class order, empty classes included."""
    counted = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    vocab = vocabulary(df.sparkSession, classes, "label", kind)
    return vocab.join(counted, "label", "left").select("label", "position", F.coalesce("n", F.lit(0)).alias("n"))


def inverse_weights(counts: DataFrame) -> DataFrame:
    """1 / (n + 1e-5), scaled so that the weights sum to the number of classes."""
    raw = 1.0 / (F.col("n") + F.lit(1e-5))
    scaled = F.col("raw") / F.sum("raw").over(everything()) * F.count(F.lit(1)).over(everything())
    return counts.withColumn("raw", raw).withColumn("weight", scaled).drop("raw")


def balanced_weights(counts: DataFrame) -> DataFrame:
    """N / (K * n), NULL for an empty class."""
    rows, classes = F.sum("n").over(everything()), F.count(F.lit(1)).over(everything())
    return counts.withColumn("weight", F.when(F.col("n") > 0, rows / (classes * F.col("n"))))


def proportions(df: DataFrame, split: str, column: str, digits: int = 3) -> DataFrame:
    """Share of each class within its split."""
    counted = df.groupBy(split, column).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(split))
    return counted.withColumn("share", F.round(share, digits))


def success_counts(df: DataFrame, failed: Column) -> DataFrame:
    return df.agg(F.count_if(~failed).alias("n_ok"), F.count_if(failed).alias("n_fail"))
