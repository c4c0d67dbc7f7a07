"""Posts met with a lexicon that is a table: any number of phrases, one pass over the texts for each part.

A phrase is found wherever its characters stand in the text, also inside words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.phrases import phrases_found
from ..sources import storage

#: Bytes of phrases that one pass searches for; an automaton takes about a hundred times as much.
PART_BYTES = 1 << 20


def lexicon_hits(posts: DataFrame, id_: str, text: str, lexicon: DataFrame, phrase: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, phrase) for every row of ``posts`` and every phrase of ``lexicon`` that occurs in its text.

    Phrases are dealt by hash into parts of about ``part_bytes``; the driver and a worker hold one
    part at a time, and with several parts the hits of each are stored before the next begins.
    Repeated and null phrases count once or not at all, empty ones are ignored; a null text has no
    hits; repeated posts have hits each.  An empty table on either side gives no rows.
    """
    spark = posts.sparkSession
    words = storage.stored(lexicon.select(F.col(phrase).alias("phrase")).where(F.col("phrase") != "").distinct(), "lexicon")
    size = words.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    rows = posts.select(F.col(id_).alias("id"), F.col(text).alias("text"))

    def hits(part: int) -> DataFrame:
        mine = words.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part)
        found = phrases_found(F.col("text"), [r["phrase"] for r in mine.collect()])
        return rows.select(F.col("id").alias(id_), found.alias("found")).select(id_, F.explode("found").alias("phrase"))

    if parts == 1:
        return hits(0)
    folder = storage.shared_folder(spark, "lexicon-hits")
    for part in range(parts):
        hits(part).write.parquet(f"{folder}/part={part}")
    kind = posts.schema[id_].dataType.simpleString()
    return spark.read.schema(f"`{id_}` {kind}, phrase string").parquet(*[f"{folder}/part={p}" for p in range(parts)])


def lexicon_counts(hits: DataFrame, id_: str, lexicon: DataFrame, phrase: str, label: str) -> DataFrame:
    """(label, phrase, n_posts) of all entries of ``lexicon``; ``n_posts`` counts different ids and may be 0."""
    counted = hits.groupBy("phrase").agg(F.count_distinct(id_).alias("n_posts"))
    entries = lexicon.select(F.col(label).alias(label), F.col(phrase).alias("phrase")).distinct()
    return entries.join(counted, "phrase", "left").select(label, F.col("phrase").alias(phrase), F.coalesce("n_posts", F.lit(0).cast("long")).alias("n_posts"))
