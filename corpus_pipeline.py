"""The corpus pipeline: five stages over the documents table, each written and read again.

Stages pass on the columns of their input.  Null and empty texts fail the quality rules; repeated
rows of one document are one document to the near-dedup stage, and all but one document of a
group go.  The least id stays, then the least hash of the text; a document without an id stays only
where no document with one is near to it, and one of a group without ids.  An empty table passes
through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternpost.llm import line_dedup, packing, quality_rules, simhash, substring_dedup
from lanternpost.llm.helpers import fresh_name
from lanternpost.sources import storage

WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
SHINGLE_WORDS, MOST_BITS = 3, 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    m = fresh_name(docs, "measures")
    v = fresh_name(docs, "verdict")
    measured = quality_rules.measure(docs, "text", m)
    refs = quality_rules.references(measured.select("lang", m), m, "lang")
    return quality_rules.judge(measured, refs, m, "lang", v).where(F.col(v)["kept"]).select(*docs.columns)


def _with_text(docs: DataFrame, made: DataFrame, result: str) -> DataFrame:
    return made.select(*[F.col(result)["text"].alias(c) if c == "text" else F.col(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in one of them."""
    r = fresh_name(docs, "lines")
    return _with_text(docs, line_dedup.dedup_lines(docs, "doc_id", "text", r), r)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    found = simhash.linked_fingerprints(docs, "doc_id", "text", width=SHINGLE_WORDS, radius=MOST_BITS)
    text_hash, kept_id, kept_hash = fresh_name(docs, "text_key"), fresh_name(docs, "kept_id"), fresh_name(docs, "kept_hash")
    first = F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "text_hash"))
    kept = found.groupBy("root").agg(first.alias("one")).select(F.col("one.doc").alias(kept_id), F.col("one.text_hash").alias(kept_hash)).distinct()
    on = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(text_hash) == F.col(kept_hash))
    one = docs.withColumn(text_hash, F.xxhash64("text")).join(kept, on, "left_semi").dropDuplicates(["doc_id", text_hash])
    return one.select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat across or within documents."""
    r = fresh_name(docs, "passages")
    return _with_text(docs, substring_dedup.dedup_substrings(docs, "doc_id", "text", r), r)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary lengths."""
    return packing.pack(docs, "doc_id", "text", WORD_MODEL)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("substring_dedup", substrings), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.stored(stage(spark, docs, sf_dir), name)
    return docs
