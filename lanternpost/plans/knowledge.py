"""Registered queries: sentences, chunks, encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx, vectors as vx
from ..operators import knowledge
from . import inputs, sql
from .inputs import table
from .registry import Registry

registry = Registry()
query = registry.query


@query(
    "sentences",
    f"""WITH l AS (SELECT doc_id, {sql.sentences('text')} AS s FROM documents)
    SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS sentences_md5 FROM l""",
)
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    split = table(spark, sf, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return split.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query(
    "kb_chunks",
    sql.with_ctes(inputs.KB, "SELECT doc_id, base::VARCHAR AS base_id, chunk_no, intent, concern, md5(text) AS text_md5 FROM kb"),
)
def kb_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.kb_chunks(spark, sf).select(
        "doc_id", "base_id", "chunk_no", "intent", "concern", F.md5("text").alias("text_md5")
    )


_PLAIN = [
    f"plain AS (SELECT doc_id, regexp_replace(text, '[.!?]', '', 'g') AS text FROM documents)",
    *sql.chunked("plain", "doc_id", "text"),
]


@query("forced_chunks", sql.with_ctes(_PLAIN, "SELECT doc_id, chunk_no, md5(text) AS text_md5 FROM chunked"))
def forced_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without sentence marks are one sentence; the long ones are cut into word windows."""
    plain = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[.!?]", "").alias("output"))
    return knowledge.chunk_rows(plain, intent_col=None, concern_col=None).select(
        F.col("base_id").cast("bigint").alias("doc_id"), "chunk_no", F.md5("text").alias("text_md5")
    )


@query(
    "whole_answers",
    f"""WITH b AS (SELECT doc_id, {sql.strip('text')} AS body FROM documents)
    SELECT doc_id::VARCHAR AS doc_id, md5(body) AS text_md5 FROM b WHERE length(body) >= 20""",
)
def whole_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Knowledge base with chunking switched off."""
    whole = knowledge.chunk_rows(inputs.kb_source(spark, sf), chunking=False)
    return whole.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "kb_counters",
    sql.with_ctes(
        inputs.CHUNKS,
        "SELECT (SELECT count(*) FROM documents) AS rows_in, (SELECT count(*) FROM bodies) AS rows_kept, (SELECT count(*) FROM chunked) AS chunks",
    ),
)
def kb_counters(spark: SparkSession, sf: str) -> DataFrame:
    return knowledge.counters(table(spark, sf, "documents"), "text")


@query(
    "hashed_vectors",
    sql.with_ctes(
        sql.encoded("enc", "documents", "doc_id", "text"),
        """SELECT doc_id, array_to_string(list_transform(vec, lambda x: round(x * 1e6)::BIGINT), ',') AS millionths FROM enc""",
    ),
)
def hashed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "documents").select("doc_id", vx.encoded(F.col("text")).alias("v"))
    rounded = F.transform("v", lambda x: F.round(x * 1e6).cast("bigint").cast("string"))
    return vectors.select("doc_id", F.array_join(rounded, ",").alias("millionths"))


@query(
    "normalise_vectors",
    f"""WITH w AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 5)) AS v FROM embeddings),
    u AS (SELECT vec_id, {sql.unit('v')} AS v FROM w)
    SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS length, round(v[1], 6) + 0.0::DOUBLE AS first, round(v[64], 6) + 0.0::DOUBLE AS last FROM u""",
)
def normalise_vectors(spark: SparkSession, sf: str) -> DataFrame:
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (F.col("vec_id") % 5))
    units = table(spark, sf, "embeddings").select("vec_id", vx.unit(scaled).alias("v"))
    return units.select(
        "vec_id",
        F.round(vx.norm(F.col("v")), 6).alias("length"),
        F.round(F.element_at("v", 1), 6).alias("first"),
        F.round(F.element_at("v", 64), 6).alias("last"),
    )
