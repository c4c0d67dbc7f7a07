"""Registered queries: nearest neighbours, filtered and boosted retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx, rules
from ..functions.vectors import encoded_in_batches
from ..operators import neighbours, retrieval, vector_index
from ..sources.storage import shared_folder, stored
from . import inputs, sql
from .registry import Registry

registry = Registry()
query = registry.query

_SCORED = """scored AS (SELECT query_id, doc_id, round(list_inner_product(q.vec, s.vec), 9) AS sim FROM queries q, snippets s)"""
TOP = """top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS r FROM scored QUALIFY r <= {k})"""
BASE = [inputs.SNIPPETS_SQL, inputs.QUERIES_SQL, _SCORED]

_NEAREST = sql.with_ctes(
    [*BASE, TOP.format(k=10)], "SELECT query_id, doc_id AS kb_id, round(sim, 6) AS similarity, r AS rank FROM top"
)


def _neighbours(spark: SparkSession, sf: str, plan: str) -> DataFrame:
    vectors = inputs.snippet_vectors(spark, sf).select("doc_id", "vector")
    hits = neighbours.nearest(
        vectors, vectors, 10, query_id="doc_id", query_vector="vector", kb_id="doc_id", kb_vector="vector", plan=plan
    )
    return hits.select("query_id", "kb_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("topk_neighbours", _NEAREST)
def topk_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbours(spark, sf, "auto")


@query("topk_neighbours_by_cell", _NEAREST)
def topk_neighbours_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    """The same result from the plan for many queries, which broadcasts neither side."""
    return _neighbours(spark, sf, "cells")


@query("topk_by_index", _NEAREST)
def topk_by_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same result from an index that is written to disk, opened by its path and searched in rounds."""
    path = shared_folder(spark, "vector-index")
    vector_index.build(inputs.snippet_vectors(spark, sf), path, "doc_id", "vector")
    index = vector_index.VectorIndex(spark, path)
    hits = index.search(inputs.snippet_vectors(spark, sf), 10, query_id="doc_id", query_vector="vector")
    return hits.select("query_id", "kb_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("index_recall", "SELECT 10 AS k, count(*) * 10 AS n_exact, true AS enough FROM embeddings")
def index_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of a search that probes some of the cells, against the exact rows of the same index."""
    path = shared_folder(spark, "vector-index")
    vectors = inputs.snippet_vectors(spark, sf)
    index = vector_index.build(vectors, path, "doc_id", "vector")
    search = dict(query_id="doc_id", query_vector="vector")
    exact = index.search(vectors, 10, **search).select("query_id", "kb_id")
    probed = index.search(vectors, 10, probe=max(1, 3 * len(index.cells) // 4), **search).select("query_id", "kb_id", F.lit(True).alias("found"))
    both = exact.join(probed, ["query_id", "kb_id"], "left")
    return both.agg(F.lit(10).alias("k"), F.count(F.lit(1)).alias("n_exact"), (F.count("found") >= 0.9 * F.count(F.lit(1))).alias("enough"))


@query(
    "filtered_search",
    sql.with_ctes(
        [
            *BASE,
            TOP.format(k=50),
            """kept AS (SELECT t.query_id, t.sim, t.doc_id, s.intent, s.concern, s.text FROM top t JOIN snippets s USING (doc_id) JOIN queries q USING (query_id)
               WHERE (len(intents) = 0 OR len(list_filter(intents, lambda w: contains(lower(s.intent), lower(w)))) > 0)
               AND (coalesce(want, '') = '' OR lower(s.concern) = want))""",
            "ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM kept QUALIFY rank <= 5)",
        ],
        "SELECT query_id, rank, round(2.0::DOUBLE - 2.0::DOUBLE * sim, 6) AS score, doc_id, intent, concern, text, 'csv' AS source FROM ranked",
    ),
)
def filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.filtered_search(inputs.vector_queries(spark, sf), inputs.snippet_vectors(spark, sf))
    return found.withColumn("score", F.round("score", 6))


BOOST = """boost AS (SELECT t.query_id, t.doc_id, t.sim, s.intent, s.concern, s.text,
    round(t.sim * CASE WHEN len(intents) = 0 THEN 1.0::DOUBLE WHEN len(list_filter(intents, lambda w: contains(lower(s.intent), lower(w)))) > 0 THEN 1.2::DOUBLE ELSE 0.5::DOUBLE END
          * CASE WHEN coalesce(want, '') = '' THEN 1.0::DOUBLE WHEN lower(s.concern) = want THEN 1.2::DOUBLE WHEN want = 'high' THEN 0.5::DOUBLE
                 WHEN lower(s.concern) = 'high' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score
    FROM top t JOIN snippets s USING (doc_id) JOIN queries q USING (query_id) WHERE t.sim >= 0.1::DOUBLE)"""
_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM boost QUALIFY place <= 5)"
_UNSAFE = sql.matches_any("lower(text)", lx.UNSAFE_SNIPPET_PATTERNS)


@query(
    "boosted_retrieval",
    sql.with_ctes(
        [*BASE, TOP.format(k=40), BOOST, _PLACED],
        f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, round(score, 6) AS score,
        round(sim, 6) AS similarity, doc_id, 'csv' AS source, intent, concern, text FROM placed WHERE NOT {_UNSAFE}""",
    ),
)
def boosted_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.boosted_retrieval(
        inputs.vector_queries(spark, sf), inputs.snippet_vectors(spark, sf), topk=40, keep=5, min_similarity=0.1
    )
    return found.withColumn("score", F.round("score", 6)).withColumn("similarity", F.round("similarity", 6))


_FAR = BOOST.replace("t.sim >= 0.1::DOUBLE", "t.sim >= 0.3::DOUBLE")
_DISTANCE = "top AS (SELECT query_id, doc_id, round(2.0::DOUBLE - 2.0::DOUBLE * sim, 9) AS sim FROM near_top)"


@query(
    "boosted_retrieval_by_distance",
    sql.with_ctes(
        [*BASE, TOP.format(k=40).replace("top AS", "near_top AS"), _DISTANCE, _FAR, _PLACED],
        f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, round(score, 6) AS score,
        round(sim, 6) AS distance, doc_id FROM placed WHERE NOT {_UNSAFE}""",
    ),
)
def boosted_retrieval_by_distance(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.boosted_retrieval(
        inputs.vector_queries(spark, sf), inputs.snippet_vectors(spark, sf), topk=40, keep=5, score_mode="distance"
    )
    return found.select("query_id", "rank", F.round("score", 6).alias("score"), F.round("similarity", 6).alias("distance"), "doc_id")


@query(
    "unsafe_filter",
    f"""WITH planted AS (SELECT doc_id, text || ' ' || {sql.pick(inputs.SNIPPETS, 'doc_id')} AS text FROM documents)
    SELECT count(*) AS n, count(*) FILTER (WHERE {_UNSAFE}) AS n_unsafe, sum(doc_id) FILTER (WHERE NOT {_UNSAFE})::BIGINT AS safe_ids FROM planted""",
)
def unsafe_filter(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    planted = inputs.table(spark, sf, "documents").select(
        "doc_id", F.concat("text", F.lit(" "), inputs.pick(inputs.SNIPPETS, doc)).alias("text")
    )
    marked = planted.withColumn("unsafe", rules.unsafe_snippet(F.col("text")))
    return marked.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("unsafe").alias("n_unsafe"), F.sum(F.when(~F.col("unsafe"), doc)).alias("safe_ids")
    )


# --- posts against the chunked knowledge base -----------------------------------------------------


def post_queries(posts: DataFrame) -> DataFrame:
    """One query per post, with its own intent and concern as wishes."""
    return posts.select(
        "query_id",
        F.col("post").alias("query"),
        encoded_in_batches(F.col("post")).alias("vector"),
        F.array("intent").alias("intents"),
        F.lower("concern").alias("concern"),
    )


def post_snippets(spark: SparkSession, sf: str, posts: DataFrame | None = None, *, with_vector: bool = False) -> DataFrame:
    """Boosted retrieval of chunks for every user turn, or for ``posts``, from the index of the knowledge base."""
    queries = stored(post_queries(inputs.said(spark, sf) if posts is None else posts), "queries")
    return retrieval.boosted_retrieval(queries, inputs.kb_index(spark, sf), topk=20, keep=3, min_similarity=0.3, with_vector=with_vector)


POST_SNIPPETS = [
    inputs.PAIRS,
    inputs.SAID,
    *inputs.KB_VECTORS,
    *sql.encoded("post_vec", "said", "query_id", "post"),
    """near AS (SELECT p.query_id, k.doc_id, round(list_inner_product(p.vec, k.vec), 9) AS sim FROM post_vec p, kb_vec k
        QUALIFY row_number() OVER (PARTITION BY p.query_id ORDER BY sim DESC, k.doc_id) <= 20)""",
    """near_boost AS (SELECT n.query_id, n.doc_id, n.sim, k.intent, k.concern, k.text,
        round(n.sim * CASE WHEN contains(lower(k.intent), lower(p.intent)) THEN 1.2::DOUBLE ELSE 0.5::DOUBLE END
        * CASE WHEN coalesce(p.concern, '') = '' THEN 1.0::DOUBLE WHEN lower(k.concern) = lower(p.concern) THEN 1.2::DOUBLE
               WHEN lower(p.concern) = 'high' THEN 0.5::DOUBLE WHEN lower(k.concern) = 'high' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END, 9) AS score
        FROM near n JOIN kb k USING (doc_id) JOIN said p USING (query_id) WHERE n.sim >= 0.3::DOUBLE)""",
    """near_place AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM near_boost QUALIFY place <= 3)""",
    f"""cited AS (SELECT query_id, doc_id, intent, concern, sim, text, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank
        FROM near_place WHERE NOT {_UNSAFE})""",
]


@query(
    "post_retrieval",
    sql.with_ctes(POST_SNIPPETS, "SELECT query_id, rank, doc_id, intent, concern, round(sim, 6) AS similarity, md5(text) AS text_md5 FROM cited"),
)
def post_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return post_snippets(spark, sf).select(
        "query_id", "rank", "doc_id", "intent", "concern", F.round("similarity", 6).alias("similarity"), F.md5("text").alias("text_md5")
    )
