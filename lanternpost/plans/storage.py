"""Registered queries: file round trips, noisy JSON, prediction shapes, streams, routed logs.

Files go to a new folder under the session's checkpoint directory and hold data made
from the provided tables; the result is what is read back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as lb
from ..functions.vectors import encoded
from ..operators import metrics, quality, replies, retrieval, tagging
from ..sources import multiline, readers, schemas, sinks
from ..sources.storage import shared_folder, stored
from ..streaming import jobs
from . import evaluation, inputs, search, sql
from .inputs import PAIRS, POSTS, pairs, posts, table
from .registry import Registry
from .tagging import TAGGED, LITERAL_PIECES, crisis_sql, ordered_unique, tag_name_sql

registry = Registry()
query = registry.query


# --- CSV ----------------------------------------------------------------------


_POST_TABLE = f"""WITH {POSTS}, {ordered_unique(LITERAL_PIECES, tag_name_sql('raw'))}
    SELECT md5('"' || post || chr(10) || '"') AS post_md5, coalesce(l.tags, 'Miscellaneous') AS tags FROM posts p LEFT JOIN listed l USING (doc_id)"""


def _post_table(spark: SparkSession, sf: str, read: Callable[[SparkSession, str, T.StructType], DataFrame]) -> DataFrame:
    quoted = F.concat(F.lit('"'), "post", F.lit('\n"'))
    path = shared_folder(spark, "posts-csv")
    sinks.write_csv(posts(spark, sf).select(quoted.alias("Text"), F.col("tag").alias("Final_Tags")), path)
    schema = T.StructType([T.StructField("Text", T.StringType()), T.StructField("Final_Tags", T.StringType())])
    parsed = tagging.post_table(read(spark, path, schema))
    return parsed.select(F.md5("Post").alias("post_md5"), lb.joined(F.col("TagsList")).alias("tags"))


@query("csv_post_table", _POST_TABLE)
def csv_post_table(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with newlines and quotes written as CSV, read back and canonicalised."""
    return _post_table(spark, sf, readers.read_csv)


@query("csv_post_table_parallel", _POST_TABLE)
def csv_post_table_parallel(spark: SparkSession, sf: str) -> DataFrame:
    """The same table with the quoted newlines resolved across file ranges, many tasks per file."""
    return _post_table(spark, sf, multiline.read_csv_parallel)


# --- JSON lines ---------------------------------------------------------------


@query(
    "jsonl_knowledge_base",
    sql.with_ctes(inputs.KB, "SELECT doc_id, 'csv' AS source, intent, concern, '' AS tags, md5(text) AS text_md5, md5(text) AS corpus_md5 FROM kb"),
)
def jsonl_knowledge_base(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus and metadata written in one pass, read back and joined by id."""
    folder = shared_folder(spark, "kb")
    sinks.write_knowledge_base(inputs.kb_chunks(spark, sf), f"{folder}/corpus", f"{folder}/metadata")
    corpus = readers.read_jsonl(spark, f"{folder}/corpus", schemas.KB_CORPUS)
    meta = readers.read_jsonl(spark, f"{folder}/metadata", schemas.KB_METADATA)
    return meta.join(corpus.select("doc_id", F.md5("text").alias("corpus_md5")), "doc_id").select(
        "doc_id", "source", "intent", "concern", "tags", F.md5("text").alias("text_md5"), "corpus_md5"
    )


@query(
    "vector_table",
    sql.with_ctes(
        sql.encoded("enc", "documents", "doc_id", "text"),
        "SELECT doc_id, len(vec)::INT AS dim, round(list_sum(list_transform(vec, lambda x: x * x)), 4) AS squared FROM enc",
    ),
)
def vector_table(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors stored as float arrays by id and loaded again."""
    path = shared_folder(spark, "vectors")
    made = table(spark, sf, "documents").select("doc_id", encoded(F.col("text")).alias("embedding"))
    sinks.write_vectors(made, path)
    v = F.col("embedding").cast("array<double>")
    squared = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    return sinks.read_vectors(spark, path).select("doc_id", F.size("embedding").alias("dim"), F.round(squared, 4).alias("squared"))


def _noisy(doc: Column) -> Column:
    """A line per row: a whole object, an object after log text, an object before log text, or no object."""
    body = F.to_json(F.struct(F.col("lang").alias("intent"), F.concat(F.lit("r{"), "doc_id", F.lit("}\n"), "text").alias("post")))
    return (
        F.when(doc % 4 == 0, body)
        .when(doc % 4 == 1, F.concat(F.lit("DEBUG: loaded\nWARN "), body, F.lit("\nbye")))
        .when(doc % 4 == 2, F.concat(body, F.lit(" done")))
        .otherwise("no object here")
    )


@query(
    "json_salvage",
    """SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN lang END AS intent, CASE WHEN doc_id % 4 < 2 THEN md5('r{' || doc_id || '}' || chr(10) || text) END AS post_md5,
    doc_id % 4 >= 2 AS failed FROM documents""",
)
def json_salvage(spark: SparkSession, sf: str) -> DataFrame:
    noisy = table(spark, sf, "documents").select("doc_id", _noisy(F.col("doc_id")).alias("line"))  # every text stands inside its object
    found = noisy.withColumn("o", readers.salvaged_json(F.col("line"), schemas.GOLD))
    return found.select("doc_id", F.col("o.intent").alias("intent"), F.md5("o.post").alias("post_md5"), F.col("o").isNull().alias("failed"))


@query(
    "malformed_lines",
    """SELECT count(*) AS n_lines, count(*) FILTER (WHERE doc_id % 5 < 3) AS n_ok, count(*) FILTER (WHERE doc_id % 5 >= 3) AS n_skipped FROM documents""",
)
def malformed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that are broken or lack a post are skipped and counted in the pass that writes the others; blank lines do not count."""
    doc = F.col("doc_id")
    good = F.to_json(F.struct(F.col("text").alias("post"), F.col("lang").alias("intent")))
    line = (
        F.when(doc % 5 == 3, '{"post": "cut off')
        .when(doc % 5 == 4, F.to_json(F.struct(F.lit("x").alias("intent"))))
        .when(doc % 5 == 2, F.concat(F.lit("\n"), good, F.lit("\n")))
        .otherwise(good)
    )
    path = shared_folder(spark, "gold")
    table(spark, sf, "documents").select(line.alias("value")).write.mode("overwrite").text(path)
    kept = shared_folder(spark, "usable")
    seen = readers.keep_usable(spark, path, schemas.GOLD, "post", kept)
    return spark.createDataFrame([(seen["n_lines"], spark.read.schema(schemas.GOLD).json(kept).count(), seen["n_skipped"])], "n_lines long, n_ok long, n_skipped long")


@query(
    "two_shape_predictions",
    f"WITH {PAIRS} SELECT md5(post) AS post_md5, CASE WHEN turn % 8 = 4 THEN '' ELSE reply END AS reply, CASE WHEN turn % 4 = 0 THEN 0 ELSE 1 END AS n_citations, CASE WHEN turn % 4 = 0 THEN '' ELSE ['text', 'snippet', 'content'][turn % 3 + 1] || turn END AS cited FROM pairs",
)
def two_shape_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Flat and wrapped records in one file; the wrapper wins where it is present, and a citation's text may have three names."""
    field = lambda name, k: F.when(F.col("turn") % 3 == k, F.concat(F.lit(name), "turn")).alias(name)
    cited = F.array(F.struct(F.lit("d").alias("doc_id"), field("text", 0), field("snippet", 1), field("content", 2)))
    base = pairs(spark, sf).select("post", "reply", "turn")
    flat = base.where("turn % 4 <> 0").select("post", "reply", cited.alias("citations"))
    wrapped = base.where("turn % 4 = 0").select(
        "post", F.struct(F.when(F.col("turn") % 8 == 0, F.col("reply")).alias("reply"), F.lit("none").alias("crisis_level")).alias("rag_output")
    )
    path = shared_folder(spark, "predictions")
    sinks.write_jsonl(flat.unionByName(wrapped, allowMissingColumns=True), path, keep_nulls=False)
    read = readers.either_shape(readers.read_jsonl(spark, path, schemas.ANY_PREDICTION))
    texts = quality.snippet_texts(F.col("citations"), quality.text_fields(read))
    return read.select(F.md5("post").alias("post_md5"), "reply", F.size("citations").alias("n_citations"), F.array_join(texts, "|").alias("cited"))


@query(
    "search_export",
    sql.with_ctes(
        [
            *search.BASE,
            search.TOP.format(k=5),
        ],
        "SELECT query_id, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY r) AS doc_ids FROM top GROUP BY query_id",
    ),
)
def search_export(spark: SparkSession, sf: str) -> DataFrame:
    """Nested search results, one record per query, exported and read back."""
    queries = inputs.vector_queries(spark, sf).withColumn("intents", F.array().cast("array<string>")).withColumn("concern", F.lit(None).cast("string"))
    found = retrieval.filtered_search(queries, inputs.snippet_vectors(spark, sf), topk=5, keep=5)
    nested = retrieval.search_documents(found, queries.withColumn("query", F.concat(F.lit("vector "), "query_id")), 280)
    path = shared_folder(spark, "search")
    sinks.write_search_results(nested, path)
    read = readers.read_jsonl(spark, path, nested.schema)
    ids = F.col("results")["doc_id"].cast("array<string>")
    return read.select("query_id", F.size("results").alias("n"), F.array_join(ids, ",").alias("doc_ids"))


@query(
    "metrics_document",
    sql.with_ctes(
        evaluation.said_rows("prob >= 0.6::DOUBLE"),
        f"SELECT 'baseline_r1' AS run_id, label, round({evaluation.F1_SQL}, 6) AS f1, round((SELECT avg({evaluation.F1_SQL}) FROM counts), 6) AS macro_f1 FROM counts",
    ),
)
def metrics_document(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics with a per-label map, stored under the run and read back."""
    counts = evaluation.counts_at(spark, sf, 0.6)
    per_label = metrics.per_label_f1(counts).agg(F.map_from_entries(F.collect_list(F.struct("label", "f1"))).alias("per_label_f1"))
    document = per_label.withColumn("macro_f1", metrics.f1_scores(counts).select("macro_f1").scalar())
    path = shared_folder(spark, "metrics")
    sinks.write_metrics(document, path, "baseline", "r1")
    schema = "per_label_f1 map<string, double>, macro_f1 double, run_id string"
    read = spark.read.schema(schema).json(path)
    return read.select("run_id", F.explode("per_label_f1").alias("label", "f1"), "macro_f1").select(
        "run_id", "label", F.round("f1", 6).alias("f1"), F.round("macro_f1", 6).alias("macro_f1")
    )


# --- streams and logs ---------------------------------------------------------


def _table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A provided table as a stream of files, be it one file or a folder of them."""
    rows = table(spark, sf, name)
    some = rows.select("_metadata.file_name").first()
    if some is None or some["file_name"] == f"{name}.parquet":
        return jobs.file_stream(spark, sf, rows.schema, fmt="parquet", files=f"{name}.parquet")
    return jobs.file_stream(spark, f"{sf}/{name}.parquet", rows.schema, fmt="parquet", files="*.parquet")


@query(
    "stream_scoring",
    sql.with_ctes(
        [
            f"turns AS (SELECT conv_id, turn, text || ' ' || {sql.pick(inputs.PHRASES, '(conv_id + turn)')} AS post FROM conversations WHERE role = 'user')",
            *[p.replace("FROM posts", "FROM turns") for p in TAGGED[1:]],
        ],
        f"SELECT conv_id, turn, intent, {crisis_sql('low', 'NULL')} AS crisis_level FROM tagged",
    ),
)
def stream_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """User turns scored as a stream into a file sink; equal to the batch result."""
    turns = _table_stream(spark, sf, "conversations").where("role = 'user'")
    planted = F.concat("text", F.lit(" "), inputs.pick(inputs.PHRASES, F.col("conv_id") + F.col("turn")))
    folder = shared_folder(spark, "scoring")
    started = jobs.start_scoring(turns.select("conv_id", "turn", planted.alias("post")), f"{folder}/out", f"{folder}/state")
    started.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("conv_id", "turn", "intent", "crisis_level")


_EVENT_LEVEL = "CASE WHEN event_type = 'error' AND value > 50 THEN 'immediate' WHEN event_type = 'error' THEN 'high' WHEN value > 20 THEN 'medium' ELSE 'none' END"
_ROUTED = f"""SELECT CASE WHEN level IN ('immediate', 'high') THEN 'high_risk' ELSE 'general' END AS bucket, strftime(ts, '%Y%m%d') AS day,
    count(*) AS n, count(*) FILTER (WHERE level IN ('immediate', 'high')) AS to_review, sum(length(props))::BIGINT AS post_chars,
    count(DISTINCT md5(props)) AS posts FROM (SELECT *, {_EVENT_LEVEL} AS level FROM events) GROUP BY ALL"""


def _interactions(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("at"),
        F.col("props").alias("post"),
        F.col("event_type").alias("reply"),
        F.expr(_EVENT_LEVEL).alias("level"),
        F.lit(None).cast("string").alias("concern"),
    )


_COLUMNS = {"at": "at", "post": "post", "reply": "reply", "level": "level", "concern": "concern"}


def _log_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("bucket", "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("requires_review").alias("to_review"),
        F.sum("post_length").alias("post_chars"),
        F.countDistinct("post_hash").alias("posts"),
    )


@query("routed_log_counts", _ROUTED)
def routed_log_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Audit records appended under bucket and day as one batch, twice, then counted from the files."""
    records = replies.audit_records(_interactions(table(spark, sf, "events")), snippets=F.lit(0), **_COLUMNS)
    path = shared_folder(spark, "log")
    for _ in range(2):  # the second time the batch is known
        sinks.append_log(records, path, "events")
    return _log_counts(sinks.read_log(spark, path))


@query("streamed_log_counts", _ROUTED)
def streamed_log_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The same log written by a stream, one folder per micro-batch."""
    events = _table_stream(spark, sf, "events")
    folder = shared_folder(spark, "stream-log")
    started = jobs.start_audit_log(_interactions(events), f"{folder}/out", f"{folder}/state", snippets=F.lit(0), **_COLUMNS)
    started.awaitTermination()
    return _log_counts(sinks.read_log(spark, f"{folder}/out"))


# Each event reaches the stream twice, up to six hours late, in one of three arrivals.
_DELAY_HOURS, _LATE_HOURS = 6, 12
_ARRIVALS = 3
_CLOSED = f"""SELECT date_trunc('hour', ts) AS start, CASE WHEN level IN ('immediate', 'high') THEN 'high_risk' ELSE 'general' END AS bucket,
    count(*) AS n, count(*) FILTER (WHERE level IN ('immediate', 'high')) AS to_review FROM (SELECT *, {_EVENT_LEVEL} AS level FROM events)
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL {_LATE_HOURS} HOUR GROUP BY ALL"""


@query("review_counts_by_hour", _CLOSED)
def review_counts_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    """Closed hours of a stream whose rows come out of order and twice, in several runs of one checkpoint."""
    folder = shared_folder(spark, "reviews")
    events = table(spark, sf, "events")
    ends = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    span = (ends["last"] - ends["first"]).total_seconds() + _DELAY_HOURS * 3600 + 1
    made = replies.audit_records(_interactions(events.withColumn("props", F.col("event_id").cast("string"))), snippets=F.lit(0), **_COLUMNS)
    copies = made.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    delay = F.pmod(F.xxhash64("post_hash", "copy"), F.lit(_DELAY_HOURS * 3600))
    since = F.unix_timestamp("timestamp") - int(ends["first"].timestamp()) + delay
    arrival = F.least(F.floor(since / F.lit(span / _ARRIVALS)), F.lit(_ARRIVALS - 1)).cast("int")
    arriving = stored(copies.withColumn("arrival", arrival).drop("copy"), "arriving")
    for i in range(_ARRIVALS):
        arriving.where(F.col("arrival") == i).drop("arrival").write.mode("append").parquet(f"{folder}/in")
        stream = jobs.file_stream(spark, f"{folder}/in", arriving.drop("arrival").schema, fmt="parquet", files="*.parquet")
        jobs.start_review_counts(stream, f"{folder}/out", f"{folder}/state", late=f"{_LATE_HOURS} hours").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("start", "bucket", "n", "to_review")
