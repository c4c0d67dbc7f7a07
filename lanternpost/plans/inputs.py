"""Roles the provided tables play, as Spark frames and as SQL for the comparison.

The texts are invented prose, so phrases, tags and levels from small banks are added
to every row of a table; the row's id picks the entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.vectors import cosine, encoded_in_batches
from ..operators.knowledge import chunk_rows
from ..operators.vector_index import VectorIndex, build
from ..sources.readers import table
from ..sources.storage import is_kept, shared_folder
from . import sql

PHRASES = [
    "i want to die", "planning to kill myself", "relapse after vodka", "any advice please help",
    "started zoloft last week", "journaling and meditation", "mood check-in", "my landlord evicts us",
    "so anxious and overwhelmed", "nothing special 💔", "my week was rough", "is it there, where?",
    "my feel is off", "i feel hopeless", "the quiet sky",
]
TAG_STRINGS = [
    "Mental Distress; Cause of Distress", "Causes of Distress", "critical risk., Seeking Help",
    "['Mood Tracking', 'Seeking Help']", "Progress Update. Cause of Distress",
    "Positive coping, positive Coping", "Critical Risk, Maladaptive Coping", "misc", "", None,
    "Mood Tracking,  positive   coping , seeking help", "Mental Distress, Cause of Distress., Positive Coping",
    '"Seeking Help", Progress Update', "['Mood Tracking', broken", "Progress Update, Mental Distress, Cause of Distress",
]
CONCERNS = ["Low", "med", "HIGH.", "1", "Mid ", "2", "unknown", "", None, "high", " Medium. "]
REPLIES = [
    "Stay calm.",
    "you are heard and there are people ready to listen to you today.",
    "Task: listen to the user and answer with care and kindness today.",
    "Reaching out helps. My family felt better once they talked it over together.",
    "It makes sense. A therapist could listen to every worry you carry today.",
    "Try - a - b - c - d - e - f - g and rest for a while each day.",
    "This reply is long enough but only one sentence",
    "Your feelings make sense. Small steps and rest can bring some relief over time.",
]
TAILS = [
    "", " Stay strong and rest", " item 3.", " call 988 today.", " nobody cares.", " In immediate danger? Call now!", " end",
]
SNIPPETS = [
    "a calm walk in the evening", "how to die is never the question", "pills to overdose", "better dead, and how",
    "jumping from one task to the next", "write down three good things", "talk to someone you trust",
]


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


# --- posts: documents with a phrase, a tag string and a concern string --------------------------


def posts(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat("text", F.lit(" "), pick(PHRASES, doc)).alias("post"),
        pick(TAG_STRINGS, doc).alias("tag"),
        pick(CONCERNS, doc).alias("concern"),
        "lang",
    )


POSTS = f"""posts AS (SELECT doc_id, text || ' ' || {sql.pick(PHRASES, 'doc_id')} AS post,
    {sql.pick(TAG_STRINGS, 'doc_id')} AS tag, {sql.pick(CONCERNS, 'doc_id')} AS concern, lang FROM documents)"""


# --- knowledge base: documents as answers -------------------------------------------------------


def kb_source(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("text").alias("output"),
        pick(lx.TAGS, doc).alias("Final_Intent_Tag"),
        pick(CONCERNS, doc).alias("Concern_Level"),
    )


def kb_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(kb_source(spark, sf))


def kb_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return kb_chunks(spark, sf).withColumn("vector", encoded_in_batches(F.col("text")))


_indexes: dict[tuple, str] = {}


def kb_index(spark: SparkSession, sf: str) -> VectorIndex:
    """Index of the encoded chunks, built once per session and state of the source files."""
    state = table(spark, sf, "documents").agg(F.max("_metadata.file_modification_time").alias("changed"), F.count(F.lit(1)).alias("n")).first()
    key = (spark.sparkContext.applicationId, sf, state["changed"], state["n"])
    if key not in _indexes or not is_kept(_indexes[key]):
        path = shared_folder(spark, "kb-index")
        build(kb_vectors(spark, sf), path, "doc_id", "vector", columns=["source", "intent", "concern", "text"])
        _indexes[key] = path
    return VectorIndex(spark, _indexes[key])


CHUNKS = sql.chunked("documents", "doc_id", "text")


def concern_kb_sql(c: str) -> str:
    raw = sql.strip(f"coalesce({c}, '')")
    return f"""CASE WHEN lower({raw}) IN ('0', 'low') THEN 'Low' WHEN lower({raw}) IN ('1', 'med', 'medium') THEN 'Medium'
        WHEN lower({raw}) IN ('2', 'high') THEN 'High' ELSE {raw} END"""


KB = [
    *CHUNKS,
    f"""kb AS (SELECT CASE WHEN n_pieces > 1 THEN doc_id::VARCHAR || '_c' || chunk_no ELSE doc_id::VARCHAR END AS doc_id,
        doc_id AS base, chunk_no, {sql.pick(lx.TAGS, 'doc_id')} AS intent, {concern_kb_sql(sql.pick(CONCERNS, 'doc_id'))} AS concern,
        text FROM chunked)""",
]
KB_VECTORS = [*KB, *sql.encoded("kb_vec", "kb", "doc_id", "text")]


# --- post and reply pairs: a user turn and the assistant turn after it ---------------------------


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Joined on conversation and turn, so one very long conversation spreads over all tasks."""
    turns = table(spark, sf, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("said"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    mix = F.col("conv_id") * 7 + F.col("turn")
    return users.join(answers, ["conv_id", "turn"]).select(
        F.concat("conv_id", F.lit("-"), "turn").alias("query_id"),
        "conv_id",
        "turn",
        F.concat("said", F.lit(" "), pick(PHRASES, mix)).alias("post"),
        F.concat("answer", pick(TAILS, mix)).alias("reply"),
        pick(CONCERNS, mix).alias("concern"),
        pick(lx.TAGS, mix).alias("intent"),
    )


_MIX = "(u.conv_id * 7 + u.turn)"
PAIRS = f"""pairs AS (SELECT u.conv_id || '-' || u.turn AS query_id, u.conv_id, u.turn,
    u.text || ' ' || {sql.pick(PHRASES, _MIX)} AS post, a.text || {sql.pick(TAILS, _MIX)} AS reply,
    {sql.pick(CONCERNS, _MIX)} AS concern, {sql.pick(lx.TAGS, _MIX)} AS intent
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant')"""


def said(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn, answered or not."""
    mix = F.col("conv_id") * 7 + F.col("turn")
    return table(spark, sf, "conversations").where("role = 'user'").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("query_id"),
        "conv_id",
        "turn",
        F.concat("text", F.lit(" "), pick(PHRASES, mix)).alias("post"),
        pick(CONCERNS, mix).alias("concern"),
        pick(lx.TAGS, mix).alias("intent"),
    )


SAID = f"""said AS (SELECT u.conv_id || '-' || u.turn AS query_id, u.conv_id, u.turn,
    u.text || ' ' || {sql.pick(PHRASES, _MIX)} AS post, {sql.pick(CONCERNS, _MIX)} AS concern, {sql.pick(lx.TAGS, _MIX)} AS intent
    FROM conversations u WHERE u.role = 'user')"""


# --- vector tables ------------------------------------------------------------------------------


def snippet_vectors(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("doc_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.lit("csv").alias("source"),
        pick(lx.TAGS, F.col("label")).alias("intent"),
        pick(["Low", "Medium", "High"], v).alias("concern"),
        pick(SNIPPETS, v).alias("text"),
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    wanted = pick(lx.TAGS, F.col("label") + 1)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.when(v % 4 == 0, F.array().cast("array<string>"))
        .when(v % 4 == 1, F.array(wanted))
        .otherwise(F.array(wanted, pick(lx.TAGS, F.col("label"))))
        .alias("intents"),
        pick(["high", "low", None, "medium", ""], v).alias("concern"),
    )


SNIPPETS_SQL = f"""snippets AS (SELECT vec_id AS doc_id, {sql.unit('embedding::DOUBLE[]')} AS vec,
    {sql.pick(lx.TAGS, 'label')} AS intent, {sql.pick(['Low', 'Medium', 'High'], 'vec_id')} AS concern,
    {sql.pick(SNIPPETS, 'vec_id')} AS text FROM embeddings)"""
QUERIES_SQL = f"""queries AS (SELECT vec_id AS query_id, {sql.unit('embedding::DOUBLE[]')} AS vec,
    CASE WHEN vec_id % 4 = 0 THEN []::VARCHAR[] WHEN vec_id % 4 = 1 THEN [{sql.pick(lx.TAGS, 'label + 1')}]
         ELSE [{sql.pick(lx.TAGS, 'label + 1')}, {sql.pick(lx.TAGS, 'label')}] END AS intents,
    {sql.pick(['high', 'low', None, 'medium', ''], 'vec_id')} AS want FROM embeddings)"""


# --- predictions: similarity of each vector with each label's mean vector -------------------------

LABELS = [f"class {i}" for i in range(10)]


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(row_id, truth array<int>, prob array<double>, logit array<double>, label).

    The table of mean vectors has one row per label and is used as a scalar.
    """
    base = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    sums = base.select("label", F.posexplode("v").alias("d", "x")).groupBy("label", "d").agg(F.avg("x").alias("x"))
    means = sums.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("mean")
    )
    ordered = means.agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("m"))
    prob = F.transform("__m", lambda m: F.round((1.0 + cosine(F.col("v"), m["mean"])) / 2.0, 6))
    own = [
        ((F.col("label") == i) | ((F.col("vec_id") % 3 == 0) & ((F.col("label") + 1) % len(LABELS) == i))).cast("int")
        for i in range(len(LABELS))
    ]
    return (
        base.withColumn("__m", ordered.scalar())
        .withColumn("prob", prob)
        .select(
            F.col("vec_id").alias("row_id"),
            "label",
            F.array(*own).alias("truth"),
            "prob",
            F.transform("prob", lambda p: F.round(8.0 * (p - 0.5), 6)).alias("logit"),
        )
    )


PREDICTIONS = [
    "base AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)",
    "dims AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM base)",
    "mean_dims AS (SELECT label, d, avg(x) AS x FROM dims GROUP BY ALL)",
    "means AS (SELECT label AS l, list(x ORDER BY d) AS mean FROM mean_dims GROUP BY label)",
    f"""long AS (SELECT vec_id AS row_id, b.label AS own, m.l AS i, 'class ' || m.l AS label,
        (b.label = m.l OR (vec_id % 3 = 0 AND (b.label + 1) % {len(LABELS)} = m.l))::INT AS truth,
        round((1.0::DOUBLE + list_cosine_similarity(b.v, m.mean)) / 2.0::DOUBLE, 6) AS prob FROM base b, means m)""",
]
