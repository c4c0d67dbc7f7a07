"""Registered queries: prompts, reply checks, the retry ladder, routing, quality scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx, rules
from ..functions.text import word_set
from ..operators import quality, replies, retrieval, tagging
from ..sources import sinks
from ..sources.storage import shared_folder, side_session
from . import inputs, search, sql
from .inputs import PAIRS, pairs, said
from .registry import Registry
from .tagging import crisis_sql, message_sql

registry = Registry()
query = registry.query

# --- SQL pieces ---------------------------------------------------------------


def reject_sql(c: str) -> str:
    low = f"lower({c})"
    real = f"len(list_filter(string_split_regex({c}, '[.!?]+'), lambda s: length({sql.strip('s')}) > 10))"
    return f"""CASE WHEN length({c}) < 40 THEN 'too short' WHEN NOT regexp_matches({c}, '^[A-Z]') THEN 'no capital'
        WHEN {sql.contains_any(low, lx.LEAKAGE_MARKERS)} THEN 'leakage' WHEN {sql.contains_any(low, lx.PERSONA_MARKERS)} THEN 'persona'
        WHEN {sql.contains_any(low, lx.TOXIC_MARKERS)} THEN 'toxic'
        WHEN contains({c}, '**') OR length({c}) - length(replace({c}, '-', '')) > 6 OR length({c}) - length(replace({c}, '•', '')) > 4 THEN 'list format'
        WHEN {real} < 2 AND length({c}) < 60 THEN 'too few sentences' END"""


def repaired_sql(c: str) -> str:
    # No look-behind in RE2: a last mark after a digit is skipped by asking for a non-digit before it.
    marked = f"regexp_extract({c}, '^((?s:.*)[^\\p{{Nd}}][.!?])', 1)"
    whole = f"CASE WHEN {marked} <> '' THEN {marked} WHEN regexp_matches({c}, '^[.!?]') THEN substr({c}, 1, 1) ELSE '' END"
    dotted = f"regexp_extract({c}, '^((?s:.*)\\.)', 1)"
    listed = f"regexp_matches({sql.strip(c)}, '(?:First|Second|Third)[{sql.BLANK}]*,?$')"
    return f"""CASE WHEN coalesce({c}, '') = '' THEN {sql.q(lx.APOLOGY)} WHEN regexp_matches({c}, '[.!?][{sql.BLANK}]*$') THEN {sql.q(lx.APOLOGY)}
        WHEN {whole} <> '' THEN {whole} WHEN {dotted} <> '' THEN {dotted}
        WHEN {listed} THEN regexp_replace({c}, ' [^ ]*$', '') || '.' ELSE {sql.q(lx.APOLOGY)} END"""


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Three attempts per post: a bank reply, the lower-cased answer, the answer itself."""
    mix = F.col("conv_id") * 7 + F.col("turn")
    return pairs(spark, sf).select(
        F.col("query_id").alias("post_id"),
        F.posexplode(F.array(inputs.pick(inputs.REPLIES, mix), F.lower("reply"), F.substr("reply", F.lit(2)))).alias("attempt", "reply"),
    )


_CANDIDATES = f"""candidates AS (SELECT query_id AS post_id, 0 AS attempt, {sql.pick(inputs.REPLIES, '(conv_id * 7 + turn)')} AS reply FROM pairs
    UNION ALL SELECT query_id, 1, lower(reply) FROM pairs UNION ALL SELECT query_id, 2, substr(reply, 2) FROM pairs)"""


@query(
    "reply_validity",
    sql.with_ctes([PAIRS, _CANDIDATES], f"SELECT post_id, attempt, coalesce({reject_sql('reply')}, 'valid') AS verdict FROM candidates"),
)
def reply_validity(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.coalesce(rules.reject_reason(F.col("reply")), F.lit("valid"))
    return _candidates(spark, sf).select("post_id", "attempt", verdict.alias("verdict"))


@query(
    "banned_phrases",
    sql.with_ctes([PAIRS, _CANDIDATES], f"SELECT post_id, attempt, {sql.contains_any('lower(reply)', lx.BANNED_PHRASES)} AS banned FROM candidates"),
)
def banned_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("post_id", "attempt", rules.banned_phrase(F.col("reply")).alias("banned"))


@query(
    "first_valid_reply",
    sql.with_ctes(
        [
            PAIRS,
            _CANDIDATES,
            f"judged AS (SELECT *, {reject_sql('reply')} AS why FROM candidates)",
            """best AS (SELECT post_id, min_by(reply, attempt) FILTER (WHERE why IS NULL) AS accepted, max_by(reply, attempt) AS last,
               count(*) FILTER (WHERE why IS NOT NULL) AS n_rejected FROM judged GROUP BY post_id)""",
        ],
        f"SELECT post_id, md5(coalesce(accepted, {repaired_sql('last')})) AS reply_md5, accepted IS NOT NULL AS was_valid, n_rejected FROM best",
    ),
)
def first_valid_reply(spark: SparkSession, sf: str) -> DataFrame:
    best = replies.first_valid(_candidates(spark, sf))
    return best.select("post_id", F.md5("reply").alias("reply_md5"), "was_valid", "n_rejected")


@query("reply_repair", sql.with_ctes([PAIRS], f"SELECT query_id, md5({repaired_sql('reply')}) AS reply_md5 FROM pairs"))
def reply_repair(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select("query_id", F.md5(rules.repaired(F.col("reply"))).alias("reply_md5"))


# A snippet that half of the replies quote: the post of the next-but-one turn mixes with the reply.
_QUOTED = "CASE WHEN turn % 4 = 0 THEN substr(reply, 5) ELSE post END"


@query(
    "grounded_overlap",
    sql.with_ctes(
        [
            PAIRS,
            f"quoted AS (SELECT query_id, reply, {_QUOTED} AS snippet FROM pairs)",
            f"sets AS (SELECT *, {sql.word_set('reply')} AS mine, {sql.word_set('snippet')} AS theirs FROM quoted)",
            "hits AS (SELECT *, len(list_intersect(mine, theirs)) AS overlap, len(list_intersect(mine, theirs)) / greatest(len(mine), 1)::DOUBLE AS ratio FROM sets)",
        ],
        """SELECT query_id, overlap, round(ratio, 6) AS ratio, overlap >= 3 AND ratio >= 0.08::DOUBLE AS grounded,
        length(snippet) > 60 AND len(list_filter(range(1, length(snippet) - 59), lambda i: contains(lower(reply), substr(lower(snippet), i, 60)))) > 0 AS copied FROM hits""",
    ),
)
def grounded_overlap(spark: SparkSession, sf: str) -> DataFrame:
    snippet = F.when(F.col("turn") % 4 == 0, F.substr("reply", F.lit(5))).otherwise(F.col("post"))
    checked = replies.checked_replies(pairs(spark, sf).select("query_id", "reply", snippet.alias("snippet")), "reply", "snippet")
    return checked.select("query_id", "overlap", F.round("ratio", 6).alias("ratio"), "grounded", "copied")


# --- prompts, citations, routing ----------------------------------------------

_LINES = "lines AS (SELECT query_id, string_agg('- ' || replace(substr(text, 1, 250), chr(10), ' ') || chr(10), '' ORDER BY rank) AS ctx FROM cited GROUP BY query_id)"


def _cited(spark: SparkSession, sf: str, posts: DataFrame | None = None, *, with_vector: bool = False) -> DataFrame:
    return retrieval.citations(search.post_snippets(spark, sf, posts, with_vector=with_vector))


@query(
    "prompt_text",
    sql.with_ctes(
        [*search.POST_SNIPPETS, _LINES],
        f"""SELECT query_id, md5(substr({sql.q(lx.PROMPT_INSTRUCTION + lx.PROMPT_CONTEXT)} || coalesce(ctx, '') || chr(10) || {sql.q(lx.PROMPT_POST)}
        || post || chr(10) || chr(10) || {sql.q(lx.PROMPT_TASK)}, 1, 2000)) AS prompt_md5 FROM said LEFT JOIN lines USING (query_id)""",
    ),
)
def prompt_text(spark: SparkSession, sf: str) -> DataFrame:
    prompted = replies.with_prompt(said(spark, sf).select("query_id", "post"), _cited(spark, sf))
    return prompted.select("query_id", F.md5("prompt").alias("prompt_md5"))


@query(
    "citations_nested",
    sql.with_ctes(
        search.POST_SNIPPETS,
        "SELECT query_id, count(*) AS n, string_agg(doc_id, '|' ORDER BY rank) AS doc_ids, string_agg(intent || '/' || concern, '|' ORDER BY rank) AS labels FROM cited GROUP BY query_id",
    ),
)
def citations_nested(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("citations")
    return _cited(spark, sf).select(
        "query_id",
        F.size(c).alias("n"),
        F.array_join(c["doc_id"], "|").alias("doc_ids"),
        F.array_join(F.transform(c, lambda s: F.concat(s["intent"], F.lit("/"), s["concern"])), "|").alias("labels"),
    )


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Full path: crisis gate, retrieval for the others, extractive reply, footer."""
    leveled = tagging.with_crisis(said(spark, sf), "post", "concern")
    cited = _cited(spark, sf, leveled.where("crisis_level <> 'immediate'"))
    ready = leveled.join(cited, "query_id", "left").withColumn("candidate", replies.extractive_reply(F.col("citations")["text"]))
    return replies.answered(ready)


_EXTRACT = f"nullif(array_to_string(list_slice({sql.sentences('t')}, 1, 2), ' '), '')"
_ANSWERS = [
    *search.POST_SNIPPETS,
    "first_text AS (SELECT query_id, text AS t FROM cited WHERE rank = 1)",
    "n_cited AS (SELECT query_id, count(*) AS n FROM cited GROUP BY query_id)",
    f"gated AS (SELECT p.query_id, p.post, p.concern, {crisis_sql('lower(p.post)', 'p.concern')} AS level, coalesce(n, 0) AS n, {_EXTRACT} AS candidate FROM said p LEFT JOIN n_cited USING (query_id) LEFT JOIN first_text USING (query_id))",
    f"""bodies_out AS (SELECT *, CASE WHEN n = 0 THEN {sql.q(lx.NO_SNIPPET_REPLY)} ELSE coalesce(candidate,
        CASE WHEN lower(concern) = 'high' THEN {sql.q(lx.NO_REPLY_HIGH)} ELSE {sql.q(lx.NO_REPLY_OTHER)} END) END AS body FROM gated)""",
    f"answers AS (SELECT *, CASE WHEN level = 'immediate' THEN {message_sql('level')} ELSE body || {message_sql('level')} END AS reply FROM bodies_out)",
]


@query(
    "crisis_routing",
    sql.with_ctes(
        _ANSWERS,
        """SELECT query_id, level AS crisis_level, CASE WHEN level = 'immediate' THEN 0 ELSE n END AS n_citations, md5(reply) AS reply_md5,
        n = 0 AND level <> 'immediate' AS warned FROM answers""",
    ),
)
def crisis_routing(spark: SparkSession, sf: str) -> DataFrame:
    return _answers(spark, sf).select(
        "query_id",
        "crisis_level",
        F.size("citations").alias("n_citations"),
        F.md5("reply").alias("reply_md5"),
        F.col("warning").isNotNull().alias("warned"),
    )


@query(
    "extractive_replies",
    sql.with_ctes(
        _ANSWERS,
        """SELECT count(*) FILTER (WHERE candidate IS NOT NULL) AS n_ok, count(*) FILTER (WHERE candidate IS NULL) AS n_fail FROM gated""",
    ),
)
def extractive_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Default generator over all posts; a post without snippets is a failed row.  Counted while the records are written."""
    side = side_session(spark)
    made = said(side, sf).join(_cited(side, sf), "query_id", "left").select(
        "post",
        F.lit(None).cast("string").alias("predicted_intents"),
        F.col("concern").alias("predicted_concern"),
        replies.extractive_reply(F.col("citations")["text"]).alias("reply"),
        "citations",
    )
    records = replies.prediction_records(made.withColumn("error", F.when(F.col("reply").isNull(), "no snippet")))
    failed = F.col("error").isNotNull()
    path = shared_folder(spark, "predictions")
    seen = sinks.counted(records, lambda df: sinks.write_jsonl(df, path, keep_nulls=False), n_ok=F.count_if(~failed), n_fail=F.count_if(failed))
    return spark.createDataFrame([(seen["n_ok"], seen["n_fail"])], "n_ok long, n_fail long")


# --- quality ------------------------------------------------------------------


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_replies(pairs(spark, sf).join(_cited(spark, sf, with_vector=True), "query_id", "left"), "query_id")


_QUALITY = [
    *search.POST_SNIPPETS,
    *sql.encoded("reply_vec", "pairs", "query_id", "reply"),
    "cited_lower AS (SELECT query_id, rank, query_id || '#' || rank AS cid, lower(text) AS text FROM cited)",
    *sql.encoded("cite_vec", "cited_lower", "cid", "text"),
    """sims AS (SELECT c.query_id, c.rank, list_inner_product(v.vec, r.vec) AS s FROM cited_lower c JOIN cite_vec v USING (cid) JOIN reply_vec r USING (query_id)
        QUALIFY row_number() OVER (PARTITION BY c.query_id ORDER BY s DESC) <= 3)""",
    "sem AS (SELECT query_id, round(avg(s), 9) AS sem FROM sims GROUP BY query_id)",
    f"cite_words AS (SELECT query_id, list_distinct(flatten(list({sql.word_set('text', True)}))) AS w FROM cited_lower GROUP BY query_id)",
    f"""lex AS (SELECT p.query_id, round(len(list_intersect({sql.word_set('p.reply', True)}, w)) / greatest(len({sql.word_set('p.reply', True)}), 1)::DOUBLE, 9) AS lex
        FROM pairs p JOIN cite_words USING (query_id))""",
    f"""raw AS (SELECT p.query_id, p.post, round(list_inner_product(pv.vec, rv.vec), 9) AS sim, sem, lex,
        CASE WHEN {sql.contains_any('lower(p.reply)', lx.QUALITY_UNSAFE_PHRASES)} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS safety,
        CASE WHEN {sql.contains_any('lower(p.post)', lx.QUALITY_CRISIS_WORDS)} AND NOT {sql.contains_any('lower(p.reply)', lx.FOOTER_MARKERS)} THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS crisis
        FROM pairs p JOIN post_vec pv USING (query_id) JOIN reply_vec rv USING (query_id) LEFT JOIN sem USING (query_id) LEFT JOIN lex USING (query_id))""",
    """parts_q AS (SELECT *, least(1.0::DOUBLE, (sim + 0.1::DOUBLE) * 1.5::DOUBLE) * CASE WHEN sim < 0.03::DOUBLE THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS relevance,
        CASE WHEN sem IS NULL THEN 0.0::DOUBLE ELSE greatest(0.05::DOUBLE, least(1.0::DOUBLE, 0.6::DOUBLE * sem + 0.4::DOUBLE * lex)) END AS grounding FROM raw)""",
    """finals AS (SELECT *, round(0.30::DOUBLE * relevance + 0.45::DOUBLE * grounding + 0.20::DOUBLE * safety + 0.05::DOUBLE * crisis, 9) AS fin FROM parts_q)""",
    """graded AS (SELECT query_id, substr(post, 1, 100) AS post, round(relevance, 3) AS relevance, round(grounding, 3) AS grounding, safety, crisis, round(fin, 3) AS final,
        CASE WHEN fin >= 0.78::DOUBLE THEN 'A' WHEN fin >= 0.62::DOUBLE THEN 'B' WHEN fin >= 0.48::DOUBLE THEN 'C' WHEN fin >= 0.32::DOUBLE THEN 'D' ELSE 'F' END AS grade FROM finals)""",
]


@query("reply_grades", sql.with_ctes(_QUALITY, "SELECT * FROM graded"))
def reply_grades(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)


@query(
    "grade_report",
    sql.with_ctes(
        [*_QUALITY, "grades AS (SELECT unnest(['A', 'B', 'C', 'D', 'F']) AS grade)", "overall AS (SELECT round(avg(final), 6) AS mean_final, round(median(final), 6) AS median_final FROM graded)"],
        "SELECT g.grade, count(d.query_id) AS n, any_value(mean_final) AS mean_final, any_value(median_final) AS median_final FROM grades g LEFT JOIN graded d USING (grade), overall GROUP BY g.grade",
    ),
)
def grade_report(spark: SparkSession, sf: str) -> DataFrame:
    report = quality.grade_report(_scored(spark, sf))
    return report.withColumn("mean_final", F.round("mean_final", 6)).withColumn("median_final", F.round("median_final", 6))


@query("lowest_replies", sql.with_ctes(_QUALITY, "SELECT query_id, final, grade FROM graded ORDER BY final, query_id LIMIT 10"))
def lowest_replies(spark: SparkSession, sf: str) -> DataFrame:
    return quality.lowest(_scored(spark, sf), "query_id").select("query_id", "final", "grade")


@query(
    "word_overlap",
    sql.with_ctes(
        [PAIRS],
        f"""SELECT query_id, {sql.shared(sql.word_set('post', True), sql.word_set('reply', True))} AS shared,
        len(list_distinct(list_concat({sql.word_set('post', True)}, {sql.word_set('reply', True)}))) AS either FROM pairs""",
    ),
)
def word_overlap(spark: SparkSession, sf: str) -> DataFrame:
    sets = pairs(spark, sf).select(
        "query_id", word_set(F.col("post"), True).alias("a"), word_set(F.col("reply"), True).alias("b")
    )
    return sets.select("query_id", rules.word_overlap(F.col("a"), F.col("b")).alias("shared"), F.size(F.array_union("a", "b")).alias("either"))
