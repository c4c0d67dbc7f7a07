"""Registered queries: intent, crisis, concern, tag strings, text fields, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as lb, lexicon as lx, rules, text as tx
from ..operators import knowledge, lexicons, ordering, splits, summaries, tagging
from . import inputs, sql
from .inputs import POSTS, posts
from .registry import Registry

registry = Registry()
query = registry.query

# --- SQL pieces ---------------------------------------------------------------

_TEXT = sql.strip("coalesce(post, '')")
_SELF = sql.matches_any("low", lx.FIRST_PERSON)
INTENT_SQL = (
    "CASE "
    + " ".join(f"WHEN {sql.matches_any('low', ps)} THEN {sql.q(tag)}" for tag, ps in lx.INTENT_PATTERNS)
    + f" WHEN {sql.contains_any('t', lx.DISTRESS_EMOJI)} THEN 'Mental Distress'"
    + f" WHEN {_SELF} AND {sql.matches_any('low', lx.NEGATIVE_STATE)} THEN 'Mental Distress'"
    + f" WHEN t LIKE '%?' AND {sql.matches_any('low', lx.QUESTION_WORDS)} THEN 'Seeking Help'"
    + f" WHEN {_SELF} AND {sql.matches_any('low', lx.FEEL_WORDS)} THEN 'Mood Tracking'"
    + " ELSE 'Miscellaneous' END"
)
TAGGED = [
    POSTS,
    f"stripped AS (SELECT *, {_TEXT} AS t, lower({_TEXT}) AS low FROM posts)",
    f"tagged AS (SELECT *, {INTENT_SQL} AS intent FROM stripped)",
]


def crisis_sql(low: str, concern: str) -> str:
    worried = f"lower(coalesce({concern}, '')) = 'high'"
    now, high = sql.contains_any(low, lx.CRISIS_IMMEDIATE), sql.contains_any(low, lx.CRISIS_HIGH)
    return f"""CASE WHEN {now} THEN 'immediate' WHEN {worried} AND {high} THEN 'immediate' WHEN {worried} THEN 'high'
        WHEN {high} THEN 'high' WHEN {sql.contains_any(low, lx.CRISIS_MEDIUM)} THEN 'medium' ELSE 'none' END"""


def message_sql(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {sql.q(v)}" for k, v in lx.CRISIS_MESSAGES.items()) + " ELSE '' END"


LEVELED = [POSTS, f"leveled AS (SELECT *, {crisis_sql('lower(post)', 'concern')} AS level FROM posts)"]

TAG_NAMES = {t.lower(): t for t in lx.TAGS}


def tag_name_sql(c: str) -> str:
    key = f"replace(replace(regexp_replace(lower({sql.strip(c)}), '\\.$', ''), 'causes of distress', 'cause of distress'), 'progress update.', 'progress update')"
    return sql.lookup(TAG_NAMES, key)


def ordered_unique(pieces: str, name: str) -> str:
    """SQL over (doc_id, list) giving the first occurrences of the named pieces, default Miscellaneous."""
    return f"""parts AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS i FROM ({pieces})),
        named AS (SELECT doc_id, {name} AS tag, min(i) AS i FROM parts GROUP BY ALL),
        listed AS (SELECT doc_id, string_agg(tag, ', ' ORDER BY i) AS tags FROM named WHERE tag IS NOT NULL GROUP BY doc_id)"""


def _tag_lists(pieces: str) -> str:
    return f"""WITH {POSTS}, {ordered_unique(pieces, tag_name_sql('raw'))}
        SELECT p.doc_id, coalesce(l.tags, 'Miscellaneous') AS tags FROM posts p LEFT JOIN listed l USING (doc_id)"""


_SPLIT = "string_split_regex(coalesce(tag, ''), '[;,]')"
_ITEM = "(?:''[^'']*''|\"[^\"]*\")"
LITERAL_PIECES = f"""SELECT doc_id, CASE WHEN NOT (starts_with(coalesce(tag, ''), '[') AND ends_with(coalesce(tag, ''), ']')) THEN {_SPLIT}
    WHEN regexp_full_match(tag, '\\[\\s*(?:{_ITEM}\\s*(?:,\\s*{_ITEM}\\s*)*,?)?\\s*\\]')
        THEN list_transform(regexp_extract_all(tag, '{_ITEM}'), lambda s: s[2:-2]) ELSE []::VARCHAR[] END AS l FROM posts"""


# --- intent and crisis --------------------------------------------------------


@query(
    "intent_tag_summary",
    sql.with_ctes(
        [*TAGGED, f"vocab AS (SELECT unnest({sql.items(lx.TAGS)}) AS Tag)"],
        """SELECT v.Tag, count(t.doc_id) AS Count,
            round(100.0::DOUBLE * count(t.doc_id) / sum(count(t.doc_id)) OVER (), 2) AS Percent
            FROM vocab v LEFT JOIN tagged t ON t.intent = v.Tag GROUP BY v.Tag""",
    ),
)
def intent_tag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.tag_summary(tagging.with_intent(posts(spark, sf), "post").select("intent"), "intent")


@query("intent_value_counts", sql.with_ctes(TAGGED, "SELECT intent, count(*) AS n FROM tagged GROUP BY intent"))
def intent_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.value_counts(tagging.with_intent(posts(spark, sf), "post"), "intent")


# phrases of the intent lists that are plain words
_PLAIN = sorted({(t, p) for t, ps in lx.INTENT_PATTERNS for p in ps if p.replace(" ", "").isalpha()})
_ENTRIES = "lexicon(tag, phrase) AS (VALUES " + ", ".join(f"({sql.q(t)}, {sql.q(p)})" for t, p in _PLAIN) + ")"


@query(
    "lexicon_counts",
    sql.with_ctes(
        [POSTS, _ENTRIES],
        "SELECT l.tag, l.phrase, count(p.doc_id) AS n_posts FROM lexicon l LEFT JOIN posts p ON contains(lower(p.post), l.phrase) GROUP BY l.tag, l.phrase",
    ),
)
def lexicon_counts(spark: SparkSession, sf: str) -> DataFrame:
    lexicon = spark.createDataFrame(_PLAIN, "tag string, phrase string")
    low = posts(spark, sf).select("doc_id", F.lower("post").alias("low"))
    return lexicons.lexicon_counts(lexicons.lexicon_hits(low, "doc_id", "low", lexicon, "phrase"), "doc_id", lexicon, "phrase", "tag")


@query(
    "crisis_levels",
    sql.with_ctes(
        LEVELED,
        f"""SELECT doc_id, level AS crisis_level, level IN ('immediate', 'high') AS is_crisis,
            md5({message_sql('level')}) AS message_md5 FROM leveled""",
    ),
)
def crisis_levels(spark: SparkSession, sf: str) -> DataFrame:
    leveled = tagging.with_crisis(posts(spark, sf), "post", "concern")
    return leveled.select("doc_id", "crisis_level", "is_crisis", F.md5(rules.crisis_message(F.col("crisis_level"))).alias("message_md5"))


@query(
    "concern_from_tags",
    f"""WITH {POSTS}, pieces AS (SELECT doc_id, unnest(string_split(coalesce(tag, ''), ',')) AS raw FROM posts),
    known AS (SELECT DISTINCT doc_id, lower({sql.strip('raw')}) AS t FROM pieces),
    flags AS (SELECT doc_id, list(DISTINCT t) AS l FROM known GROUP BY doc_id),
    grouped AS (SELECT doc_id, l, list_contains(l, 'critical risk') AS crit,
        list_sort(list_filter(['Maladaptive Coping', 'Progress Update', 'Seeking Help'], lambda x: list_contains(l, lower(x)))) AS act,
        list_sort(list_filter(['Cause Of Distress', 'Mental Distress'], lambda x: list_contains(l, lower(x)))) AS bur,
        list_sort(list_filter(['Mood Tracking', 'Positive Coping'], lambda x: list_contains(l, lower(x)))) AS ste FROM flags)
    SELECT doc_id,
        CASE WHEN crit THEN 'High' WHEN len(act) + len(bur) > 0 THEN 'Medium' ELSE 'Low' END AS concern_level,
        CASE WHEN crit THEN 'Critical Risk' WHEN len(act) > 0 THEN array_to_string(act, ', ')
             WHEN len(bur) > 0 THEN array_to_string(bur, ', ')
             WHEN len(ste) > 0 THEN array_to_string(ste, ', ') ELSE 'No higher-severity tags' END AS reason,
        CASE WHEN crit THEN array_to_string(list_concat(
                CASE WHEN list_contains(l, 'maladaptive coping') THEN ['with Maladaptive Coping'] ELSE []::VARCHAR[] END,
                CASE WHEN list_contains(l, 'progress update') THEN ['with Progress Update'] ELSE []::VARCHAR[] END,
                CASE WHEN list_contains(l, 'seeking help') THEN ['and Seeking Help'] ELSE []::VARCHAR[] END), '; ')
             WHEN len(act) > 0 THEN array_to_string(bur, ', ')
             WHEN len(bur) > 0 THEN array_to_string(ste, ', ') ELSE '' END AS notes
    FROM grouped""",
)
def concern_from_tags(spark: SparkSession, sf: str) -> DataFrame:
    return tagging.with_concern_from_tags(posts(spark, sf).select("doc_id", "tag"), F.col("tag")).drop("tag")


# --- tag strings --------------------------------------------------------------


@query("canonical_tags_old", _tag_lists(f"SELECT doc_id, {_SPLIT} AS l FROM posts"))
def canonical_tags_old(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf).select("doc_id", lb.joined(lb.tag_list(F.col("tag"))).alias("tags"))


@query("canonical_tags_literal", _tag_lists(LITERAL_PIECES))
def canonical_tags_literal(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf).select("doc_id", lb.joined(lb.tag_list_literal(F.col("tag"))).alias("tags"))


_BARE = f"""SELECT doc_id, CASE WHEN starts_with(t, '[') AND ends_with(t, ']')
    THEN list_transform(string_split(t[2:-2], ','), lambda s: trim(trim({sql.strip('s')}, ''''), '"'))
    ELSE string_split_regex(t, '[;,]') END AS l FROM (SELECT doc_id, {sql.strip("coalesce(tag, '')")} AS t FROM posts)"""


@query("canonical_tags_bracket", _tag_lists(_BARE))
def canonical_tags_bracket(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf).select("doc_id", lb.joined(lb.tag_list_bracket(F.col("tag"))).alias("tags"))


@query(
    "human_tags",
    f"""WITH {POSTS}, pieces AS (SELECT doc_id, unnest({_SPLIT}) AS raw FROM posts),
    named AS (SELECT DISTINCT doc_id, {sql.lookup({**TAG_NAMES, **lx.HUMAN_ALIASES}, "lower(trim(" + sql.strip('raw') + ", '\"'))")} AS tag FROM pieces),
    listed AS (SELECT doc_id, string_agg(tag, ', ' ORDER BY tag) AS tags FROM named WHERE tag IS NOT NULL GROUP BY doc_id)
    SELECT p.doc_id, CASE WHEN {sql.strip("coalesce(tag, '')")} = '' THEN '' ELSE coalesce(l.tags, 'Miscellaneous') END AS tags
    FROM posts p LEFT JOIN listed l USING (doc_id)""",
)
def human_tags(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf).select("doc_id", lb.joined(lb.human_tags(F.col("tag"))).alias("tags"))


_SUMMARY = f"""WITH {POSTS}, pieces AS (SELECT doc_id, unnest(string_split(coalesce(tag, ''), ',')) AS part FROM posts),
    named AS (SELECT doc_id, {sql.strip('part')} AS raw,
        {sql.lookup({**TAG_NAMES, **lx.SUMMARY_ALIASES}, "lower(" + sql.squeeze('part') + ")")} AS tag
        FROM pieces WHERE {sql.strip('part')} <> '')"""


@query(
    "multi_tag_summary",
    f"""{_SUMMARY}, counted AS (SELECT tag, count(DISTINCT doc_id) AS n FROM named WHERE tag IS NOT NULL GROUP BY tag)
    SELECT v.Tag, coalesce(n, 0) AS Count, round(100.0::DOUBLE * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 2) AS Percent
    FROM (SELECT unnest({sql.items(lx.TAGS)}) AS Tag) v LEFT JOIN counted c ON c.tag = v.Tag""",
)
def multi_tag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.tag_summary(posts(spark, sf), "tag")


@query("unknown_tags", f"{_SUMMARY} SELECT raw AS UnknownTag, count(*) AS n FROM named WHERE tag IS NULL GROUP BY raw")
def unknown_tags(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.unknown_tags(posts(spark, sf), "tag")


# --- concern strings ----------------------------------------------------------


def _strict(c: str) -> str:
    key = f"regexp_replace(lower({sql.strip(c)}), '[.{sql.BLANK}]+$', '')"
    return f"CASE WHEN {key} IN ('low', 'medium', 'high') THEN {key} WHEN {key} IN ('med', 'mid') THEN 'medium' END"


@query(
    "concern_norm_kb",
    f"WITH {POSTS} SELECT doc_id, {inputs.concern_kb_sql('concern')} AS concern, lower({sql.strip('concern')}) AS simple FROM posts",
)
def concern_norm_kb(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("concern")
    return posts(spark, sf).select("doc_id", lb.concern_kb(c).alias("concern"), lb.concern_simple(c).alias("simple"))


@query(
    "concern_norm_strict",
    f"""WITH {POSTS}, n AS (SELECT doc_id, {_strict('concern')} AS level FROM posts)
    SELECT doc_id, level, CASE level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE -1 END AS code FROM n""",
)
def concern_norm_strict(spark: SparkSession, sf: str) -> DataFrame:
    leveled = posts(spark, sf).select("doc_id", lb.concern_strict(F.col("concern")).alias("level"))
    return leveled.withColumn("code", F.coalesce(lb.concern_code(F.col("level")), F.lit(-1)))


@query(
    "clean_concern_posts",
    f"""WITH {POSTS}, n AS (SELECT md5(coalesce(post, '')) AS post_md5, {_strict('concern')} AS Concern_Level FROM posts)
    SELECT * FROM n WHERE Concern_Level IS NOT NULL""",
)
def clean_concern_posts(spark: SparkSession, sf: str) -> DataFrame:
    source = posts(spark, sf).select(F.col("post").alias("Text"), F.col("concern").alias("Concern_Level"))
    return tagging.concern_table(source).select(F.md5("Post").alias("post_md5"), "Concern_Level")


# --- label forms --------------------------------------------------------------


@query(
    "label_scalarise",
    f"""WITH {POSTS} SELECT doc_id, nullif({sql.strip('tag')}, '') AS from_text,
    nullif({sql.strip("list_filter([NULL, '', tag, 'fallback'], lambda x: coalesce(x, '') <> '')[1]")}, '') AS from_list FROM posts""",
)
def label_scalarise(spark: SparkSession, sf: str) -> DataFrame:
    items = F.array(F.lit(None).cast("string"), F.lit(""), F.col("tag"), F.lit("fallback"))
    return posts(spark, sf).select(
        "doc_id", lb.scalar_label(F.col("tag"), False).alias("from_text"), lb.scalar_label(items, True).alias("from_list")
    )


@query(
    "label_encode",
    f"""WITH {POSTS}, n AS (SELECT doc_id, {_strict('concern')} AS level FROM posts)
    SELECT doc_id, level, CASE level WHEN 'high' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 END AS alphabetical,
    level AS decoded FROM n WHERE level IS NOT NULL""",
)
def label_encode(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in sorted(lx.CONCERN_CODES)])
    leveled = posts(spark, sf).select("doc_id", lb.concern_strict(F.col("concern")).alias("level")).dropna()
    return leveled.select(
        "doc_id",
        "level",
        (F.array_position(names, F.col("level")) - 1).cast("int").alias("alphabetical"),
        lb.concern_name(lb.concern_code(F.col("level"))).alias("decoded"),
    )


@query(
    "binarise",
    f"""WITH {POSTS}, {ordered_unique(LITERAL_PIECES, tag_name_sql('raw'))},
    given AS (SELECT p.doc_id, coalesce(l.tags, 'Miscellaneous') AS tags FROM posts p LEFT JOIN listed l USING (doc_id))
    SELECT doc_id, array_to_string(list_transform({sql.items(sorted(lx.TAGS))}, lambda t: list_contains(string_split(tags, ', '), t)::INT), '') AS bits
    FROM given""",
)
def binarise(spark: SparkSession, sf: str) -> DataFrame:
    bits = lb.indicator(lb.tag_list_literal(F.col("tag")), sorted(lx.TAGS))
    return posts(spark, sf).select("doc_id", F.array_join(bits.cast("array<string>"), "").alias("bits"))


# --- text fields --------------------------------------------------------------


@query(
    "truncate_posts",
    f"""WITH {POSTS} SELECT doc_id, md5(CASE WHEN length(post) <= 900 THEN post
        ELSE regexp_replace(substr(post, 1, 900), ' [^ ]*$', '') || '...' END) AS cut_md5,
    md5(CASE WHEN length(post) <= 280 THEN post ELSE substr(post, 1, 280) || '...' END) AS shown_md5 FROM posts""",
)
def truncate_posts(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf).select(
        "doc_id", F.md5(tx.truncated(F.col("post"), 900)).alias("cut_md5"), F.md5(tx.trimmed(F.col("post"), 280)).alias("shown_md5")
    )


@query(
    "text_fields",
    f"""WITH {POSTS} SELECT doc_id, {sql.word_count('post')} AS n_words, length(post) AS n_chars, md5(post) AS fingerprint,
    md5(array_to_string(list_slice({sql.words('post')}, 1, 256), ' ')) AS budget_md5,
    md5(replace(post, chr(10), ' ')) AS line_md5 FROM posts""",
)
def text_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("post")
    return posts(spark, sf).select(
        "doc_id",
        tx.word_count(p).alias("n_words"),
        F.length(p).alias("n_chars"),
        tx.fingerprint(p).alias("fingerprint"),
        F.md5(tx.first_words(p, 256)).alias("budget_md5"),
        F.md5(tx.one_line(p)).alias("line_md5"),
    )


@query(
    "distinct_words",
    f"""WITH {POSTS} SELECT doc_id, len({sql.word_set('post')}) AS n_words, len({sql.word_set('post', True)}) AS n_ascii,
    md5(array_to_string(list_sort({sql.word_set('post')}), ' ')) AS words_md5 FROM posts""",
)
def distinct_words(spark: SparkSession, sf: str) -> DataFrame:
    return posts(spark, sf).select(
        "doc_id",
        F.size(tx.word_set(F.col("post"))).alias("n_words"),
        F.size(tx.word_set(F.col("post"), True)).alias("n_ascii"),
        F.md5(F.array_join(F.array_sort(tx.word_set(F.col("post"))), " ")).alias("words_md5"),
    )


# --- numbering, splits, samples, weights --------------------------------------


@query(
    "kb_surrogate_ids",
    """SELECT doc_id AS source_id, format('kb_{:07d}', row_number() OVER (ORDER BY doc_id) - 1) AS doc_id FROM documents""",
)
def kb_surrogate_ids(spark: SparkSession, sf: str) -> DataFrame:
    source = inputs.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"))
    return knowledge.surrogate_ids(source, "source_id")


@query(
    "row_range",
    """WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS line FROM events)
    SELECT event_id, line FROM n WHERE line >= 101 AND line < 101 + 500""",
)
def row_range(spark: SparkSession, sf: str) -> DataFrame:
    """Resume at a row and stop after a number of rows; the range is the feature."""
    numbered = ordering.with_row_number(inputs.table(spark, sf, "events").select("event_id"), "event_id", "line")
    return numbered.where((F.col("line") >= 101) & (F.col("line") < 101 + 500))


_KEPT = """{name}_f AS (SELECT *, floor({size} / sum({size}) OVER () * (sum({size}) OVER () - ceil({share}::DOUBLE * sum({size}) OVER ()))) AS fl,
        {size} / sum({size}) OVER () * (sum({size}) OVER () - ceil({share}::DOUBLE * sum({size}) OVER ())) AS ex,
        sum({size}) OVER () - ceil({share}::DOUBLE * sum({size}) OVER ()) AS drawn FROM {source}),
    {name} AS (SELECT * EXCLUDE (fl, ex, drawn), fl + (row_number() OVER (ORDER BY ex - fl DESC, s) <= drawn - sum(fl) OVER ())::INT AS {out} FROM {name}_f)"""


def _ranked(stratum: str) -> str:
    return f"""WITH {POSTS}, keyed AS (SELECT doc_id, {stratum} AS s FROM posts),
    ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY md5('42:' || doc_id)) AS r FROM keyed),
    sizes AS (SELECT s, count(*) AS size FROM keyed GROUP BY s)"""


_STRATUM = f"coalesce({_strict('concern')}, 'none')"
_THREE = f"""{_ranked(_STRATUM)}, {_KEPT.format(name='first', size='size', share='0.3', source='sizes', out='n_train')},
    lefts AS (SELECT *, size - n_train AS rest FROM first), {_KEPT.format(name='second', size='rest', share='0.5', source='lefts', out='n_val')},
    assigned AS (SELECT doc_id, s AS stratum, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + n_val THEN 'val' ELSE 'test' END AS split
        FROM ranked JOIN second USING (s))"""


def _stratified(spark: SparkSession, sf: str) -> DataFrame:
    level = F.coalesce(lb.concern_strict(F.col("concern")), F.lit("none"))
    return posts(spark, sf).select("doc_id", level.alias("stratum"))


@query("split_assignment", f"{_THREE} SELECT * FROM assigned")
def split_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return splits.three_way_split(_stratified(spark, sf), "doc_id", stratum="stratum")


@query(
    "split_proportions",
    f"""{_THREE} SELECT split, stratum, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split), 3) AS share
    FROM assigned GROUP BY split, stratum""",
)
def split_proportions(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.proportions(splits.three_way_split(_stratified(spark, sf), "doc_id", stratum="stratum"), "split", "stratum")


def _two(stratum: str) -> str:
    return f"""{_ranked(stratum)}, {_KEPT.format(name='outer_part', size='size', share='0.15', source='sizes', out='n_rest')},
    {_KEPT.format(name='inner_part', size='n_rest', share='0.1765', source='outer_part', out='n_train')}
    SELECT doc_id, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_rest THEN 'val' ELSE 'test' END AS split
    FROM ranked JOIN inner_part USING (s)"""


@query("two_step_split", _two("0"))
def two_step_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.two_step_split(_stratified(spark, sf), "doc_id").select("doc_id", "split")


@query("two_step_split_stratified", _two(_STRATUM))
def two_step_split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return splits.two_step_split(_stratified(spark, sf), "doc_id", stratum="stratum").select("doc_id", "split")


@query("sample_rows", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 15")
def sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.sample_rows(inputs.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 15)


_COUNTS = f"""vocab AS (SELECT unnest({sql.items(inputs.LABELS + ['class 10'])}) AS label),
    counted AS (SELECT 'class ' || label AS label, count(*) AS n FROM embeddings GROUP BY ALL),
    counts AS (SELECT v.label, coalesce(n, 0) AS n FROM vocab v LEFT JOIN counted USING (label))"""


def _class_counts(spark: SparkSession, sf: str) -> DataFrame:
    named = inputs.table(spark, sf, "embeddings").select(F.concat(F.lit("class "), "label").alias("label"))
    return summaries.class_counts(named, "label", [*inputs.LABELS, "class 10"])


@query(
    "class_weights",
    f"WITH {_COUNTS} SELECT label, n, round(1.0::DOUBLE / (n + 1e-5::DOUBLE) / sum(1.0::DOUBLE / (n + 1e-5::DOUBLE)) OVER () * count(*) OVER (), 6) AS weight FROM counts",
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    weighted = summaries.inverse_weights(_class_counts(spark, sf))
    return weighted.select("label", "n", F.round("weight", 6).alias("weight"))


@query(
    "balanced_weights",
    f"WITH {_COUNTS} SELECT label, n, round(CASE WHEN n > 0 THEN sum(n) OVER () / (count(*) OVER () * n)::DOUBLE END, 6) AS weight FROM counts",
)
def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.balanced_weights(_class_counts(spark, sf)).select("label", "n", F.round("weight", 6).alias("weight"))
