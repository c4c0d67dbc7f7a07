"""Rule columns: intent, concern, crisis level, snippet safety, reply checks, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .labels import comma_tags
from .text import SPACE, contains_any, filled, matches_any, one_line, strip, word_set


def intent(text: Column, low: Column) -> Column:
    """Tag of the first matching pattern group, then four weaker signals, else Miscellaneous.

    ``text`` is the stripped post and ``low`` its lower-cased form, both as plain
    columns so that they are computed once and not per pattern.  The CASE stops at
    the first hit: a text pays only for the groups above its tag.
    """
    chain = None
    for tag, patterns in lx.INTENT_PATTERNS:
        hit = matches_any(low, patterns)
        chain = F.when(hit, tag) if chain is None else chain.when(hit, tag)
    speaks_of_self = matches_any(low, lx.FIRST_PERSON)
    asks = text.endswith("?") & matches_any(low, lx.QUESTION_WORDS)
    return (
        chain.when(contains_any(text, lx.DISTRESS_EMOJI), "Mental Distress")
        .when(matches_any(low, lx.NEGATIVE_STATE) & speaks_of_self, "Mental Distress")
        .when(asks, "Seeking Help")
        .when(matches_any(low, lx.FEEL_WORDS) & speaks_of_self, "Mood Tracking")
        .otherwise(lx.DEFAULT_TAG)
    )


# --- concern from tags ---------------------------------------------------------

_ACTIVE = ["seeking help", "maladaptive coping", "progress update"]
_BURDEN = ["mental distress", "cause of distress"]
_STEADY = ["positive coping", "mood tracking"]
_KNOWN = ["critical risk", *_ACTIVE, *_BURDEN, *_STEADY]


def _among(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def concern_from_tags(tags: Column, is_array: bool = False) -> Column:
    """struct(level, reason, notes) for a comma-separated tag string or an array of tags."""
    items = tags if is_array else comma_tags(tags)
    have = F.array_intersect(F.transform(items, F.lower), _among(_KNOWN))

    def listed(names: list[str]) -> Column:
        return F.array_join(F.array_sort(F.transform(F.array_intersect(have, _among(names)), F.initcap)), ", ")

    critical = F.array_contains(have, "critical risk")
    active = F.arrays_overlap(have, _among(_ACTIVE))
    burden = F.arrays_overlap(have, _among(_BURDEN))
    critical_notes = F.concat_ws(
        "; ",
        F.when(F.array_contains(have, "maladaptive coping"), "with Maladaptive Coping"),
        F.when(F.array_contains(have, "progress update"), "with Progress Update"),
        F.when(F.array_contains(have, "seeking help"), "and Seeking Help"),
    )
    everything = listed(_KNOWN)
    level = F.when(critical, "High").when(active | burden, "Medium").otherwise("Low")
    reason = (
        F.when(critical, "Critical Risk")
        .when(active, listed(_ACTIVE))
        .when(burden, listed(_BURDEN))
        .when(everything == "", "No higher-severity tags")
        .otherwise(everything)
    )
    notes = (
        F.when(critical, critical_notes)
        .when(active, listed(_BURDEN))
        .when(burden, listed(_STEADY))
        .otherwise("")
    )
    return F.struct(level.alias("level"), reason.alias("reason"), notes.alias("notes"))


# --- crisis -------------------------------------------------------------------


def crisis_level(low: Column, concern: Column | None = None) -> Column:
    """'immediate', 'high', 'medium' or 'none' for a lower-cased post; a High concern raises it."""
    worried = F.lit(False) if concern is None else F.coalesce(F.lower(concern) == "high", F.lit(False))
    immediate = contains_any(low, lx.CRISIS_IMMEDIATE)
    high = contains_any(low, lx.CRISIS_HIGH)
    return (
        F.when(immediate | (worried & high), "immediate")
        .when(worried | high, "high")
        .when(contains_any(low, lx.CRISIS_MEDIUM), "medium")
        .otherwise("none")
    )


def is_crisis(level: Column) -> Column:
    return level.isin("immediate", "high")


def crisis_message(level: Column) -> Column:
    chain = F
    for name, text in lx.CRISIS_MESSAGES.items():
        chain = chain.when(level == name, text)
    return chain.otherwise("")


# --- snippets and replies -----------------------------------------------------


def unsafe_snippet(text: Column) -> Column:
    return matches_any(F.lower(filled(text)), lx.UNSAFE_SNIPPET_PATTERNS)


def unsafe_reply(reply: Column) -> Column:
    return contains_any(F.lower(reply), lx.QUALITY_UNSAFE_PHRASES)


def crisis_post(post: Column) -> Column:
    return contains_any(F.lower(post), lx.QUALITY_CRISIS_WORDS)


def has_crisis_footer(reply: Column) -> Column:
    return contains_any(F.lower(reply), lx.FOOTER_MARKERS)


def banned_phrase(reply: Column) -> Column:
    return contains_any(F.lower(reply), lx.BANNED_PHRASES)


def reject_reason(reply: Column) -> Column:
    """Name of the first failing reply rule, NULL for a valid reply."""
    text = filled(reply)
    low = F.lower(text)
    real_sentences = F.filter(F.split(text, "[.!?]+"), lambda s: F.length(strip(s)) > 10)
    return (
        F.when(F.length(text) < 40, "too short")
        .when(~text.rlike("^[A-Z]"), "no capital")
        .when(contains_any(low, lx.LEAKAGE_MARKERS), "leakage")
        .when(contains_any(low, lx.PERSONA_MARKERS), "persona")
        .when(contains_any(low, lx.TOXIC_MARKERS), "toxic")
        .when(
            text.contains("**")
            | (F.regexp_count(text, F.lit("-")) > 6)
            | (F.regexp_count(text, F.lit("•")) > 4),
            "list format",
        )
        .when((F.size(real_sentences) < 2) & (F.length(text) < 60), "too few sentences")
    )


def copies_snippet(reply: Column, snippet: Column, window: int = 60) -> Column:
    """True if some ``window`` characters of the snippet stand verbatim in the reply."""
    low_reply, low_snippet = F.lower(reply), F.lower(snippet)
    starts = F.sequence(F.lit(1), F.greatest(F.length(low_snippet) - window, F.lit(1)))
    long_enough = F.length(low_snippet) > window
    return long_enough & F.exists(starts, lambda i: F.contains(low_reply, F.substring(low_snippet, i, F.lit(window))))


def word_overlap(reply_words: Column, snippet_words: Column) -> Column:
    return F.size(F.array_intersect(reply_words, snippet_words))


def grounded(reply: Column, snippet_words: Column, least: int = 3, least_ratio: float = 0.08) -> Column:
    """struct(overlap, ratio, ok): shared words of the reply, absolute and relative."""
    mine = word_set(reply)
    shared = word_overlap(mine, snippet_words)
    ratio = shared / F.greatest(F.size(mine), F.lit(1))
    return F.struct(
        shared.alias("overlap"),
        ratio.alias("ratio"),
        ((shared >= least) & (ratio >= least_ratio)).alias("ok"),
    )


def repaired(reply: Column) -> Column:
    """Best ending for a reply that never became valid: the whole sentences of one that was cut off, else an apology.

    A reply that ends well was not cut off; it broke another rule and is not given out.
    """
    ends_well = reply.rlike(rf"[.!?][{SPACE}]*\z")
    whole = F.regexp_extract(reply, r"(?s)(.*(?<!\p{Nd})[.!?])", 1)
    to_last_dot = F.regexp_extract(reply, r"(?s)(.*\.)", 1)
    marker = strip(reply).rlike(rf"(?:First|Second|Third)[{SPACE}]*,?\z")
    without_last = F.regexp_replace(reply, r" [^ ]*\z", "")
    return (
        F.when(F.coalesce(reply, F.lit("")) == "", lx.APOLOGY)
        .when(ends_well, lx.APOLOGY)
        .when(whole != "", whole)
        .when(to_last_dot != "", to_last_dot)
        .when(marker, F.concat(without_last, F.lit(".")))
        .otherwise(lx.APOLOGY)
    )


def no_reply_text(concern: Column) -> Column:
    return F.when(F.lower(concern) == "high", lx.NO_REPLY_HIGH).otherwise(lx.NO_REPLY_OTHER)


def prompt(post: Column, snippet_texts: Column, per_snippet: int = 250, limit: int = 2000) -> Column:
    """Instruction, one line per snippet in the given order, the post, and the task; cut at ``limit``."""
    lines = F.transform(
        snippet_texts, lambda t: F.concat(F.lit("- "), one_line(F.substring(t, 1, per_snippet)), F.lit("\n"))
    )
    whole = F.concat(
        F.lit(lx.PROMPT_INSTRUCTION + lx.PROMPT_CONTEXT),
        F.array_join(lines, ""),
        F.lit("\n" + lx.PROMPT_POST),
        post,
        F.lit("\n\n" + lx.PROMPT_TASK),
    )
    return F.substring(whole, 1, limit)
