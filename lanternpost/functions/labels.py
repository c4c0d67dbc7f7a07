"""Column expressions for tags and concern levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import SPACE, filled, squeeze, strip


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Value for ``key`` in a literal map, NULL when it is unknown."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


TAG_BY_NAME = {t.lower(): t for t in lx.TAGS}


# --- concern levels -----------------------------------------------------------


def concern_simple(c: Column) -> Column:
    return F.lower(strip(c))


def concern_kb(c: Column) -> Column:
    """Digits and short forms become Low/Medium/High; other text is kept, stripped."""
    raw = strip(filled(c))
    key = F.lower(raw)
    return (
        F.when(key.isin("0", "low"), "Low")
        .when(key.isin("1", "med", "medium"), "Medium")
        .when(key.isin("2", "high"), "High")
        .otherwise(raw)
    )


def concern_strict(c: Column) -> Column:
    """low/medium/high, or NULL for anything that is not a known level."""
    key = F.regexp_replace(F.lower(strip(c)), rf"[.{SPACE}]+\z", "")
    return F.when(key.isin("low", "medium", "high"), key).when(key.isin("med", "mid"), "medium")


def concern_code(c: Column) -> Column:
    pairs = [F.lit(x) for kv in lx.CONCERN_CODES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def concern_name(code: Column) -> Column:
    pairs = [F.lit(x) for name, n in lx.CONCERN_CODES.items() for x in (n, name)]
    return F.try_element_at(F.create_map(*pairs), code)


# --- tags ---------------------------------------------------------------------


def tag_name(c: Column) -> Column:
    """Canonical tag, or NULL when the text is not in the vocabulary."""
    key = F.regexp_replace(F.lower(strip(c)), r"\.\z", "")
    key = F.replace(key, F.lit("causes of distress"), F.lit("cause of distress"))
    key = F.replace(key, F.lit("progress update."), F.lit("progress update"))
    return _lookup(TAG_BY_NAME, key)


def _canonical(raw: Column) -> Column:
    known = F.array_distinct(F.filter(F.transform(raw, tag_name), lambda t: t.isNotNull()))
    return F.when(F.size(known) == 0, F.array(F.lit(lx.DEFAULT_TAG))).otherwise(known)


def tag_list(c: Column) -> Column:
    """Canonical tags of a ``;`` or ``,`` separated string, in order, default Miscellaneous."""
    return _canonical(F.split(filled(c), "[;,]"))


def tag_list_literal(c: Column) -> Column:
    """As :func:`tag_list`, but also reads a list literal such as ``['A', 'B']``.

    A bracketed string that is not a list of quoted strings counts as empty.
    """
    text = filled(c)
    item = r"""(?:'[^']*'|"[^"]*")"""
    well_formed = text.rlike(rf"^\[\s*(?:{item}\s*(?:,\s*{item}\s*)*,?)?\s*\]\z")
    items = F.transform(
        F.regexp_extract_all(text, F.lit(item), 0), lambda q: F.substring(q, F.lit(2), F.length(q) - 2)
    )
    bracketed = text.startswith("[") & text.endswith("]")
    raw = (
        F.when(~bracketed, F.split(text, "[;,]"))
        .when(well_formed, items)
        .otherwise(F.array().cast("array<string>"))
    )
    return _canonical(raw)


def tag_list_bracket(c: Column) -> Column:
    """As :func:`tag_list_literal`, but brackets are cut off and the rest is split at commas,
    with or without quotes around the items."""
    text = strip(filled(c))
    bare = F.transform(
        F.split(F.substring(text, F.lit(2), F.length(text) - 2), ","),
        lambda i: F.regexp_replace(F.regexp_replace(strip(i), r"^'+|'+\z", ""), r'^"+|"+\z', ""),
    )
    bracketed = text.startswith("[") & text.endswith("]")
    return _canonical(F.when(bracketed, bare).otherwise(F.split(text, "[;,]")))


def human_tags(c: Column) -> Column:
    """Hand-entered tags as a sorted set; blank gives an empty list, unknown only gives the default."""
    text = filled(c)
    table = {**TAG_BY_NAME, **lx.HUMAN_ALIASES}
    keys = F.transform(
        F.split(text, "[;,]"), lambda t: F.lower(F.regexp_replace(strip(t), r'^"+|"+\z', ""))
    )
    known = F.array_sort(
        F.array_distinct(F.filter(F.transform(keys, lambda k: _lookup(table, k)), lambda t: t.isNotNull()))
    )
    return (
        F.when(strip(text) == "", F.array().cast("array<string>"))
        .when(F.size(known) == 0, F.array(F.lit(lx.DEFAULT_TAG)))
        .otherwise(known)
    )


def comma_tags(c: Column, delimiters: str = ",") -> Column:
    """Stripped, non-empty pieces of a tag string."""
    return F.filter(F.transform(F.split(filled(c), f"[{delimiters}]"), strip), lambda t: t != "")


def summary_tag(c: Column) -> Column:
    """Canonical tag used by the tag summary, NULL when unknown."""
    return _lookup({**TAG_BY_NAME, **lx.SUMMARY_ALIASES}, F.lower(squeeze(c)))


def scalar_label(c: Column, is_array: bool) -> Column:
    """One label out of a string or a list: first non-empty entry, stripped, blank as NULL."""
    first = F.try_element_at(F.filter(c, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(1)) if is_array else c
    return F.nullif(strip(first.cast("string")), F.lit(""))


def joined(tags: Column) -> Column:
    return F.array_join(tags, ", ")


def indicator(tags: Column, vocabulary: list[str]) -> Column:
    """0/1 per vocabulary entry, in the given order."""
    return F.array(*[F.array_contains(tags, t).cast("int") for t in vocabulary])
