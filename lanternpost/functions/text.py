"""Column expressions for text: whitespace, words, sentences, truncation, matching.

Whitespace and word characters are spelled out as character classes so that the
result does not depend on how a regex engine reads ``\\s``, ``\\w`` or ``\\b``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators, as Python's str.split sees it.
SPACE = r"\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WORD = r"\p{L}\p{N}_"
SPACE_CHARS = "".join(
    chr(i)
    for i in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def filled(c: Column | str) -> Column:
    """NULL becomes the empty string; anything else is cast to string."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Remove white space at both ends (``trim`` alone removes only blanks)."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Collapse runs of white space to one blank and strip the ends."""
    return F.array_join(words(c), " ")


def one_line(c: Column) -> Column:
    return F.translate(c, "\n", " ")


def words(c: Column) -> Column:
    """White-space separated words; an empty array for blank text.

    Every kind of white space becomes a blank first, so the split is on one character.
    """
    return F.array_remove(F.split(F.translate(c, SPACE_CHARS, " " * len(SPACE_CHARS)), " "), "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def sentences(c: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` when a blank follows; punctuation stays."""
    return F.filter(F.split(squeeze(c), r"(?<=[.!?]) "), lambda s: s != "")


def truncated(c: Column, limit: int) -> Column:
    """Cut at ``limit`` characters, back to the last blank, and mark with an ellipsis."""
    cut = F.regexp_replace(F.substring(c, 1, limit), r" [^ ]*\z", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut, F.lit("...")))


def trimmed(c: Column, limit: int) -> Column:
    """Cut at ``limit`` characters; an ellipsis only where something was cut."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit), F.lit("...")))


def word_set(c: Column, ascii_only: bool = False) -> Column:
    """Distinct words of four or more characters of the lower-cased text.

    With ``ascii_only`` a word counts only if all of its characters are ASCII letters.
    """
    pattern = f"(?<![{WORD}])[a-z]{{4,}}(?![{WORD}])" if ascii_only else f"[{WORD}]{{4,}}"
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), 0))


def fingerprint(c: Column) -> Column:
    """Stable content hash for anonymised logs."""
    return F.md5(c)


def literal_list(values: list[str]) -> Column:
    """A constant array of strings; one node in the plan however long the list is."""
    return F.split(F.lit("\x1F".join(values)), "\x1F")


def contains_any(c: Column, phrases: list[str]) -> Column:
    """True if any phrase occurs: byte searches that stop at the first hit.

    Cheaper than one alternation, and a loop keeps long lists out of generated code.  A phrase
    that holds a shorter one of the list can never decide and is not searched.
    """
    deciding = [p for p in dict.fromkeys(phrases) if not any(o != p and o in p for o in phrases)]
    return F.exists(literal_list(deciding), lambda p: F.contains(c, p))


def _needed_literal(pattern: str) -> str:
    """The longest plain run every match of ``pattern`` must contain ('' if none)."""
    if re.fullmatch(r"\(.*\)|.*\|.*", re.sub(r"\([^()]*\)", "", pattern)):
        return ""
    bare = re.sub(r"\\[bBdDsSwW][?*+]?|\[[^\]]*\][?*+]?|\([^()]*\)[?*+]?", "\0", pattern)
    bare = re.sub(r"\\(.)", r"\1", re.sub(r"[^\0][?*]", "\0", bare.replace("\\?", "\1")))
    return max(re.split("[\0\1+.]", bare), key=len)


def _as_phrase(pattern: str) -> str | None:
    """The phrase a pattern comes down to: plain text, or plain text with an optional ending."""
    whole = re.fullmatch(r"([^\\()\[\]?*+|.^$]+?)(?:\([^()]*\)\?|[^\\()\[\]?*+|.^$]\?)?", pattern)
    return whole and whole[1]


def _searchable(pattern: str) -> str:
    """The pattern with its outer word edges spelled as look-arounds behind the first word.

    An edge test in front runs at every character; behind the literal it runs only where the
    literal stands.
    """
    word = f"[{WORD}]"
    lead = re.match(r"\\b([a-z' ]+)(?![?*+])", pattern)
    if lead:
        pattern = f"{lead[1]}(?<!{word}{lead[1]}){pattern[lead.end():]}"
    pattern = re.sub(r"\\b\Z", lambda _: f"(?!{word})", pattern)
    return f"(?dU){pattern}" if re.search(r"\\[bswd]", pattern) else pattern


def matches_any(c: Column, patterns: list[str]) -> Column:
    """True if any pattern is found.

    Plain phrases are byte searches.  A pattern with a mandatory literal runs only
    on texts that contain the literal, so the regex engine sees few rows.
    """
    plain, regexes = [], []
    for p in patterns:
        phrase = _as_phrase(p)
        (plain if phrase else regexes).append(phrase or p)
    tests = [contains_any(c, plain)] if plain else []
    ungated = []
    for p in regexes:
        literal = _needed_literal(p)
        if literal:
            tests.append(c.contains(literal) & c.rlike(_searchable(p)))
        else:
            ungated.append(p)
    if ungated:
        tests.append(c.rlike("(?dU)" + "|".join(f"(?:{p})" for p in ungated)))
    return reduce(lambda a, b: a | b, tests)
