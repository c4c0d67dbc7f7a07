"""Phrase sets searched in one pass over a text, however many phrases there are.

For the short lists of the rules a byte search per phrase is faster; for lexicons of thousands of
phrases a text goes once through an Aho-Corasick automaton.  Matches are plain substrings, as
``contains`` finds them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import literal_list

try:
    import ahocorasick
except ImportError:  # without the library phrases are searched one by one
    ahocorasick = None


#: Texts whose hits are held as Python strings at a time.
TEXTS_STEP = 256


@lru_cache(maxsize=1)
def _automaton(phrases: tuple[str, ...]):
    made = ahocorasick.Automaton()
    for phrase in phrases:
        made.add_word(phrase, phrase)
    made.make_automaton()
    return made


def phrases_found(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that occur in the text, each once, sorted; null for a null text.  Empty phrases are ignored."""
    wanted = tuple(sorted(set(phrases) - {""}))
    if not wanted:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    if ahocorasick is None:
        return F.when(text.isNotNull(), F.filter(literal_list(list(wanted)), lambda p: F.contains(text, p)))

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        search = _automaton(wanted).iter

        def hits(at: int) -> list[str] | None:
            text = texts[at]  # one text at a time leaves Arrow's buffers
            # bytes that are no UTF-8 match no phrase
            return sorted({p for _, p in search(text.as_py().decode("utf-8", "replace"))}) if text.is_valid else None

        kind = pa.list_(pa.string())
        parts = [pa.array([hits(i) for i in range(at, min(at + TEXTS_STEP, len(texts)))], kind) for at in range(0, len(texts), TEXTS_STEP)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return found(text.cast("binary"))
