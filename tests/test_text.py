"""Text functions against short Python versions, on generated strings."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanternpost.functions import text as tx
from lanternpost.operators import knowledge

SOME = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
PROSE = st.lists(
    st.text(alphabet="abé çZ09_.!?,;-\n\t  ", max_size=60), min_size=1, max_size=40
)


@SOME
@given(PROSE)
def test_words_sentences_sets(column, texts):
    assert column(texts, tx.words) == [t.split() for t in texts]
    assert column(texts, tx.strip) == [t.strip() for t in texts]
    split = [[s for s in re.split(r"(?<=[.!?])\s+", " ".join(t.split())) if s] for t in texts]
    assert column(texts, tx.sentences) == split
    found = column(texts, tx.word_set)
    assert [set(f) for f in found] == [set(re.findall(r"\b\w{4,}\b", t.lower())) for t in texts]
    ascii_found = column(texts, lambda c: tx.word_set(c, True))
    assert [set(f) for f in ascii_found] == [set(re.findall(r"\b[a-zA-Z]{4,}\b", t.lower())) for t in texts]


@SOME
@given(PROSE)
def test_truncation(column, texts):
    def cut(t):
        return t if len(t) <= 12 else t[:12].rpartition(" ")[0] + "..." if " " in t[:12] else t[:12] + "..."

    assert column(texts, lambda c: tx.truncated(c, 12)) == [cut(t) for t in texts]


def packed(text, budget, least):
    """Fill one chunk after the other; a chunk closes when the next sentence would not fit."""
    groups = []
    for s in re.split(r"(?<=[.!?]) ", " ".join(text.split())):
        size = len(s.split())
        if groups and groups[-1][0] + size <= budget:
            groups[-1] = (groups[-1][0] + size, groups[-1][1] + [s])
        elif size:
            groups.append((size, [s]))
    joined = [" ".join(g) for _, g in groups]
    joined = [j for j in joined if len(j) >= least]
    if len(joined) == 1 and len(joined[0].split()) > 2 * budget:
        w = joined[0].split()
        joined = [" ".join(w[i : i + budget]) for i in range(0, len(w), budget)]
        joined = [j for j in joined if len(j) >= least]
    return joined


@SOME
@given(st.lists(st.lists(st.sampled_from(["go", "now.", "wait!", "why?", "blue", "a", "sea"]), max_size=40), min_size=1, max_size=20))
def test_chunks_keep_words_in_order(column, docs):
    texts = [" ".join(d) for d in docs]
    got = column(texts, lambda c: knowledge.chunks(c, 5, 1))
    assert got == [packed(t, 5, 1) for t in texts]
    assert [" ".join(g).split() for g in got] == [t.split() for t in texts]


def test_forced_split_and_short_chunks(column):
    long = " ".join(["word"] * 700)
    got = column([long, "tiny", "", None], knowledge.chunks)
    assert [len(c.split()) for c in got[0]] == [140] * 5
    assert got[1:] == [[], [], []] or got[1:3] == [[], []]


def test_chunk_ids(spark):
    long = "This is a sentence of seven words. " * 30
    rows = spark.createDataFrame([("a", long), ("b", "One short answer to keep."), ("c", "no")], "doc_id string, output string")
    got = knowledge.chunk_rows(rows, intent_col=None, concern_col=None).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == ["a_c1", "a_c2", "b"]


def test_required_columns(spark):
    import pytest

    with pytest.raises(ValueError, match="output, Final_Intent_Tag"):
        knowledge.chunk_rows(spark.range(1).select(F.col("id").alias("Concern_Level")))
