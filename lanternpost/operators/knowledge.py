"""Knowledge base: ids, chunks, corpus and metadata, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import concern_kb
from ..functions.text import filled, sentences, strip, word_count, words
from ..functions.vectors import bound
from .ordering import with_row_number

CHUNK_WORDS = 140
MIN_CHARS = 20


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")


def surrogate_ids(df: DataFrame, order_by: str, name: str = "doc_id") -> DataFrame:
    """``kb_0000000``, ``kb_0000001``, ... in ``order_by`` order, numbered without a global window."""
    numbered = with_row_number(df, order_by, "__n", start=0)
    return numbered.withColumn(name, F.format_string("kb_%07d", "__n")).drop("__n")


def packed(sents: Column, budget: int = CHUNK_WORDS, min_chars: int = MIN_CHARS) -> Column:
    """Sentences joined greedily into chunks of at most ``budget`` words.

    The fold carries two numbers and the list of chunk starts; texts are joined
    afterwards from slices, so a long document costs no repeated string copies.
    """

    def build(parts: Column) -> Column:
        counts = F.transform(parts, lambda s: F.size(F.split(s, " ")))
        first = F.struct(
            F.lit(0).alias("at"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("starts")
        )

        def step(state: Column, n: Column) -> Column:
            opens = (state["at"] == 0) | (state["held"] + n > budget)
            return F.struct(
                (state["at"] + 1).alias("at"),
                F.when(opens, n).otherwise(state["held"] + n).alias("held"),
                F.when(opens, F.array_append(state["starts"], state["at"] + 1)).otherwise(state["starts"]).alias("starts"),
            )

        starts = F.aggregate(counts, first, step, lambda state: state["starts"])

        def cut(begin: Column) -> Column:
            def piece(i: Column, s: Column) -> Column:
                after = F.coalesce(F.try_element_at(begin, i + 2), F.size(parts) + 1)
                return F.array_join(F.slice(parts, s, after - s), " ")

            return F.transform(begin, lambda s, i: piece(i, s))

        return bound(starts, cut)

    return F.filter(bound(sents, build), lambda c: F.length(c) >= min_chars)


def word_windows(text: Column, width: int = CHUNK_WORDS, min_chars: int = MIN_CHARS) -> Column:
    """Consecutive windows of ``width`` words."""

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(width))
        return F.transform(starts, lambda s: F.array_join(F.slice(w, s, width), " "))

    return F.filter(bound(words(text), cut), lambda c: F.length(c) >= min_chars)


def chunks(text: Column, budget: int = CHUNK_WORDS, min_chars: int = MIN_CHARS) -> Column:
    """Sentence chunks; a lone chunk of more than twice the budget is cut into word windows."""

    def split_if_huge(cs: Column) -> Column:
        only = F.try_element_at(cs, F.lit(1))
        huge = (F.size(cs) == 1) & (word_count(F.coalesce(only, F.lit(""))) > 2 * budget)
        return F.when(huge, word_windows(only, budget, min_chars)).otherwise(cs)

    return bound(packed(sentences(text), budget, min_chars), split_if_huge)


def chunk_rows(
    source: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "output",
    intent_col: str | None = "Final_Intent_Tag",
    concern_col: str | None = "Concern_Level",
    chunking: bool = True,
    budget: int = CHUNK_WORDS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """One row per chunk: doc_id, source, intent, concern, tags, text (and the base id and ordinal).

    The outer explode keeps Spark from testing the array's size in a filter below it, which
    would chunk every text again; the size is a column of its own below it, so that a chunk's row does not
    carry all chunks of its text.
    """
    require_columns(source, [c for c in (text_col, intent_col, concern_col) if c])
    if id_col not in source.columns:
        raise ValueError(f"missing column(s): {id_col}; number the rows with surrogate_ids first")
    body = strip(filled(text_col))
    pieces = chunks(F.col("__body"), budget, min_chars) if chunking else F.array(F.col("__body"))
    kept = (
        source.withColumn("__body", body)
        .where(F.length("__body") >= min_chars)
        .withColumn("__pieces", pieces)
        .withColumn("n_pieces", F.size("__pieces"))
        .withColumn("base_id", strip(filled(id_col)))
    )
    intent = strip(filled(intent_col)) if intent_col else F.lit("")
    concern = concern_kb(F.col(concern_col)) if concern_col else F.lit("")
    return kept.select(
        "base_id", intent.alias("intent"), concern.alias("concern"), "n_pieces",
        F.posexplode_outer("__pieces").alias("__pos", "text"),
    ).where(F.col("text").isNotNull()).select(
        F.when(F.col("n_pieces") > 1, F.concat("base_id", F.lit("_c"), F.col("__pos") + 1))
        .otherwise(F.col("base_id")).alias("doc_id"),
        "base_id",
        (F.col("__pos") + 1).alias("chunk_no"),
        F.lit("csv").alias("source"),
        "intent",
        "concern",
        F.lit("").alias("tags"),
        "text",
    )


def corpus(chunk_table: DataFrame) -> DataFrame:
    return chunk_table.select("doc_id", "text")


def metadata(chunk_table: DataFrame) -> DataFrame:
    return chunk_table.select("doc_id", "source", "intent", "concern", "tags", "text")


def counters(
    source: DataFrame, text_col: str, budget: int = CHUNK_WORDS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """Rows read, rows kept and chunks written, in one aggregation."""
    sized = source.select(strip(filled(text_col)).alias("body")).select(
        (F.length("body") >= min_chars).alias("kept"),
        F.when(F.length("body") >= min_chars, F.size(chunks(F.col("body"), budget, min_chars))).otherwise(0).alias("n"),
    )
    return sized.agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if("kept").alias("rows_kept"), F.sum("n").alias("chunks")
    )
