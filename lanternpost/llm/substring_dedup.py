"""Exact substring dedup: word windows that start twice or more lose their words.

Every window of WINDOW words gets a Rabin-Karp hash.  Windows are shipped in runs: neighbouring
windows whose least ANCHOR-word gram is the same one.  Equal windows have equal grams, so a
window whose gram starts once in the corpus starts once itself, and a run is counted by one
hash of its whole span.  Only where one gram has several different spans are the windows of
one run of each counted on their own.  Repeated windows merge into maximal removal intervals.

A key is 128 bits: the gram's hash and the window's.  Null and empty texts have no words; a text
shorter than a window keeps all.  Repeated rows repeat each other's windows.  Rows that share an
id but not a text are dealt with one by one.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import storage
from .helpers import BoundedMemo, blocks, fresh_name, rows_with_keys, utf8

WINDOW = 35
ANCHOR = 8
BASE = 0x9E3779B97F4A7C15
SALT = np.uint64(0xD6E8FEB86659FD93)

OUT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("text", T.StringType()),
    ]
)


def _word_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


@lru_cache(1)
def _memo() -> BoundedMemo:
    return BoundedMemo(_word_hash)


def word_hashes(split: list[list[bytes]]) -> np.ndarray:
    of = _memo().__getitem__
    return np.array([h for words in split for h in map(of, words)], np.int64).view(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * SALT
    x = (x ^ (x >> np.uint64(29))) * np.uint64(BASE)
    return x ^ (x >> np.uint64(32))


class RollingHash:
    """Rabin-Karp hashes, modulo 2**64, of any span of a word sequence from prefix sums."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words) + 1
        self.power = np.cumprod(np.full(n, BASE, np.uint64))
        inverse = np.cumprod(np.full(n, pow(BASE, -1, 1 << 64), np.uint64))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(words * inverse[:-1], out=self.sums[1:])

    def span(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        end = start + length
        return mixed((self.sums[end] - self.sums[start]) * self.power[end - 1])


def least_grams(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start: position and hash of the least gram in the window, leftmost of equals."""
    n = len(words) - gram + 1
    value = words[:n].copy()
    for k in range(1, gram):
        value = value * np.uint64(BASE) + words[k : k + n]
    value = mixed(value)
    at, best, reach, need = np.arange(n), value, 1, window - gram + 1
    while reach < need:
        step = min(reach, need - reach)
        right = best[step:]
        left = best[: len(right)]
        smaller = right < left
        at = np.where(smaller, at[step:], at[: len(right)])
        best = np.where(smaller, right, left)
        reach += step
    return at, best


def runs_of(words: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(doc, start, count, anchor offset, anchor hash, span hash) of the window runs of a block."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    at, value = least_grams(words, window, gram)
    whole = doc[: len(at)] == doc[window - 1 :]
    first = np.ones(len(at), bool)
    first[1:] = (at[1:] != at[:-1]) | ~whole[:-1]
    starts = np.flatnonzero(first & whole)
    breaks = np.append(np.flatnonzero(first | ~whole), len(at))
    count = breaks[np.searchsorted(breaks, starts, side="right")] - starts
    offset = at[starts] - starts
    spans = RollingHash(words).span(starts, count + (window - 1))
    shape = (count * 64 + offset).astype(np.uint64)
    return doc[starts], starts, count, offset, value[starts], mixed(spans ^ (shape * SALT))


def _first_words(n_words: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n_words)[:-1]]).astype(np.int64)


def window_runs(texts: DataFrame) -> DataFrame:
    """(anchor, sig, doc, row, at) of all window runs of ``texts`` (doc, row, text).

    ``at`` packs the first window's word number, the number of windows and the anchor's offset."""
    id_type = texts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                split = [t.split() for t in utf8(part.column("text"))]
                n_words = np.array([len(w) for w in split], np.int64)
                doc = np.repeat(np.arange(len(split)), n_words)
                of, start, count, offset, anchor, sig = runs_of(word_hashes(split), doc)
                at = ((start - _first_words(n_words)[of]) << 16) | (count << 8) | offset
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(sig.view(np.int64)), part.column("doc").take(rows), part.column("row").take(rows), pa.array(at)],
                    names=["anchor", "sig", "doc", "row", "at"],
                )

    return texts.mapInArrow(run, f"anchor long, sig long, doc {id_type}, row long, at long")


def windows_of(chosen: DataFrame) -> DataFrame:
    """(anchor, off, h, doc, row, pos, weight) of each window of the runs listed in ``chosen``
    (doc, row, text, runs)."""
    id_type = chosen.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                split = [t.split() for t in utf8(part.column("text"))]
                first = _first_words(np.array([len(w) for w in split], np.int64))
                rolling = RollingHash(word_hashes(split))
                listed = part.column("runs")
                of = np.repeat(np.arange(len(split)), listed.value_lengths().to_numpy(zero_copy_only=False))
                flat = listed.flatten()
                at, anchor, weight = (flat.field(k).to_numpy() for k in (0, 1, 2))
                start, count, offset = at >> 16, (at >> 8) & 255, at & 255
                each = np.repeat(np.arange(len(at)), count)
                step = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                pos = start[each] + step
                h = rolling.span(first[of[each]] + pos, WINDOW)
                rows = pa.array(of[each])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[each]),
                        pa.array((offset[each] - step).astype(np.int32)),
                        pa.array(h.view(np.int64)),
                        part.column("doc").take(rows),
                        part.column("row").take(rows),
                        pa.array(pos),
                        pa.array(weight[each]),
                    ],
                    names=["anchor", "off", "h", "doc", "row", "pos", "weight"],
                )

    return chosen.mapInArrow(run, f"anchor long, off int, h long, doc {id_type}, row long, pos long, weight int")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(doc, row, ranges): lists of (first window, number of windows) that start twice or more."""
    runs = storage.stored(window_runs(texts), "runs")
    twice = storage.stored(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-grams")
    found = storage.stored(rows_with_keys(runs, twice, ["anchor"]), "repeated-runs")
    storage.discard(runs)
    spans = found.groupBy("anchor", "sig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "row", "at")).alias("one"))
    spans = storage.stored(spans, "spans")
    whole = rows_with_keys(found, spans.where("n > 1"), ["anchor", "sig"])
    whole = whole.select("doc", "row", F.shiftright("at", 16).alias("first"), F.shiftright("at", 8).bitwiseAND(255).alias("count"))
    several = spans.groupBy("anchor").agg(F.count(F.lit(1)).alias("spans"), F.min("n").alias("least")).where("spans > 1 AND least = 1")
    apart = spans.join(several.select("anchor"), "anchor")
    listed = apart.groupBy("one.doc", "one.row").agg(
        F.collect_list(F.struct(F.col("one.at").alias("at"), "anchor", F.least("n", F.lit(2)).cast("int").alias("weight"))).alias("runs")
    )
    windows = windows_of(_joined(texts, listed, "inner", "runs"))
    again = windows.groupBy("anchor", "off", "h").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor", "off", "h")
    single = windows.where("weight = 1").join(again, ["anchor", "off", "h"])
    single = single.select("doc", "row", F.col("pos").alias("first"), F.lit(1).cast("long").alias("count"))
    return whole.unionByName(single).groupBy("doc", "row").agg(F.collect_set(F.struct("first", "count")).alias("ranges"))


def _joined(texts: DataFrame, side: DataFrame, how: str, column: str) -> DataFrame:
    right = side.select(F.col("doc").alias("side_doc"), F.col("row").alias("side_row"), column)
    on = F.col("doc").eqNullSafe(F.col("side_doc")) & (F.col("row") == F.col("side_row"))
    return texts.join(right, on, how).select(*texts.columns, column)


def cut(words: list[bytes], ranges: list[dict] | None) -> tuple[int, list[tuple[int, int]], bytes]:
    """Words removed, maximal removal intervals [start, end), and the kept words joined by one space."""
    if not ranges:
        return 0, [], b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    first = np.array([r["first"] for r in ranges])
    np.add.at(edge, first, 1)
    np.add.at(edge, first + np.array([r["count"] for r in ranges]) + (WINDOW - 1), -1)
    gone = np.cumsum(edge[:-1]) > 0
    sides = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
    return int(gone.sum()), list(zip(sides[::2].tolist(), sides[1::2].tolist())), b" ".join(kept)


def dedup_substrings(docs: DataFrame, id_: str, text: str, into: str) -> DataFrame:
    """All columns of ``docs`` and a struct ``into``: n_words, n_removed, removed spans, kept text.

    All windows are judged on the input, so every copy of a repeated passage goes.
    """
    own, doc, row, ranges = (fresh_name(docs, c) for c in ("own_doc", "text_doc", "text_row", "ranges"))
    rest = [c for c in docs.columns if c not in (id_, text)]
    # The same projection and keys as the inner joins: without other columns they share one exchange.
    keyed = docs.select(F.col(id_).alias(own), F.col(text), F.xxhash64(F.col(text)).alias(row), *rest)
    texts = docs.select(F.col(id_).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"))
    found = repeated_windows(texts).select(F.col("doc").alias(doc), F.col("row").alias(row + "_"), F.col("ranges").alias(ranges))
    on = F.col(own).eqNullSafe(F.col(doc)) & (F.col(row) == F.col(row + "_"))
    joined = keyed.join(found, on, "left").select(*[F.col(own).alias(id_) if c == id_ else c for c in docs.columns], ranges)
    kept = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(into, OUT)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                split = [t.split() for t in utf8(part.column(text))]
                done = [cut(w, r) for w, r in zip(split, part.column(ranges).to_pylist())]
                made = pa.StructArray.from_arrays(
                    [
                        pa.array([len(w) for w in split], pa.int64()),
                        pa.array([d[0] for d in done], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in d[1]] for d in done], span),
                        pa.array([d[2] for d in done], pa.binary()).cast(pa.string()),
                    ],
                    names=OUT.names,
                )
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], made], names=[*kept, into])

    return joined.mapInArrow(run, schema)
