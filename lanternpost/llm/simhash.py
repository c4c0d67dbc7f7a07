"""SimHash near-dedup: fingerprints of word shingles, linked through groups of equal bits and vantage-point trees.

Equal fingerprints are one point.  A pair within the radius agrees in one of radius + 1 disjoint
parts of the bits, so points meet in groups of equal part, three rows a point at radius two however
large the table; groups that are too large are parted again.  In a group a vantage-point tree
partitions the points by Hamming distance, branches are pruned by triangle bounds and points near a
boundary are searched on both sides.  A group gives one edge per merge, never its pairs.

Null texts and texts without words have fingerprint zero and are linked like others.
Fewer words than the shingle's width form one shingle.  Repeated rows are members like others.
A null document id never names a component unless all its documents have none.  An empty table
gives an empty table; columns of the input beside id and text are ignored.  A text of any length is
hashed in blocks of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import storage
from . import hamming
from .components import components
from .helpers import blocks, utf8

SEED = 42
#: Points of a group that is searched as it is; larger ones are parted again.
MOST_POINTS = 8192
#: Ways in which bits are dealt out over the levels, at most; a greater radius may leave larger groups whole.
MOST_PATHS = 4096
#: Groups up to this size are compared whole at once.
SMALL_GROUP = 512

PRINTS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("text_hash", T.LongType())])


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, in order, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64
    )


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 where more than half of the hashes have it."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_: str, text: str, width: int) -> DataFrame:
    """(doc, fp, text_hash) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                fps = [fingerprint(shingle_hashes(t, width)) for t in utf8(part.column(text))]
                yield pa.RecordBatch.from_arrays([part.column(id_).cast(pa.int64()), _signed(fps), part.column("text_hash")], names=PRINTS.names)

    return docs.select(id_, text, F.xxhash64(text).alias("text_hash")).mapInArrow(run, PRINTS)


# --- candidates -----------------------------------------------------------------------------------


def disjoint_masks(mask: int, parts: int) -> list[int]:
    """The set bits of ``mask`` dealt out to ``parts`` masks of about equal size."""
    bits = [k for k in range(64) if mask >> k & 1]
    return [sum(1 << k for k in bits[at::parts]) for at in range(parts)]


def _signed_int(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _finer(rows: DataFrame, masks: list[int], parts: int) -> tuple[DataFrame, list[int]]:
    """(group, path, fp) once per part of the bits that ``path``'s groups have not fixed, and the masks of the new paths.

    Fingerprints that differ in fewer than ``parts`` bits agree in one part at least, so every pair
    of a group meets again in some group.
    """
    of_path = [disjoint_masks(m, parts) for m in masks]
    chosen = F.array(*[F.lit(_signed_int(m)) for ms in of_path for m in ms])
    split = rows.select("group", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: F.col("path") * parts + k)).alias("path"))
    part = F.col("fp").bitwiseAND(F.element_at(chosen, F.col("path") + 1))
    rest = [m & ~chosen_bits for m, ms in zip(masks, of_path) for chosen_bits in ms]
    return split.select(F.xxhash64("group", "path", part).alias("group"), "path", "fp"), rest


def near_edges(points: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that join all points ``fp`` that differ in at most ``radius`` bits, a spanning forest per group.

    A point falls into one group for each of ``radius`` + 1 disjoint parts of its bits, so its rows do
    not grow with the table.  Groups above ``MOST_POINTS`` are parted again by the bits that are still
    free; at a radius of up to three so few bits are free after a few levels that no group of distinct
    points can be larger.  Inside a group vantage-point trees find the pairs.  Points must be distinct.
    """
    parts = radius + 1
    rows, masks = points.select(F.lit(0).cast("long").alias("group"), F.lit(0).alias("path"), "fp"), [(1 << 64) - 1]
    found = None
    while True:
        rows, masks = _finer(rows, masks, parts)
        rows = storage.stored(rows, "groups")
        hot = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_POINTS).select("group")
        hot = storage.stored(hot, "hot-groups")
        some = len(masks) * parts <= MOST_PATHS and not hot.isEmpty()
        edges = _searched(rows.join(hot, "group", "left_anti") if some else rows, radius)
        found = edges if found is None else found.unionByName(edges)
        if not some:
            return found.distinct()
        rows = rows.join(hot, "group", "left_semi")


def _searched(rows: DataFrame, radius: int) -> DataFrame:
    """The edges of all groups, read as a stream that is sorted by group; a task holds one group and one batch."""
    ordered = rows.select("group", "fp").repartition("group").sortWithinPartitions("group", "fp")

    def edges_of(fps: np.ndarray) -> list[tuple[int, int]]:
        if len(fps) <= SMALL_GROUP and not (np.bitwise_count(fps[:, None] ^ fps[None]) <= radius).sum() > len(fps):
            return []
        forest = hamming.Forest(len(fps))
        hamming.search(fps, np.arange(len(fps)), np.zeros(0, np.int64), radius, forest)
        return forest.edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_group, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def closed(group: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole groups in order."""
            starts = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
            sizes = np.diff(np.r_[starts, len(group)])
            a, b = [], []
            for at, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
                for x, y in edges_of(fps[at : at + n]):
                    a.append(at + x)
                    b.append(at + y)
            if a:
                ends = fps[np.array([a, b])].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=0)), pa.array(ends.max(axis=0))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.concatenate([held_group, batch.column("group").to_numpy()])
            fps = np.concatenate([held, batch.column("fp").to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield from closed(group[:cut], fps[:cut])
            held_group, held = group[cut:], fps[cut:]
        if len(held):
            yield from closed(held_group, held)

    return ordered.mapInArrow(run, "a long, b long")


def _with_components(prints: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """``prints``, the component's node ``root`` and component_id, the least document id reachable through equal or linked nodes."""
    roots = components(edges, "a", "b")
    named = prints.groupBy(F.col(node).alias("node")).agg(F.min("doc").alias("least")).join(roots, "node", "left")
    named = named.select("node", "least", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "root").select(F.col("node").alias(node), "root", "component_id")
    return prints.join(of_node, node)


def linked_fingerprints(docs: DataFrame, id_: str, text: str, *, width: int, radius: int) -> DataFrame:
    """(doc, fp, text_hash, root, component_id): documents whose fingerprints differ in at most ``radius`` bits are linked.

    ``root`` names the component and is never null; ``text_hash`` tells rows of one id apart.
    """
    prints = storage.stored(fingerprints(docs, id_, text, width), "fingerprints")
    points = storage.stored(prints.select("fp").distinct(), "points")
    edges = storage.stored(near_edges(points, radius), "edges")
    return _with_components(prints, "fp", edges).select("doc", "fp", "text_hash", "root", "component_id")
