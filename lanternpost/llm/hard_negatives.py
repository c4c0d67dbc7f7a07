"""Hard negatives by lists that an anchor cluster shares, walked until nothing left can qualify.

Anchors are clustered by direction; every row belongs to the cell of its nearest centroid, cells are
cut into blocks.  Where anchors of a cluster meet a block, the block is sorted once by an upper bound
of its scores with any of them: the row's length times the cosine of its angle to the centroid less
the widest angle of the cluster.  Every member walks that list and leaves once the bound, times its
own length, is below all it still needs.  An anchor meets its own cell first, which gives it floors,
and then only cells whose bound reaches them.  Positives are mined first; their scores give the
windows for the negatives.  All rows that qualify are found: the bounds leave out nothing else.

Scores are integer inner products of the rounded-down components times a scale.  Rows with a null id,
label or vector, an empty vector, or a null, non-finite or huge component (beyond 2**24 once scaled)
take no part; vectors of different lengths are never compared.  Of rows that share an id the one with
the least label and vector counts.  Ties go to the smaller id.  Zero vectors score zero.  A table
without anchors, or an empty one, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import per_group
from ..sources import storage

SCALE = 256
LARGEST = 1 << 24
SAMPLE = 4096
MOST_CLUSTERS = 64
ROUNDS = 8
BLOCK_ROWS = 16384
SLICE_ROWS = 4096
STEP = 256
EXACT = float(1 << 53)
ANGLE_SLACK = 1e-6
LEAST = np.iinfo(np.int64).min
NEVER = np.iinfo(np.int64).max


def scaled_rows(table: DataFrame, id_: str, vec: str, label: Column, *, scale: int = SCALE) -> DataFrame:
    """(id, label, ints): the rows that take part, one per id."""
    scaled = F.transform(F.col(vec), lambda x: F.floor(x.cast("double") * scale))
    finite = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * scale > LARGEST))
    fit = F.col(id_).isNotNull() & label.isNotNull() & (F.size(vec) > 0) & finite
    rows = table.where(F.coalesce(fit, F.lit(False))).select(F.col(id_).cast("long").alias("id"), label.cast("int").alias("label"), scaled.cast("array<int>").alias("ints"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "ints")).alias("r")).select("id", "r.label", "r.ints")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float64)
    length = np.sqrt((x * x).sum(axis=1))
    return np.divide(x, length[:, None], out=np.zeros_like(x), where=length[:, None] > 0), length


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def fit_centroids(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Directions of spherical k-means; empty clusters keep their centroid."""
    units = np.unique(_unit(vectors)[0], axis=0)
    centres = units[np.linspace(0, len(units) - 1, min(clusters, len(units))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, units)
        moved, length = _unit(sums)
        centres = np.where(length[:, None] > 0, moved, centres)
    return centres


def _centroids(anchors: DataFrame, count: int) -> dict[int, np.ndarray]:
    """Centroids by vector length, from at most ``SAMPLE`` anchors chosen by hash."""
    rows = anchors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("ints").collect()
    clusters = int(max(1, min(MOST_CLUSTERS, count**0.5 / 2)))
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r["ints"]), []).append(r["ints"])
    return {n: fit_centroids(np.array(v, np.int64), clusters) for n, v in by_size.items()}


def _centres_of(centroids: dict[int, np.ndarray], size: int) -> np.ndarray:
    return centroids.get(size, np.zeros((1, size)))


def _sizes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        yield int(n), np.flatnonzero(sizes == n)


def _with_cells(rows: DataFrame, centroids: dict[int, np.ndarray]) -> DataFrame:
    """(id, label, ints, size, cell, angle, length): nearest centroid and the angle to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at in _sizes(batch.column("ints")):
                part = batch.take(pa.array(at))
                units, length = _unit(matrix(part.column("ints")))
                angles = _angles(units, _centres_of(centroids, size))
                cell = angles.argmin(axis=1)
                made = [pa.array(np.full(len(at), size, np.int32)), pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(at)), cell]), pa.array(length)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "size", "cell", "angle", "length"])

    return rows.select("id", "label", "ints").mapInArrow(run, "id long, label int, ints array<int>, size int, cell int, angle double, length double")


# --- the walk -------------------------------------------------------------------------------------


class Tops:
    """The best ``keep`` of each lane: higher scores first, ties by smaller id; ``floor`` is what a new one must reach."""

    def __init__(self, floors: np.ndarray, keep: int) -> None:
        self.floor, self.keep = floors.copy(), keep
        self.lane = self.id = self.score = np.zeros(0, np.int64)

    def add(self, lane: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(lane):
            return
        lane, ids, score = np.concatenate([self.lane, lane]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, lane))
        lane, ids, score = lane[order], ids[order], score[order]
        place = np.arange(len(lane)) - np.searchsorted(lane, lane, side="left")
        kept = place < self.keep
        self.lane, self.id, self.score = lane[kept], ids[kept], score[kept]
        full = place == self.keep - 1
        np.maximum.at(self.floor, lane[full], score[full])


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where no sum can leave its exact range."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def walk(anchors: dict, rows: dict, centre: np.ndarray, tops: Tops, lanes: int, same: bool) -> None:
    """One cluster's members walk one list of rows, sorted once by its shared bound.

    Lane ``m * lanes + j`` is the j-th window of member m: scores from the lane's floor to ``top``.
    """
    units, length = _unit(anchors["x"])
    widest = _angles(units, centre[None])[:, 0].max(initial=0.0)
    row_units, row_length = _unit(rows["x"])
    gap = np.maximum(_angles(row_units, centre[None])[:, 0] - widest - ANGLE_SLACK, 0.0)
    bound = row_length * np.cos(gap) + ANGLE_SLACK * row_length
    order = np.argsort(-bound, kind="stable")
    top = anchors["top"].reshape(-1, lanes)
    for at in range(0, len(order), STEP):
        floors = tops.floor.reshape(-1, lanes)
        need = np.where(floors > top, NEVER, floors).min(axis=1).astype(np.float64)
        going = np.flatnonzero(length * bound[order[at]] + 1.0 >= need)
        if not len(going):
            return
        part = order[at : at + STEP]
        scores = _scores(anchors["x"][going], rows["x"][part])
        wanted = (anchors["label"][going][:, None] == rows["label"][part][None]) == same
        wanted &= anchors["id"][going][:, None] != rows["id"][part][None]
        for j in range(lanes):
            hit = wanted & (scores >= floors[going, j][:, None]) & (scores <= top[going, j][:, None])
            m, k = np.nonzero(hit)
            tops.add(going[m] * lanes + j, rows["id"][part[k]], scores[m, k])


def _meet(visits: DataFrame, blocks: DataFrame, centroids: dict[int, np.ndarray], keep: int, lanes: int, same: bool) -> DataFrame:
    """(anchor, lane, id, score): hits of each anchor slice in each block that it visits.

    ``visits``: (size, cell, id, label, ints, home, floors, tops), the cells an anchor goes to.
    Blocks and slices are cut by hash, so neither a hot cell nor many visitors make one task.
    """
    key = ["size", "cell"]
    shape = blocks.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))
    slices = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / SLICE_ROWS).cast("int").alias("slices"))
    shape = shape.join(slices, key)
    left = visits.join(shape, key).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "slices")
    right = blocks.select(*key, "id", "label", "ints").join(shape, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    right = right.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("parts", "slices")

    def column(table: pa.Table, name: str) -> pa.Array:
        return table.column(name).combine_chunks()

    def score(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        empty = pa.table({"anchor": pa.array([], pa.int64()), "lane": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not anchors.num_rows or not rows.num_rows:
            return empty
        listed = {"x": matrix(column(rows, "ints")), "id": column(rows, "id").to_numpy(), "label": column(rows, "label").to_numpy()}
        centres = _centres_of(centroids, listed["x"].shape[1])
        home, out = column(anchors, "home").to_numpy(), []
        for cluster in np.unique(home):
            members = anchors.take(pa.array(np.flatnonzero(home == cluster)))
            ids = column(members, "id").to_numpy()
            group = {
                "x": matrix(column(members, "ints")), "id": ids, "label": column(members, "label").to_numpy(),
                "top": column(members, "tops").flatten().to_numpy(),
            }
            tops = Tops(column(members, "floors").flatten().to_numpy(), keep)
            walk(group, listed, centres[cluster], tops, lanes, same)
            out.append(pa.table({"anchor": ids[tops.lane // lanes], "lane": (tops.lane % lanes).astype(np.int32), "id": tops.id, "score": tops.score}))
        return pa.concat_tables([empty, *out])

    by = [*key, "part", "slice"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(score, "anchor long, lane int, id long, score long")


def _away(anchors: DataFrame, reach: list[tuple], centroids: dict[int, np.ndarray]) -> DataFrame:
    """The other cells that can hold a row an anchor still needs.

    ``reach``: (size, cell, widest angle, greatest length) of every cell of a sampled vector length.
    """
    cells: dict[int, list[tuple]] = {}
    for size, cell, widest, longest in reach:
        cells.setdefault(size, []).append((cell, widest, longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at in _sizes(batch.column("ints")):
                if size not in cells:
                    continue
                part = batch.take(pa.array(at))
                cell, widest, longest = (np.array(v) for v in zip(*cells[size]))
                units, length = _unit(matrix(part.column("ints")))
                gap = np.maximum(_angles(units, centroids[size][cell]) - widest - ANGLE_SLACK, 0.0)
                bound = length[:, None] * longest * (np.cos(gap) + ANGLE_SLACK) + 1.0
                lanes = len(part.column("floors")[0])
                floors, top = (part.column(c).flatten().to_numpy().reshape(-1, lanes) for c in ("floors", "tops"))
                need = np.where(floors > top, NEVER, floors).min(axis=1).astype(np.float64)
                go = (bound >= need[:, None]) & (cell[None] != part.column("home").to_numpy()[:, None])
                who, where = np.nonzero(go)
                if len(who):
                    took = part.take(pa.array(who)).set_column(part.schema.get_field_index("cell"), "cell", pa.array(cell[where].astype(np.int32)))
                    yield from (took.slice(k, 4096) for k in range(0, took.num_rows, 4096))

    return anchors.mapInArrow(run, anchors.schema)


def _mined(anchors: DataFrame, blocks: DataFrame, reach: list[tuple], centroids: dict[int, np.ndarray], keep: int, lanes: int, same: bool) -> DataFrame:
    """Ranked hits (anchor, lane, id, score, rank) over all cells: the own one first, then the others."""
    near = storage.stored(_meet(anchors, blocks, centroids, keep, lanes, same), "near-hits")
    by_lane = Window.partitionBy("anchor", "lane").orderBy(F.desc("score"), "id")
    reached = near.withColumn("rank", F.row_number().over(by_lane)).where(F.col("rank") == keep)
    reached = reached.groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("lane", "score"))).alias("reached"))
    raised = F.transform("floors", lambda f, j: F.greatest(f, F.coalesce(F.try_element_at("reached", j), f)))
    onward = anchors.join(reached, "id", "left").withColumn("floors", raised).drop("reached").select(*anchors.columns)
    far = _meet(storage.stored(_away(onward, reach, centroids), "visits"), blocks, centroids, keep, lanes, same)
    hits = near.unionByName(far)
    return hits.withColumn("rank", F.row_number().over(by_lane)).where(F.col("rank") <= keep)


def mine(rows: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: (id, label, ints) of :func:`scaled_rows`; ``anchor`` tells which rows are anchors.  An
    anchor's positives are its best rows of the same label; a negative of another label has a score
    of ``least`` to ``most`` percent of the positive's.
    """
    rows = storage.stored(rows, "rows")
    chosen = rows.where(anchor)
    centroids = _centroids(chosen, chosen.count())
    blocks = storage.stored(_with_cells(rows, centroids), "cells")
    known = blocks.where(F.col("size").isin(list(centroids)))
    reach = known.groupBy("size", "cell").agg(F.max("angle").alias("widest"), F.max("length").alias("longest")).collect()
    base = blocks.where(anchor).select("size", "cell", "id", "label", "ints", F.col("cell").alias("home"))

    every = base.withColumn("floors", F.array(F.lit(LEAST))).withColumn("tops", F.array(F.lit(NEVER - 1)))
    found = storage.stored(_mined(storage.stored(every, "anchors"), blocks, reach, centroids, positives, 1, True), "positives")
    # Best positive first; a missing one has an empty window.
    listed = found.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("scores"))
    score = lambda j: F.try_element_at("scores", F.lit(j))
    lowest = lambda s: F.ceil(s.cast("decimal(20,0)") * least / most).cast("long")
    tops = F.array(*[F.coalesce(score(j), F.lit(LEAST + 1)) for j in range(1, positives + 1)])
    floors = F.array(*[F.coalesce(lowest(score(j)), F.lit(NEVER - 1)) for j in range(1, positives + 1)])
    wanting = base.join(listed, base["id"] == listed["anchor"]).select("size", "cell", "id", "label", "ints", "home", floors.alias("floors"), tops.alias("tops"))
    hits = _mined(storage.stored(wanting, "windows"), blocks, reach, centroids, negatives, positives, False)
    of = found.select("anchor", (F.col("rank") - 1).alias("lane"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hits.join(of, ["anchor", "lane"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
