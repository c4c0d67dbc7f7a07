"""Embedding near-dedup: sign hashes of random hyperplanes in several tables, exact cosine, components.

Equal vectors are one class with a weight.  In each table a class falls into the bucket of its
sign bits; buckets are cut into slices that meet pairwise, so no task holds a hot bucket whole.
A pair is counted in the first table that puts it into one bucket, with its cosine in double
precision, and a task emits counts per class and one spanning forest, never pairs.  The bits grow
with the number of classes and the tables follow from the recall wanted at the threshold.

Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing and
are their own component; so is a null id, whose row is kept.  Vectors of different lengths are
never compared.  Repeated rows link with each other.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import storage
from .components import components
from .hamming import Forest

THRESHOLD = 0.9
RECALL = 0.99
BUCKET_CLASSES = 256
MIN_BITS = 4
SLICE = 512
SEED = 42


def table_shape(classes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a table and number of tables so that a pair at the threshold shares a bucket with
    probability ``recall``."""
    bits = max(MIN_BITS, math.ceil(math.log2(max(1, classes) / BUCKET_CLASSES)))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def hyperplanes(dimension: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dimension]).standard_normal((dimension, count))


def signatures(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket numbers, one column per table."""
    signs = (x @ hyperplanes(x.shape[1], bits * tables) >= 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length, in double precision, scaled by their largest component."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.abs(x).max(axis=1, keepdims=True)


def _by_length(vectors: pa.Array) -> Iterator[np.ndarray]:
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _buckets(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(size, tab, bucket, node) of every class in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _by_length(batch.column("vec")):
                at = pa.array(rows)
                vectors = batch.column("vec").take(at)
                found = signatures(matrix(vectors), bits, tables)
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n * tables, len(vectors[0]), np.int32)),
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), n)),
                        pa.array(found.ravel()),
                        pa.array(np.repeat(batch.column("node").take(at).to_numpy(), tables)),
                    ],
                    names=["size", "tab", "bucket", "node"],
                )

    return classes.select("node", "vec").mapInArrow(run, "size int, tab int, bucket long, node long")


def _links(grouped: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """(a, b, n): n is the weight that b's bucket mates add to class a (b null), or an edge (n zero)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tab, i, j = (key[k].as_py() for k in (1, 3, 4))
        table = table.combine_chunks()
        x = matrix(table.column("vec").chunk(0))
        nodes, weights, own = (table.column(c).to_numpy() for c in ("node", "weight", "slice"))
        norms = np.sqrt((x * x).sum(axis=1))
        earlier = signatures(x, bits, tables)[:, :tab]
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        forest, count = Forest(len(x)), np.zeros(len(x), np.int64)
        for a in range(0, len(left), 128):
            rows = left[a : a + 128]
            near = (x[rows] @ x[right].T) / np.outer(norms[rows], norms[right]) >= threshold
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                row = int(rows[k])
                mates = right[near[k]]
                mates = mates[mates != row]
                if not len(mates):
                    continue
                forest.join(row, mates)
                new = mates[~(earlier[mates] == earlier[row]).any(axis=1)] if tab else mates
                count[row] += weights[new].sum()
                if i != j:
                    np.add.at(count, new, weights[row])
        edges = np.array(forest.edges, np.int64).reshape(-1, 2)
        some = np.flatnonzero(count)
        return pa.table(
            {
                "a": pa.array(np.concatenate([nodes[some], nodes[edges[:, 0]]])),
                "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(nodes[edges[:, 1]])]),
                "n": pa.array(np.concatenate([count[some], np.zeros(len(edges), np.int64)])),
            }
        )

    return grouped.groupBy("size", "tab", "bucket", "i", "j").applyInArrow(run, "a long, b long, n long")


def linked_vectors(table: DataFrame, id_: str, vec: str, *, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Class ids are 64-bit hashes of the vectors.
    """
    rows = table.select(F.col(id_).alias("id"), F.col(vec).alias("vec"))
    finite = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.coalesce(F.col("id").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("node", F.when(good, F.xxhash64("vec")))
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    classes = storage.stored(classes, "classes")
    bits, tables = table_shape(classes.count(), threshold, recall)
    buckets = storage.stored(_buckets(classes, bits, tables), "buckets")
    keys = ["size", "tab", "bucket"]
    large = buckets.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")).where("slices > 1")
    sliced = buckets.join(large, keys, "left").select(*keys, "node", F.coalesce("slices", F.lit(1)).alias("slices"))
    sliced = sliced.withColumn("slice", F.pmod(F.hash("node"), F.col("slices")))
    met = sliced.select(*keys, "node", "slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("other"))
    met = met.select(*keys, "node", "slice", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"))
    found = storage.stored(_links(met.join(classes.select("node", "vec", "weight"), "node"), bits, tables, threshold), "found")
    roots = components(found.where("b IS NOT NULL"), "a", "b")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = classes.select("node", "weight", "least").join(counts, "node", "left").join(roots, "node", "left")
    named = named.select("node", "least", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    of_node = named.join(least, "root").select("node", "n_links", "component")
    joined = rows.select("id", "node").join(of_node, "node", "left")
    return joined.select(
        F.col("id").alias(id_),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("component", "id") == F.col("id"))).alias("kept"),
    )
