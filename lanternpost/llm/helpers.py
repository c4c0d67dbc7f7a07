"""Text blocks for Arrow functions, and names that do not clash."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20
SHARES = 1000


def fresh_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each, a longer text alone."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    which = np.cumsum(sizes, dtype=np.int64) // limit
    starts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), batch.num_rows]
    for a, b in zip(starts, starts[1:]):
        yield batch.slice(a, b - a)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def with_text_columns(
    docs: DataFrame, text: str, into: str, fields: Sequence[T.StructField], fn: Callable[[list[bytes]], list[pa.Array]]
) -> DataFrame:
    """All columns of ``docs`` and a struct ``into`` that ``fn`` computes from blocks of texts."""
    kept = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.StructType(list(fields)))])
    inner = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                made = pa.StructArray.from_arrays(fn(utf8(part.column(text))), names=inner)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*kept, into])

    return docs.mapInArrow(run, schema)


def rows_with_keys(rows: DataFrame, counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ``rows`` whose ``keys`` are in ``counted``, a stored table of distinct keys and ``n``, their numbers of rows.

    A key of more than a thousandth of all these rows is cut into slices of a thousandth, by the hash of
    the whole row.  There are less than a thousand such keys, so they are broadcast."""
    total = max(counted.agg(F.sum("n")).first()[0] or 0, 1)
    slices, slice_ = fresh_name(rows, "slices"), fresh_name(rows, "slice")
    hot = counted.where(F.col("n") * SHARES > total)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("n") * SHARES / total).cast("int").alias(slices)))
    each = F.explode(F.sequence(F.lit(0), F.coalesce(slices, F.lit(1)) - 1)).alias(slice_)
    chosen = counted.select(*keys).join(hot, keys, "left").select(*keys, each)
    dealt = rows.withColumn(slice_, F.xxhash64(*rows.columns)).join(hot, keys, "left")
    dealt = dealt.withColumn(slice_, F.coalesce(F.pmod(slice_, slices), F.lit(0)).cast("int"))
    return dealt.join(chosen, [*keys, slice_]).select(*rows.columns)


class BoundedMemo(dict):
    """Results by key; forgets all of them when ``limit`` are kept, so that memory stays bounded."""

    def __init__(self, fn: Callable, limit: int = 400_000) -> None:
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.fn(key)
        return value


class ByteMemo(dict):
    """Results by key in two generations of ``limit`` bytes: when the young one is full it becomes the
    old one, whose results are taken over as they are asked for, so that what comes often stays.
    Keys above ``longest`` are computed each time."""

    ENTRY = 200

    def __init__(self, fn: Callable, limit: int = 48 << 20, longest: int = 256) -> None:
        super().__init__()
        self.fn, self.limit, self.longest = fn, limit, longest
        self.old: dict = {}
        self.held = 0

    def keep(self, key, value) -> None:
        """Remember a result; a full generation is set aside first."""
        if self.held >= self.limit:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[key] = value
        self.held += len(key) + (len(value) if isinstance(value, bytes) else 0) + self.ENTRY

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= self.longest:
            self.keep(key, value)
        return value
