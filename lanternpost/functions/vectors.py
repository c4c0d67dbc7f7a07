"""Column expressions on ``array<double>`` vectors, and the default text encoder."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE_CHARS, words

DEFAULT_DIM = 64
#: Rows and bytes of text that are encoded at once, a longer text alone.
ENCODED_ROWS = 8192
ENCODED_BYTES = 4 << 20
#: Words whose digests are made at once, and the bytes that one block of MD5 holds beside its padding.
DIGEST_WORDS = 4096
ONE_BLOCK = 55
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(v: Column) -> Column:
    """The vector scaled to length one; a zero vector stays zero."""

    def scaled(w: Column) -> Column:
        return bound(norm(w), lambda n: F.when(n > 0, F.transform(w, lambda x: x / n)).otherwise(w))

    return bound(v.cast("array<double>"), scaled)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 if either is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def word_bucket(word: Column, dim: int = DEFAULT_DIM) -> Column:
    return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def run_lengths(ordered: Column) -> Column:
    """Map of each value of a sorted array to how often it occurs, from the places where a run starts."""
    size = F.size(ordered)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: F.coalesce(F.get(ordered, i) != F.get(ordered, i - 1), F.lit(True)))

    def counted(first: Column) -> Column:
        lengths = F.transform(first, lambda at, i: F.coalesce(F.get(first, i + 1), size) - at)
        return F.map_from_arrays(F.transform(first, lambda at: F.get(ordered, at)), lengths)

    return bound(starts, counted)


def hashed_counts(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Hashed bag of lower-case words: ``dim`` counts, read off the runs of the sorted buckets."""

    def tally(runs: Column) -> Column:
        slots = F.sequence(F.lit(0), F.lit(dim - 1))
        return F.transform(slots, lambda k: F.coalesce(F.try_element_at(runs, k), F.lit(0)).cast("double"))

    ordered = F.sort_array(F.transform(words(F.lower(text)), lambda w: word_bucket(w, dim)))
    return bound(bound(ordered, run_lengths), tally)


def encoded(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Default encoder: the unit-length hashed bag of words (native, needs no model files)."""
    return unit(hashed_counts(text, dim))


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column and the limits of its values in them."""
    wide = pa.types.is_large_binary(column.type)
    limits = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[limits[0] : limits[-1]]
    return held, limits.astype(np.int64) - limits[0]


def digest_heads(words: pa.Array) -> np.ndarray:
    """The first 32 bits of the MD5 of each value: short values together, a block of 64 bytes each."""
    data, limits = _spans(words)
    heads, size = np.zeros(len(words), np.uint32), np.diff(limits)
    for at in np.flatnonzero(size > ONE_BLOCK).tolist():
        heads[at] = int(hashlib.md5(data[limits[at] : limits[at + 1]].tobytes()).hexdigest()[:8], 16)
    short = np.flatnonzero(size <= ONE_BLOCK)
    for i in range(0, len(short), DIGEST_WORDS):
        of = short[i : i + DIGEST_WORDS]
        n = size[of]
        blocks, place = np.zeros((len(of), 64), np.uint8), np.arange(n.max())
        if len(place):
            byte = np.minimum(limits[of][:, None] + place, len(data) - 1)
            blocks[:, : len(place)] = np.where(place < n[:, None], data[byte], 0)
        blocks[np.arange(len(of)), n] = 0x80
        parts = blocks.view("<u4")
        parts[:, 14] = n * 8
        heads[of] = _one_block(np.ascontiguousarray(parts.T, np.uint32))
    return heads


def _one_block(parts: np.ndarray) -> np.ndarray:
    """First 32 bits of the MD5 of messages of one block, by their sixteen numbers."""
    a, b, c, d = (np.full(parts.shape[1], x) for x in _START)
    for i in range(64):
        if i < 16:
            mixed, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, at = c ^ (b | ~d), 7 * i % 16
        mixed += a + parts[at] + _SINES[i]
        a, b, c, d = d, b + (mixed << np.uint32(_TURNS[i]) | mixed >> np.uint32(32 - _TURNS[i])), b, c
    return (a + _START[0]).byteswap()


def _blanked(texts: pa.Array) -> pa.Array:
    """The texts with a blank for each byte of each kind of white space."""
    data, limits = _spans(texts)
    n = len(data)
    data = np.append(_BLANK_FOR[data], np.zeros(2, np.uint8))
    if n and data.max() >= 0x80:
        for first, spaces in _WIDE_SPACES.items():
            leads = np.flatnonzero(data[:n] == first)
            for space in spaces if len(leads) else ():
                at = leads[np.logical_and.reduce([data[leads + i] == x for i, x in enumerate(space)])]
                for i in range(len(space)):
                    data[at + i] = 0x20
    return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(limits), pa.py_buffer(data[:n])])


_BLANK_FOR = np.arange(256, dtype=np.uint8)
_BLANK_FOR[[ord(c) for c in SPACE_CHARS if ord(c) < 0x80]] = 0x20
_WIDE_SPACES: dict[int, list[bytes]] = {}
for _space in (c.encode() for c in SPACE_CHARS if ord(c) >= 0x80):
    _WIDE_SPACES.setdefault(_space[0], []).append(_space)


def encoded_in_batches(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """The vectors of :func:`encoded`, made a batch of texts at a time: each different word of a batch is hashed once.

    Not for use inside array functions; a null text gives the zero vector.
    """

    def part(texts: pa.Array) -> pa.Array:
        lists = pc.split_pattern(_blanked(texts), b" ")
        found = lists.flatten().dictionary_encode()
        words = found.dictionary
        slots = digest_heads(words).astype(np.int64) % dim
        slots[pc.binary_length(words).to_numpy(zero_copy_only=False) == 0] = -1
        slot = slots[found.indices.to_numpy()]
        row = pc.list_parent_indices(lists).to_numpy()
        counts = np.bincount((row * dim + slot)[slot >= 0], minlength=len(texts) * dim).reshape(-1, dim).astype(np.float64)
        length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
        vectors = np.divide(counts, length, out=counts, where=length > 0)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dim, pa.array(vectors.ravel()))

    def parts(texts: pa.Array) -> Iterator[pa.Array]:
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        full = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // ENCODED_BYTES)) + 1
        starts = np.union1d(full, np.arange(0, len(texts), ENCODED_ROWS)).tolist()
        return (texts.slice(a, b - a) for a, b in zip(starts, [*starts[1:], len(texts)]))

    @F.arrow_udf("array<double>")
    def vectors_of(texts: pa.Array) -> pa.Array:
        made = [part(x) for x in parts(texts.fill_null(b""))]
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float64()))

    return vectors_of(F.lower(text).cast("binary"))


def sigmoid(logit: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-logit))
