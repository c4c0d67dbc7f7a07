"""Token counts by byte-pair merging with a heap of pairs over a linked list of symbols.

The pair with the best rank is popped and merged until none is left; the count is the initial
symbols less the merges, where a character without a piece that no merge took up counts its
UTF-8 bytes.  No identifiers are made.  Words are cut where no piece holds two neighbouring
characters, so parts merge on their own and are remembered in a memo of bounded size.

A null or empty text has no tokens.  Special strings in texts are ordinary text.  Repeated rows
are counted one by one; an empty table gives an empty table; input columns are passed through.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pieces
from .helpers import BoundedMemo, with_text_columns

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]


class PairMerger:
    def __init__(self, vocabulary: pieces.Vocabulary) -> None:
        if pieces.crossing(vocabulary):
            raise ValueError("a piece holds a marker after another character")
        self.scores = vocabulary.scores
        self.pairs = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        self.parts = BoundedMemo(self._count_part)
        self.words = BoundedMemo(self._count_word)

    def _count_part(self, part: str) -> int:
        """Merge one part; symbols are [start, end) spans chained by next and previous."""
        n = len(part)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        scores = self.scores
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            score = scores.get(part[left : end[right]])
            if score is not None:
                heapq.heappush(heap, (-score, left, right, end[right]))

        for i in range(n - 1):
            offer(i, i + 1)
        merges = 0
        while heap:
            _, left, right, stop = heapq.heappop(heap)
            if not alive[left] or after[left] != right or right >= n or not alive[right] or end[right] != stop:
                continue
            merges += 1
            alive[right] = False
            end[left] = stop
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
                offer(left, after[right])
            if before[left] >= 0:
                offer(before[left], left)
        count = n - merges
        for i in range(n):
            if alive[i] and end[i] == i + 1 and part[i] not in scores:
                count += len(part[i].encode()) - 1
        return count

    def _count_word(self, word: str) -> int:
        """``word`` follows a marker."""
        unit = pieces.MARKER + word
        count, start = 0, 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in self.pairs:
                count += self.parts[unit[start:i]]
                start = i
        return count + self.parts[unit[start:]]

    def count(self, text: str) -> int:
        if not text:
            return 0
        if text[0] != " " and text[-1] != " " and "  " not in text and pieces.MARKER not in text:
            words = text.split(" ")
        else:
            words = [u[1:] for u in pieces.units(pieces.MARKER + text.replace(" ", pieces.MARKER))]
        return sum(map(self.words.__getitem__, words))


@lru_cache(2)
def merger(path: str) -> PairMerger:
    return PairMerger(pieces.load(path))


def count_tokens(docs: DataFrame, text: str, into: str, path: str) -> DataFrame:
    """All columns of ``docs`` and a struct ``into``: n_bytes, n_tokens by the model file ``path``."""

    def counted(texts: list[bytes]) -> list[pa.Array]:
        own = merger(path)
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array([own.count(t.decode()) for t in texts], pa.int64())]

    return with_text_columns(docs, text, into, FIELDS, counted)
