"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The trie is keyed by UTF-8 bytes.  Spaces become markers and a marker is put in front; a
character that no piece covers falls back to byte pieces, as does a marker character of the text
itself, so decoding gives back every text.  Of equally good paths the one whose last piece
starts first wins.  Words are encoded on their own and remembered in memos of bounded bytes.

A null or empty text has no pieces and decodes to the empty text.  Repeated rows are encoded one
by one; an empty table gives an empty table; input columns are passed through.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import pieces
from .helpers import ByteMemo, with_text_columns

#: A character without a piece scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
MARK = pieces.MARKER.encode()
NEVER = float("-inf")
#: Cells that a search for a free place may look back over.
SEARCH = 64
FIELDS = [T.StructField("ids", T.BinaryType()), T.StructField("n_pieces", T.LongType()), T.StructField("n_byte_pieces", T.LongType())]


class DoubleArray:
    """Trie over byte strings: the child of state s by byte b is base[s] + b + 1 if check there is s."""

    def __init__(self, keys: dict[bytes, int]) -> None:
        root: dict = {}
        for key, value in keys.items():
            node = root
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        self.base, self.check, self.value = [1], [-1], [-1]
        used = 1
        todo = [(0, root)]
        for state, node in todo:
            if -1 in node:
                self.value[state] = node[-1]
            labels = sorted(b for b in node if b >= 0)
            if not labels:
                continue
            base = first = max(1, used - labels[0])
            while not self._fits(base, labels):
                base += 1
            if base - first > SEARCH:
                used = max(used, base + labels[0] - SEARCH)
            self.base[state] = base
            for b in labels:
                self.check[base + b + 1] = state
                todo.append((base + b + 1, node[b]))
            while used < len(self.check) and self.check[used] >= 0:
                used += 1

    def _fits(self, base: int, labels: list[int]) -> bool:
        grow = base + labels[-1] + 2 - len(self.check)
        if grow > 0:
            self.base += [0] * grow
            self.check += [-1] * grow
            self.value += [-1] * grow
        return all(self.check[base + b + 1] < 0 for b in labels)

    def prefixes(self, text: bytes, start: int) -> list[tuple[int, int]]:
        """(end, value) of every key that starts at ``start``, shortest first."""
        state, found = 0, []
        base, check, value = self.base, self.check, self.value
        size = len(check)
        for i in range(start, len(text)):
            at = base[state] + text[i] + 1
            if at >= size or check[at] != state:
                break
            state = at
            if value[state] >= 0:
                found.append((i + 1, value[state]))
        return found


class Unigram:
    def __init__(self, vocabulary: pieces.Vocabulary) -> None:
        if pieces.crossing(vocabulary):
            raise ValueError("a piece holds a marker after another character")
        self.trie = DoubleArray({p.encode(): i for p, i in vocabulary.ids.items()})
        self.score = {vocabulary.ids[p]: s for p, s in vocabulary.scores.items()}
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.byte_ids = vocabulary.byte_ids
        self.bytes_of = [t.replace(pieces.MARKER, " ").encode() for t in vocabulary.texts]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.is_byte = np.zeros(len(vocabulary.texts), bool)
        self.is_byte[self.byte_ids] = True
        self.pairs = {p[i : i + 2] for p in vocabulary.scores for i in range(len(p) - 1)}
        self.words, self.parts = ByteMemo(self._packed), ByteMemo(self._part)

    def viterbi(self, unit: bytes) -> tuple[float, list[int]]:
        """Best score and ids of one unit."""
        n = len(unit)
        best = [NEVER] * (n + 1)
        start_of, piece_of = [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        size = len(check)
        for i in range(n):
            so_far = best[i]
            if so_far == NEVER:
                continue
            lead = unit[i]
            single = i + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            covered, state = False, 0
            for end in range(i + 1, n + 1):
                at = base[state] + unit[end - 1] + 1
                if at >= size or check[at] != state:
                    break
                state = at
                piece = value[at]
                if piece >= 0:
                    covered |= end == single
                    total = so_far + score[piece]
                    if total > best[end]:
                        best[end], start_of[end], piece_of[end] = total, i, piece
            if not covered and so_far + self.unknown > best[single]:
                best[single], start_of[single], piece_of[single] = so_far + self.unknown, i, -1
        ids: list[int] = []
        at = n
        while at:
            start, piece = start_of[at], piece_of[at]
            ids += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(unit[start:at])]
            at = start
        return best[n], ids[::-1]

    def _part(self, part: str) -> bytes:
        return np.array(self.viterbi(part.encode())[1], "<u4").tobytes()

    def _packed(self, word: str) -> bytes:
        """Ids of a word after a marker, cut where no piece holds two neighbouring characters: parts come more often than words."""
        unit = pieces.MARKER + word
        pairs, parts, out, start = self.pairs, self.parts, [], 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in pairs:
                out.append(parts[unit[start:i]])
                start = i
        out.append(parts[unit[start:]])
        return b"".join(out)

    def _literal(self, text: str) -> bytes:
        """Ids of a text that holds spaces in runs, or markers of its own."""
        out = []
        for k, part in enumerate(text.split(pieces.MARKER)):
            if k:
                out.append(np.array([self.byte_ids[b] for b in MARK], "<u4").tobytes())
            spaced = part.replace(" ", pieces.MARKER) if k else pieces.MARKER + part.replace(" ", pieces.MARKER)
            out += [np.array(self.viterbi(u.encode())[1], "<u4").tobytes() for u in pieces.units(spaced)]
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        if text[0] == " " or text[-1] == " " or "  " in text or pieces.MARKER in text:
            return self._literal(text)
        return b"".join(map(self.words.__getitem__, text.split(" ")))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes; the marker put in front is taken off."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:]


@lru_cache(2)
def unigram(path: str) -> Unigram:
    return Unigram(pieces.load(path))


def encode(docs: DataFrame, text: str, into: str, path: str) -> DataFrame:
    """All columns of ``docs`` and a struct ``into``: ids (little-endian 32-bit), n_pieces, n_byte_pieces."""

    def encoded(texts: list[bytes]) -> list[pa.Array]:
        own = unigram(path)
        ids = [own.encode(t.decode()) for t in texts]
        low = [int(own.is_byte[np.frombuffer(x, "<u4")].sum()) for x in ids]
        return [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(low, pa.int64())]

    return with_text_columns(docs, text, into, FIELDS, encoded)


def decode(encoded: DataFrame, ids: str, into: str, path: str) -> DataFrame:
    """All columns of ``encoded`` and a struct ``into`` with the decoded ``text``; null ids give the empty text."""

    def decoded(blobs: list[bytes]) -> list[pa.Array]:
        own = unigram(path)
        return [pa.array([own.decode(np.frombuffer(x, "<u4")) for x in blobs], pa.binary()).cast(pa.string())]

    return with_text_columns(encoded, ids, into, [T.StructField("text", T.StringType())], decoded)
