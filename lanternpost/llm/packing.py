"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths.

Every piece is one sequence of its own length, so no sequence crosses documents and none is
padded; sequences of one length form a bucket.  A null or empty text is the end id alone.
Repeated rows are packed one by one.  An empty table gives no pieces.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .helpers import ByteMemo, blocks, utf8

MAX_LENGTH = 2048
END_ID = 1
MARK = "<|endoftext|>"
WORD_END = "</w>"
LAST_MARK = re.compile(rb"(?<=[a-z])([.,])(?=\s|$)")
#: Bytes of remembered words a task holds in each of two generations.
MEMO_BYTES = 96 << 20
LONGEST_WORD = 256


class Places(dict):
    """A number for each word, in the order in which words are first asked for; ``new`` holds those not looked at yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []
        self.next = count().__next__

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        place = self[word] = self.next()
        return place


class WordIds:
    """Ids of texts from a tokenizer whose pre-tokens never span ASCII white space: words are
    encoded once and remembered, in a memo of bounded bytes, as little-endian 32-bit ids.

    ASCII letters are lower-cased as the tokenizer does, and a full stop or comma after a letter and
    before white space, a pre-token of its own, is parted from its word, so that fewer different
    words reach the tokenizer.  Texts that may hold special tokens are left as they are.

    Words are looked up once, for a place in a list; the list is filled when all words of a block are known.
    There are two generations: when the young one holds ``MEMO_BYTES`` it becomes the old one, whose results are
    taken over as they are asked for.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.mark = self.tokenizer.token_to_id(MARK)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.old: dict[bytes, bytes] = {}
        self._start()

    def _start(self) -> None:
        self.places, self.found, self.held = Places(), [], 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _keep(self, at: list[int], ids: np.ndarray, starts: list[int], stops: list[int]) -> None:
        held = ids.tobytes()
        for i, a, b in zip(at, starts, stops):
            self.found[i] = held[4 * a : 4 * b]

    def learn(self) -> None:
        """Encode the new words of a block together.

        Lower-case ASCII letters are one pre-token that no step before the model changes.  Other words of letters alone are,
        but for a few, one pre-token each, which ends with a token that closes a word; a special token stands between the others.
        """
        new, first = self.places.new, len(self.found)
        self.places.new = []
        self.found += map(self.old.get, new)
        ascii_, letters, others = ([], []), ([], []), ([], [])
        for i, word in enumerate(new, first):
            if self.found[i] is not None:
                continue
            text = word.decode()
            if len(word) > LONGEST_WORD or b"<|" in word:
                self.found[i] = self._ids(text).tobytes()
                continue
            at, texts = others if not text.isalpha() else ascii_ if word.isascii() and word.islower() else letters
            at.append(i)
            texts.append(text)
        if ascii_[0]:
            tokens = [[token.id for token in made] for made in map(self.model.tokenize, ascii_[1])]
            stops = np.cumsum([len(t) for t in tokens]).tolist()
            self._keep(ascii_[0], np.fromiter(chain.from_iterable(tokens), np.uint32, stops[-1]), [0, *stops[:-1]], stops)
        if letters[0]:
            ids = self._ids(" ".join(letters[1]))
            stops = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(stops) == len(letters[0]):
                self._keep(letters[0], ids, [0, *stops[:-1]], stops)
            else:  # a letter whose lower case holds a mark
                others = (others[0] + letters[0], others[1] + letters[1])
        if others[0]:
            ids = self._ids(MARK.join(others[1]))
            cuts = np.flatnonzero(ids == self.mark)
            self._keep(others[0], ids, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)])
        self.held += sum(map(len, new)) + sum(map(len, self.found[first:])) + len(new) * ByteMemo.ENTRY

    def encode(self, texts: list[bytes]) -> list[bytes]:
        place, first = self.places.__getitem__, len(self.found)
        placed = [list(map(place, (t if b"<|" in t else LAST_MARK.sub(rb" \1", t.lower())).split())) for t in texts]
        new = self.places.new
        self.learn()
        of = self.found.__getitem__
        made = [b"".join(map(of, p)) for p in placed]
        for i, word in enumerate(new, first):
            if len(word) > LONGEST_WORD:  # computed each time
                del self.places[word]
                self.held -= len(word) + len(self.found[i])
                self.found[i] = b""
        if self.held >= MEMO_BYTES:
            self.old = {word: self.found[i] for word, i in self.places.items()}
            self._start()
        return made


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def binary_lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    """Powers of two up to ``most`` that add up to ``n``, largest first."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, id_: str, text: str, path: str, *, most: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    ``path`` is a tokenizer file; ``length`` is also the bucket.  Sequence ids number the rows
    of each task, so they need no shuffle; they are stable for inputs read from files.
    """
    if most & (most - 1):
        raise ValueError("the longest piece must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    id_type = docs.schema[id_].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, text):
                doc, start, length, ids, total = [], [], [], [], []
                for i, packed in enumerate(word_ids(path).encode(utf8(part.column(text)))):
                    packed += end
                    at, n = 0, len(packed) // 4
                    for size in binary_lengths(n, most):
                        doc.append(i)
                        start.append(at)
                        length.append(size)
                        total.append(n)
                        ids.append(packed[4 * at : 4 * (at + size)])
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                    names=[id_, "start", "length", "ids", "doc_tokens"],
                )

    pieces = docs.select(id_, text).mapInArrow(run, f"`{id_}` {id_type}, start long, length long, ids binary, doc_tokens long")
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Sequences in one folder per length."""
    pieces.hint("rebalance", "length").write.partitionBy("length").parquet(path)
