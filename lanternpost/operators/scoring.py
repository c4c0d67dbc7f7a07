"""Block scoring of unit vectors inside tasks: matrices, and the best hits over blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

DIGITS = 9
QUERY_STEP = 1024
KB_STEP = 1024
#: Of the cells of a step; above this share candidates are not looked up one by one.
DENSE = 0.02
PENDING = 1 << 18


def unit_matrix(vectors) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    if len(vectors) == 0:
        return np.zeros((0, 0))
    m = np.vstack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def list_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column as they are; all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % len(column) or len(np.unique(column.value_lengths().to_numpy(zero_copy_only=False))) > 1:
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def true_places(hit: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a contiguous mask with few hits: eight cells are looked at as one number."""
    cells = hit.reshape(-1)
    even = len(cells) & ~7
    eights = np.flatnonzero(cells[:even].view(np.uint64))
    at, inside = np.nonzero(cells[:even].reshape(-1, 8)[eights])
    return np.concatenate([eights[at] * 8 + inside, even + np.flatnonzero(cells[even:])])


class Best:
    """The ``k`` best rows per query of all blocks it has seen; ties go to the smaller id.

    Rows of ``q`` are unit or zero vectors.  ``reached`` is the least similarity that counts, for all or
    per query.  A step is scored in single precision; what comes near a query's k-th hit so far is
    scored again in double precision, and a step with many such pairs as a whole.  What is held grows
    with the queries and ``k``, not with the blocks.
    """

    def __init__(self, q: np.ndarray, k: int, reached: float | np.ndarray | None = None, step: int = QUERY_STEP) -> None:
        self.q, self.k, self.step, self.rough = q, k, step, q.astype(np.float32)
        self.slack = (q.shape[1] + 4) * 2.0**-23 + 10.0**-DIGITS if q.size else 0.0
        self.least = np.full(len(q), -2.0) if reached is None else np.maximum(np.zeros(len(q)) + reached, -2.0)
        self.full = np.zeros(len(q), bool)
        self.last = np.empty(len(q), object)
        self.rows, self.ids, self.sims = np.zeros(0, np.int64), None, np.zeros(0)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_pending = 0

    def add(self, kb_ids: np.ndarray, kb: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Meet the queries ``rows`` (all, if None) with a block of unit or zero vectors."""
        if not len(kb) or not len(self.q):
            return
        rows = np.arange(len(self.q)) if rows is None else rows
        rough = kb.astype(np.float32)
        self.ids = kb_ids[:0] if self.ids is None else self.ids
        for i in range(0, len(rows), self.step):
            mine = rows[i : i + self.step]
            q = self.rough[mine]
            for j in range(0, len(kb), KB_STEP):
                self._step(mine, q, kb_ids[j : j + KB_STEP], kb[j : j + KB_STEP], rough[j : j + KB_STEP])

    def _step(self, mine: np.ndarray, q: np.ndarray, ids: np.ndarray, kb: np.ndarray, rough: np.ndarray) -> None:
        at = true_places(q @ rough.T >= (self.least[mine] - self.slack).astype(np.float32)[:, None])
        if not len(at):
            return
        if len(at) > DENSE * len(q) * len(kb):
            exact = np.round(self.q[mine] @ kb.T, DIGITS) + 0.0
            width = exact.shape[1]
            floor = self.least[mine]
            if width > self.k:
                floor = np.maximum(floor, np.partition(exact, width - self.k, axis=1)[:, width - self.k])
            raised = floor > self.least[mine]
            self.least[mine[raised]], self.full[mine[raised]] = floor[raised], False
            r, c = np.nonzero(exact >= floor[:, None])
            sims = exact[r, c]
        else:
            r, c = np.divmod(at, len(kb))
            sims = np.round(np.einsum("ij,ij->i", self.q[mine[r]], kb[c]), DIGITS) + 0.0
        r, ids = mine[r], ids[c]
        keep = sims >= self.least[r]
        tied = np.flatnonzero(keep & (sims == self.least[r]) & self.full[r])
        keep[tied] = (ids[tied] < self.last[r[tied]]).astype(bool)
        if keep.any():
            self.pending.append((r[keep], ids[keep], sims[keep]))
            self.n_pending += len(self.pending[-1][0])
            if self.n_pending > max(PENDING, len(self.rows)):
                self._settle()

    def _settle(self) -> None:
        if not self.pending:
            return
        rows, ids, sims = (np.concatenate(x) for x in zip((self.rows, self.ids, self.sims), *self.pending))
        self.pending, self.n_pending = [], 0
        order = np.lexsort((-sims, rows))
        rows, ids, sims = rows[order], ids[order], sims[order]
        same = (rows[1:] == rows[:-1]) & (sims[1:] == sims[:-1])
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if len(tied):  # only equal similarities are ordered by id
            by_id = tied[np.lexsort((np.unique(ids[tied], return_inverse=True)[1], -sims[tied], rows[tied]))]
            ids[tied] = ids[by_id]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        kept = place < self.k
        self.rows, self.ids, self.sims = rows[kept], ids[kept], sims[kept]
        ends = np.flatnonzero(place == self.k - 1)
        self.full[rows[ends]], self.last[rows[ends]], self.least[rows[ends]] = True, ids[ends], sims[ends]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, ids, similarities), ordered by row and rank."""
        self._settle()
        return self.rows, np.zeros(0, object) if self.ids is None else self.ids, self.sims
