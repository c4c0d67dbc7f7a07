"""Vantage-point trees over fingerprints of up to 64 bits under Hamming distance.

A vantage point parts the points of a node by a ball around it.  A point inside, within ``radius``
of the boundary, also visits the other side; by the triangle inequality no other branch can hold a
partner.  Small nodes are compared whole.
"""

from __future__ import annotations

import numpy as np

BRUTE = 512


def distances(points: np.ndarray, vantage: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


def split(points: np.ndarray) -> tuple[int, int] | None:
    """A vantage point and a ball radius that halves the points as well as their distances allow."""
    vantage = int(points[len(points) // 2])
    found = np.bincount(distances(points, vantage), minlength=65).cumsum()
    mu = int(np.abs(2 * found - len(points)).argmin())
    return (vantage, mu) if 0 < found[mu] < len(points) else None


class Forest:
    """Merges positions of a group; keeps one edge per merge, so a dense group stays linear."""

    def __init__(self, positions: int) -> None:
        self.label = np.arange(positions)
        self.members: dict[int, list[int]] = {at: [at] for at in range(positions)}
        self.edges: list[tuple[int, int]] = []

    def join(self, row: int, others: np.ndarray) -> None:
        for at in np.unique(self.label[others], return_index=True)[1].tolist():
            own, other = int(self.label[row]), int(self.label[others[at]])
            if other != own:
                small, large = sorted((own, other), key=lambda x: len(self.members[x]))
                moved = self.members.pop(small)
                self.label[moved] = large
                self.members[large] += moved
                self.edges.append((row, int(others[at])))


def search(points: np.ndarray, home: np.ndarray, visit: np.ndarray, radius: int, forest: Forest) -> None:
    """Join every pair of a home position and a home or visiting one that differs in at most ``radius`` bits."""
    todo = [(home, visit)]
    while todo:
        home, visit = todo.pop()
        if not len(home):
            continue
        cut = split(points[home]) if len(home) > BRUTE else None
        if cut is not None:
            d, v = (distances(points[x], cut[0]).astype(np.int16) for x in (home, visit))
            mu = cut[1]
            near = d <= mu
            todo.append((home[near], visit[v <= mu + radius]))
            todo.append((home[~near], np.concatenate([home[near & (d > mu - radius)], visit[v > mu - radius]])))
            continue
        both = np.concatenate([home, visit])
        values = points[both]
        for a in range(0, len(home), 256):
            rows = home[a : a + 256]
            near = np.bitwise_count(values[a : a + len(rows), None] ^ values[None, a:]) <= radius
            for i in np.flatnonzero(near.sum(axis=1) > 1).tolist():
                others = np.flatnonzero(near[i])
                forest.join(int(rows[i]), both[others[others != i] + a])
