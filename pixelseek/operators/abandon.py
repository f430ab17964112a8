"""Exact re-ranking that gives up on a candidate once its partial distance passes the k-th best.

Distances that are sums of non-negative terms, one per coordinate, are added up block by block of coordinates. Of the
candidates left at the end the distance is computed as a whole, so the answer is that of the plain way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from pixelseek.functions import kernels

# Partial sums are added in another order than the distance: they may differ by their last digits.
SLACK = 1 + 1e-9
COORDINATES = 16
# Candidates of the first step, in multiples of k, and how much more each later step takes.
FIRST, GROWTH = 4, 2

#: For prepared queries, their candidates among the rows: |q| x |rows|.
Candidates = Callable[[object], np.ndarray]


class Abandoning:
    """Rows of one stretch, searched by queries given as (vectors, anything that ``candidates`` takes)."""

    def __init__(self, rows: np.ndarray, metric: str, candidates: Candidates) -> None:
        self.rows, self.block, self.candidates = rows, kernels.BLOCKS[metric], candidates
        #: Coordinates that all candidates have, and that were read.
        self.held = self.read = 0

    def _left(self, query: np.ndarray, at: np.ndarray, top: float) -> np.ndarray:
        """Those of the rows ``at`` whose partial distance never passes ``top``."""
        total = np.zeros(len(at))
        for a in range(0, self.rows.shape[1], COORDINATES):
            part = slice(a, a + COORDINATES)
            x = self.rows[at, part]
            self.read += x.size
            total = total + self.block(x, query[None, part])[:, 0]
            keep = total <= top * SLACK
            at, total = at[keep], total[keep]
        return at

    def search(self, prepared, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, distance) of rows among the k nearest candidates."""
        queries, rest = prepared
        out_q, out_at, out_dist = [], [], []
        for q, (query, marks) in enumerate(zip(queries, self.candidates(rest))):
            near = np.flatnonzero(marks)
            self.held += len(near) * self.rows.shape[1]
            top, at, dist = limit[q], np.empty(0, np.int64), np.empty(0)
            done, want = 0, max(1, FIRST * k)
            while done < len(near):
                part = near[done : done + want]
                if top < np.inf:
                    part = self._left(query, part, top)
                found = self.block(self.rows[part], query[None, :])[:, 0]
                self.read += part.size * self.rows.shape[1]
                at, dist = np.concatenate([at, part]), np.concatenate([dist, found])
                if len(dist) > k:
                    top = min(top, np.partition(dist, k - 1)[k - 1])
                keep = (dist <= top) & np.isfinite(dist)
                at, dist = at[keep], dist[keep]
                done, want = done + want, want * GROWTH
            out_q.append(np.full(len(at), q))
            out_at.append(at)
            out_dist.append(dist)
        return np.concatenate(out_q), np.concatenate(out_at), np.concatenate(out_dist)
