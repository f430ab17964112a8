"""Codes laid out by their first two groups, for exact search that skips what cannot be near.

A bucket holds the codes of one pair of clusters in the first two groups. The two table entries of
the pair plus the least entries of all other groups bound the distances of the whole bucket from
below. Buckets are read in the order of that bound until it passes the k-th best distance; within
them, codes are dropped as soon as their partial distance plus the least rest passes it.
"""

from __future__ import annotations

import numpy as np

# Bounds and distances are sums in another order: they may differ by their last digits.
SLACK = 1 + 1e-9
# Each time more buckets are read, so many times more codes.
GROWTH = 4
# Groups added between two looks at the partial distances.
STRIDE = 2


class MultiIndex:
    def __init__(self, codes: np.ndarray) -> None:
        n, self.groups = codes.shape
        leading = codes[:, : min(2, self.groups)].astype(np.int64)
        key = leading[:, 0]
        if self.groups > 1:
            key = key * (1 + int(leading[:, 1].max(initial=0))) + leading[:, 1]
        self.order = np.argsort(key, kind="stable")
        self.columns = np.ascontiguousarray(codes[self.order].T)
        starts = np.flatnonzero(np.diff(key[self.order], prepend=-1))
        self.starts, self.sizes = starts, np.diff(starts, append=n)
        self.pairs = [c[starts] for c in self.columns[:2]]
        #: Buckets that searches have met and read, codes whose distance was begun.
        self.met = self.read = self.begun = 0

    def _rows(self, buckets: np.ndarray) -> np.ndarray:
        sizes = self.sizes[buckets]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1]) + np.repeat(self.starts[buckets] - (ends - sizes), sizes)

    def _near(self, table: np.ndarray, rows: np.ndarray, limit: float, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the rows not beyond the limit; ``rest[g]``: the least sum of the groups after g."""
        self.begun += len(rows)
        total = table[0][self.columns[0][rows]]
        for g in range(1, self.groups):
            total = total + table[g][self.columns[g][rows]]
            last = g == self.groups - 1
            if last or (g % STRIDE == 1 and limit < np.inf):
                keep = total <= limit if last else total + rest[g] <= limit * SLACK
                rows, total = rows[keep], total[keep]
        return rows, total

    def search(self, tables: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, distance) of rows among the k nearest, by tables |q| x groups x clusters."""
        least = tables.min(axis=2)
        rest = least.sum(axis=1, keepdims=True) - np.cumsum(least, axis=1)
        bounds = rest[:, [len(self.pairs) - 1]] + sum(tables[:, g, pair] for g, pair in enumerate(self.pairs))
        out_q, out_at, out_dist = [], [], []
        for q, (table, bound) in enumerate(zip(tables, bounds)):
            top = limit[q]
            order = np.argsort(bound, kind="stable")
            bound, ends = bound[order], np.cumsum(self.sizes[order])
            at, dist = np.empty(0, np.int64), np.empty(0)
            done, want = 0, k
            self.met += len(order)
            while done < len(order) and bound[done] <= top * SLACK:
                stop = 1 + np.searchsorted(ends, (ends[done - 1] if done else 0) + want)
                stop = min(stop, int(np.searchsorted(bound, top * SLACK, "right")))
                rows, found = self._near(table, self._rows(order[done:stop]), top, rest[q])
                at, dist = np.concatenate([at, rows]), np.concatenate([dist, found])
                if len(dist) > k:
                    top = min(top, np.partition(dist, k - 1)[k - 1])
                    keep = dist <= top
                    at, dist = at[keep], dist[keep]
                done, want = stop, want * GROWTH
            self.read += done
            out_q.append(np.full(len(at), q))
            out_at.append(at)
            out_dist.append(dist)
        return np.concatenate(out_q), self.order[np.concatenate(out_at)], np.concatenate(out_dist)
