"""Codes laid out for many queries at once: exact search by tables of small whole numbers.

Distances are sums of table entries, one per group. The groups are cut into chunks whose pairs of clusters, triples and
so on are numbered; for some QUERIES queries side by side each chunk has a table of bytes with the chunk's part of the
distance, rounded down to steps of a STEPS-th of what is left between the least distance and a limit. Rows whose bytes
add up to more than STEPS are beyond the limit; of the others, few, the distance is computed as ``table_distances`` does.

The limit of a query comes from a sample of the rows. Where it leaves fewer than k rows the query is asked again with a
larger one, so the answer is that of the full scan whatever the sample. Equal codes are one row of the layout.
"""

from __future__ import annotations

import numpy as np

QUERIES, STEPS = 128, 126
# Entries of a chunk's table at most, and rows for each of them at least; entries that are summed before rounding.
CELLS, ROWS_PER_CELL, UNIT = 1 << 16, 8, 1 << 10
# Rows whose bytes are added together, and how many of them share one look for small sums.
ROWS, FOLD = 4096, 16
SAMPLE, WIDER = 8192, 8
# (query, row) pairs that are held before they are cut to the k nearest of each query.
HELD = 1 << 21
# The limit's rounding: sums in another order may differ by their last digits.
SLACK, SAMPLE_SLACK = 1e-9, 1e-5
# So little is left between two distances at least, that its inverse is a number.
LEAST = 1e-250


def _chunks(groups: int, width: int, rows: int) -> list[list[int]]:
    """The groups in runs of nearly one length, each with few enough combinations."""
    cells, long = max(1, min(CELLS, rows // ROWS_PER_CELL)), 1
    while long < groups and width ** (long + 1) <= cells:
        long += 1
    return [c.tolist() for c in np.array_split(np.arange(groups), -(-groups // long))]


class CodeTables:
    """Rows of one block of codes; of equal distances those of the lowest ``ids`` count as nearer."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, width: int) -> None:
        n, self.groups = codes.shape
        if n and not 0 <= codes.min() <= codes.max() < width:
            raise IndexError(f"codes from {codes.min()} to {codes.max()} for {width} clusters")
        self.width, self.chunks = width, _chunks(self.groups, width, n)
        keys = []
        for chunk in self.chunks:
            key = np.zeros(n, dtype=np.int64)
            for g in chunk:
                key = key * width + codes[:, g]
            keys.append(key.astype(np.uint16) if width ** len(chunk) <= 1 << 16 else key)
        self.order = np.lexsort((ids, *keys[::-1]))
        keys = [key[self.order] for key in keys]
        new = np.ones(n, dtype=bool)
        if n:
            new[1:] = np.any([key[1:] != key[:-1] for key in keys], axis=0)
        #: Where each different code begins among the ordered rows, and how many have it.
        self.starts = np.flatnonzero(new)
        self.sizes = np.diff(self.starts, append=n)
        self.keys = [key[self.starts].astype(np.intp) for key in keys]
        self.columns = np.ascontiguousarray(codes[self.order[self.starts]].T)
        self.first = ids[self.order[self.starts]]
        places = np.arange(n)
        if n > SAMPLE:
            places = np.random.default_rng(0).choice(n, SAMPLE, replace=False)
        self.sample = np.searchsorted(self.starts, places, "right") - 1
        #: Rows that came within the limit by their bytes, and queries that were asked again.
        self.met = self.again = 0

    def search(self, tables: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, distance) of the rows among the k nearest, by tables |q| x groups x clusters."""
        tables = np.where(np.isnan(tables), np.inf, tables)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        # Queries that are infinitely far from all clusters of a group have no neighbours.
        near = np.isfinite(tables.min(axis=2)).all(axis=1)
        rank = self._first_rank(k)
        asked = np.flatnonzero(near) if len(self.order) else np.empty(0, np.int64)
        while len(asked):
            short = []
            step = QUERIES if rank is not None else max(1, min(QUERIES, HELD // len(self.starts)))
            for a in range(0, len(asked), step):
                part = asked[a : a + step]
                q, at, dist, missed = self._search(tables[part], limit[part], k, rank)
                out.append((part[q], at, dist))
                short.append(part[missed])
            asked = np.concatenate(short)
            self.again += len(asked)
            rank = rank * WIDER if rank is not None and rank * WIDER <= len(self.sample) else None
        return tuple(np.concatenate(x) for x in zip(*out))

    def _first_rank(self, k: int) -> int | None:
        """The place in the sample whose distance k rows hardly miss; ``None``: no limit."""
        n, held = len(self.order), len(self.sample)
        if k >= n:
            return None
        if held == n:
            return k
        share = k * held / n
        rank = int(np.ceil(share + 3 * np.sqrt(share) + 3))
        return rank if rank <= held else None

    def _units(self, tables: np.ndarray) -> list[list[np.ndarray]]:
        """By chunk, the table entries of one group or of two, cells x |q|."""
        by_group = np.ascontiguousarray(tables.transpose(1, 2, 0))
        pairs = self.width * self.width <= UNIT
        units = []
        for chunk in self.chunks:
            parts = []
            while chunk:
                unit, chunk = by_group[chunk[0]], chunk[1:]
                if pairs and chunk:
                    unit, chunk = (unit[:, None] + by_group[chunk[0]]).reshape(-1, len(tables)), chunk[1:]
                parts.append(unit)
            units.append(parts)
        return units

    def _sampled(self, units: list[list[np.ndarray]], rank: int) -> np.ndarray:
        """For each query the distance at place ``rank`` of the sample, about."""
        total = np.zeros((len(self.sample), units[0][0].shape[1]), dtype=np.float32)
        with np.errstate(over="ignore"):
            for parts, keys in zip(units, self.keys):
                key, cells = keys[self.sample], 1
                for unit in parts[::-1]:
                    total += unit.astype(np.float32).take(key // cells % len(unit), axis=0)
                    cells *= len(unit)
        total = np.ascontiguousarray(total.T)
        return np.partition(total, rank - 1, axis=1)[:, rank - 1].astype(float) * (1 + SAMPLE_SLACK)

    def _bytes(self, units: list[list[np.ndarray]], limit: np.ndarray) -> list[np.ndarray]:
        """By chunk, the steps from the least distance, rounded down and at most STEPS + 1: cells x |q|."""
        low = sum(unit.min(axis=0) for parts in units for unit in parts)
        steps = STEPS / np.maximum(limit * (1 + SLACK) - low, LEAST)
        tables = []
        for parts in units:
            table = None
            for unit in parts:
                with np.errstate(over="ignore"):
                    own = np.minimum((unit - unit.min(axis=0)) * steps, STEPS + 1).astype(np.uint8)
                if table is None:
                    table = own
                    continue
                both = np.empty((len(table), len(own), own.shape[1]), np.uint8)
                np.add(table[:, None], own, out=both)
                table = np.minimum(both, STEPS + 1, out=both).reshape(-1, own.shape[1])
            tables.append(table)
        return tables

    def _search(
        self, tables: np.ndarray, limit: np.ndarray, k: int, rank: int | None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, distance), and the numbers of queries that a larger limit has to be tried for."""
        units = self._units(tables)
        top = np.where(np.isfinite(tables), tables, -np.inf).max(axis=2).sum(axis=1)
        if rank is not None:
            # A limit of the caller's may leave fewer than k rows: it has k others that are as near.
            top = np.minimum(top, self._sampled(units, rank))
        tried = top < limit
        top = np.minimum(top, limit)
        q, at, dist = self._within(tables, units, top, k)
        rows = np.bincount(q, weights=np.minimum(self.sizes[at], k), minlength=len(tables))
        missed = tried & (rows < k) if rank is not None else np.zeros(len(tables), dtype=bool)
        keep = ~missed[q]
        q, at, dist = q[keep], at[keep], dist[keep]
        sizes = np.minimum(self.sizes[at], k)
        ends = np.cumsum(sizes)
        places = np.arange(sizes.sum()) + np.repeat(self.starts[at] - (ends - sizes), sizes)
        return np.repeat(q, sizes), self.order[places], np.repeat(dist, sizes), np.flatnonzero(missed)

    def _within(
        self, tables: np.ndarray, units: list[list[np.ndarray]], top: np.ndarray, k: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, different code, distance) of the k nearest that are not beyond ``top``."""
        n, m = len(self.starts), len(tables)
        steps = self._bytes(units, top)
        total, other = np.empty((ROWS, m), np.uint8), np.empty((ROWS, m), np.uint8)
        least = np.empty((ROWS // FOLD, m), np.uint8)
        best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        held, new = [], 0
        for a in range(0, n, ROWS):
            b = min(a + ROWS, n)
            steps[0].take(self.keys[0][a:b], axis=0, out=total[: b - a], mode="clip")
            for i in range(1, len(steps)):
                steps[i].take(self.keys[i][a:b], axis=0, out=other[: b - a], mode="clip")
                np.add(total[: b - a], other[: b - a], out=total[: b - a])
                if i < len(steps) - 1:
                    np.minimum(total[: b - a], STEPS + 1, out=total[: b - a])
            total[b - a :] = STEPS + 1
            np.minimum.reduce(total.reshape(FOLD, -1, m), axis=0, out=least)
            cells = np.flatnonzero(least <= STEPS)
            fold, at = np.nonzero(total.reshape(FOLD, -1).take(cells, axis=1) <= STEPS)
            row, q = np.divmod(cells[at], m)
            held.append((q, row + fold * (ROWS // FOLD) + a))
            new += len(q)
            if new > HELD or b == n:
                self.met += new
                best = self._cut(tables, best, held, top, k)
                held, new = [], 0
        return best

    def _cut(self, tables: np.ndarray, best: tuple, held: list, top: np.ndarray, k: int) -> tuple:
        """The k nearest of each query, with all at the last distance unless they are many; lowers ``top`` to it."""
        q, at = (np.concatenate(x) for x in zip(*held))
        flat, line = tables.reshape(-1), q * (self.groups * self.width)
        dist = np.zeros(len(q))
        for g, column in enumerate(self.columns):
            dist += flat.take(line + g * self.width + column.take(at))
        keep = np.flatnonzero((dist <= top[q]) & np.isfinite(dist))
        q, at, dist = (np.concatenate(x) for x in zip(best, (q[keep], at[keep], dist[keep])))
        order = np.argsort(q.astype(np.uint16), kind="stable")
        q, at, dist = q[order], at[order], dist[order]
        ends = np.searchsorted(q, np.arange(len(tables) + 1))
        alone = self.sizes.max(initial=0) == 1
        out = []
        for n, (a, b) in enumerate(zip(ends, ends[1:])):
            d = dist[a:b]
            if alone and b - a > k:
                top[n] = np.partition(d, k - 1)[k - 1]
            elif not alone and b > a:
                nearest = np.argsort(d)
                rows = np.cumsum(np.minimum(self.sizes[at[a:b][nearest]], k))
                if rows[-1] >= k:
                    top[n] = d[nearest[np.searchsorted(rows, k)]]
            kept = np.flatnonzero(d <= top[n])
            if len(kept) > 4 * k:
                # Codes of one distance: by the lowest row of each, no more than k of them count.
                kept = kept[np.lexsort((self.first[at[a:b][kept]], d[kept]))[:k]]
            out.append(a + kept)
        kept = np.concatenate(out)
        return q[kept], at[kept], dist[kept]
