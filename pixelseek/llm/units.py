"""Texts cut into units of code points, and a memory of what each different unit is encoded to.

Tokenizers with cut rules encode a text piece by piece, and most pieces are words seen before. Units are told apart by a
64-bit hash of their code points together with a second, independent one; both must agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def letters(cps: np.ndarray, seed: int = 0x94D049BB133111EB) -> np.ndarray:
    """A random 64-bit number for each code point."""
    z = cps.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(seed)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Units:
    """The units of a batch: each different one once, and which one stands where."""

    def __init__(self, cps: np.ndarray, starts: np.ndarray):
        self.cps, n = cps, len(cps)
        lengths = np.diff(np.append(starts, n))
        up, back = powers(BASE, n), powers(BACK, n)[starts]
        both = []
        for seed in (0x94D049BB133111EB, 0x5851F42D4C957F2D):
            sums = np.append(np.uint64(0), np.cumsum(letters(cps, seed) * up, dtype=np.uint64))
            both.append(mix((sums[starts + lengths] - sums[starts]) * back) + lengths.astype(np.uint64))
        self.hashes, first, self.which = np.unique(both[0], return_index=True, return_inverse=True)
        self.checks = both[1][first]
        if (self.checks[self.which] != both[1]).any():
            raise ValueError("two units of equal hash in one batch")
        self.starts, self.lengths = starts[first], lengths[first]

    def text(self, k: int) -> str:
        part = self.cps[self.starts[k] : self.starts[k] + self.lengths[k]]
        return part.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


class Memory:
    """Ids of units by hash: sorted arrays, some forty bytes a unit; starts anew beyond ``limit`` units."""

    def __init__(self, limit: int):
        self.limit = limit
        self.forget()

    def forget(self) -> None:
        self.seen, self.checks = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
        self.starts, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int32)

    def missing(self, units: Units) -> np.ndarray:
        """Numbers of the units not known yet."""
        if len(self.seen) + len(units.hashes) > self.limit:
            self.forget()
        place = np.searchsorted(self.seen, units.hashes)
        new = np.ones(len(units.hashes), dtype=bool)
        at = np.flatnonzero(place < len(self.seen))
        same = self.seen[place[at]] == units.hashes[at]
        if (self.checks[place[at[same]]] != units.checks[at[same]]).any():
            # Two units of equal hash: what is known makes way.
            self.forget()
            return np.arange(len(units.hashes))
        new[at[same]] = False
        return np.flatnonzero(new)

    def add(self, units: Units, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the units of these numbers, one after the other."""
        at = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, ids.astype(np.int32)])
        order = np.argsort(units.hashes[numbers])
        numbers = numbers[order]
        place = np.searchsorted(self.seen, units.hashes[numbers])
        self.seen = np.insert(self.seen, place, units.hashes[numbers])
        self.checks = np.insert(self.checks, place, units.checks[numbers])
        self.starts = np.insert(self.starts, place, at[order])
        self.sizes = np.insert(self.sizes, place, sizes[order])

    def gather(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the batch in order, and where each unit's ids end."""
        place = np.searchsorted(self.seen, units.hashes)[units.which]
        sizes = self.sizes[place]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        return self.pool[np.repeat(self.starts[place] - stops + sizes, sizes) + np.arange(total)], stops


def in_parts(texts: list[str | None], chars: int) -> Iterator[list[str | None]]:
    """Texts that follow each other, together up to a number of characters; a longer one by itself."""
    part = np.cumsum([len(t or "") for t in texts]) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)] if texts else [0]
    for a, b in zip(cuts, cuts[1:]):
        yield texts[a:b]


def split_by_text(ids: np.ndarray, stops: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ids per text: ``starts`` of units, ``ends`` of texts in code points."""
    counts = np.append(0, stops)[np.searchsorted(starts, ends)]
    return np.split(ids, counts[:-1])
