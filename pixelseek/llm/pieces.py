"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

For models of byte-pair pieces with identity normalisation, a space put before the text and byte fallback. Texts are cut
where no piece can reach across: before a run of blanks and around characters that no piece holds. Different units are
encoded once, equally long ones side by side: position after position, the hash of every substring that ends there probes
the sorted hashes of the pieces, and the maximum over the pieces found is stored as backpointer.

Which score makes the best path the model's own segmentation? Byte-pair merging gives a segmentation in which every two
neighbours stay apart when merged by themselves, and only one has this property. So a piece may follow the piece before
it only if the pair passes that test (merges undone from the latest to the earliest, none across the border being due
before), and of the pieces that may, the longest one is the maximum. Units with runs of blanks, whose pieces tie in
score, are merged pair by pair with a heap, in time n log n. A unit over ``LONGEST`` characters (texts without blanks)
goes through the same search by itself, with all its substrings probed at once, length by length.

Defined cases: null and empty texts have no pieces; unknown characters become their UTF-8 bytes' pieces; the sign that
stands for blanks inside pieces (U+2581) reads back as a blank when a text holds it, as in the library, and ``exact`` is
false then; whole texts of any length are encoded, long ones by themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pixelseek.llm.units import BACK, BASE, Memory, Units, code_points, in_parts, letters, powers, split_by_text

BLANK = "▁"
#: Longer units are searched one by one.
LONGEST = 256
#: Characters of texts that are encoded side by side.
BATCH_CHARS = 1 << 20
#: Units that a worker remembers before it starts anew.
REMEMBERED = 3_000_000

_NONE = np.int32(-1)


class Pieces:
    """A model's pieces as arrays; made once on the driver and sent to the tasks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.bytes_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        plain = [i for i in range(n) if i not in special and not model.is_byte(i)]
        for i in plain:
            if BLANK in self.text[i].lstrip(BLANK):
                raise ValueError("a piece with a blank inside")
        self.spelled = [b"" if i in special else self.text[i].encode() for i in range(n)]
        for b, i in enumerate(self.bytes_ids):
            self.spelled[i] = bytes([b])
        self.scores = np.array([model.get_score(i) for i in range(n)])
        self.ids = {self.text[i]: i for i in plain}
        self.length = np.array([len(t) for t in self.text], dtype=np.int64)
        self.longest = max(len(self.text[i]) for i in plain)
        # Early merges have low ranks; single characters come before all.
        order = sorted((i for i in plain if len(self.text[i]) > 1), key=lambda i: (-self.scores[i], i))
        self.rank = np.full(n, -1, dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        hashes = np.zeros(n, dtype=np.uint64)
        for i in plain:
            hashes[i] = (letters(code_points(self.text[i])) * powers(BASE, len(self.text[i]))).sum(dtype=np.uint64)
        self.hashes = hashes
        ids = np.array(plain, dtype=np.int32)
        by_hash = np.argsort(hashes[ids])
        self.keys, self.key_ids = hashes[ids][by_hash], ids[by_hash]
        # Most substrings are no piece: a bitmap by 22 bits of the hash says so before the search.
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        self.char_id = np.full(0x110000, _NONE, dtype=np.int32)
        for i in plain:
            if len(self.text[i]) == 1:
                self.char_id[ord(self.text[i])] = i
        # What each piece was merged from at last.
        self.left, self.right = np.full(n, _NONE, dtype=np.int32), np.full(n, _NONE, dtype=np.int32)
        for i in order:
            if self.text[i].strip(BLANK):
                self.left[i], self.right[i] = self.last_merge(self.text[i])

    def last_merge(self, text: str) -> tuple[int, int]:
        parts = list(text)
        while len(parts) > 2:
            best = None
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best[0]):
                    best = (self.scores[i], k)
            if best is None:
                return _NONE, _NONE
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return self.ids.get(parts[0], _NONE), self.ids.get(parts[1], _NONE)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 if none."""
        out = np.full(len(hashes), _NONE, dtype=np.int32)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
        h = hashes[at]
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        same = self.keys[place] == h
        out[at[same]] = self.key_ids[place[same]]
        return out

    def merge(self, unit: str) -> list[int]:
        """Byte-pair merging of one unit of known characters, best score first, then leftmost."""
        n = len(unit)
        parts, after, before = list(unit), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                both = parts[k] + parts[after[k]]
                i = self.ids.get(both)
                if i is not None:
                    heapq.heappush(heap, (-float(self.scores[i]), k, both))

        for k in range(n):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            m = after[k]
            if not parts[k] or m >= n or parts[k] + parts[m] != both:
                continue
            parts[k], parts[m] = both, ""
            after[k] = after[m]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [self.ids[p] for p in parts if p]

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging a's and b's characters by themselves would leave them as a, b."""
        ok = np.ones(len(a), dtype=bool)
        at, x, y = np.arange(len(a)), a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        back = powers(BASE, self.longest + 1)
        while len(at):
            both = self.find(self.hashes[x] + self.hashes[y] * back[self.length[x]])
            due = (both >= 0) & (self.rank[both] < limit)
            ok[at[due]] = False
            rx, ry = self.rank[x], self.rank[y]
            # Undo the later merge; of the same merge on both sides the left one came first.
            undo_x = rx > ry
            end = due | ((rx < 0) & (ry < 0))
            limit = np.where(undo_x, rx, ry + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            go = ~end & (x >= 0) & (y >= 0)
            at, x, y, limit = at[go], x[go], y[go], limit[go]
        return ok


class Encoder:
    """Encodes batches of texts in a task."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.memory = pieces, Memory(REMEMBERED)
        # Answers of may_follow, each at one place that its pair's hash gives; a later pair takes the place over.
        self.pairs, self.fits = np.full(1 << 21, -1, dtype=np.int64), np.zeros(1 << 21, dtype=bool)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a.astype(np.int64) << 32 | b
        place = ((a.astype(np.uint64) * BASE + b.astype(np.uint64)) * BASE >> np.uint64(43)).astype(np.int64)
        out = self.fits[place]
        new = np.flatnonzero(self.pairs[place] != pair)
        if len(new):
            out[new] = self.pieces.may_follow(a[new], b[new])
            self.pairs[place[new]], self.fits[place[new]] = pair[new], out[new]
        return out

    def viterbi(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of equally long units (units x characters): flat ids and how many each unit has."""
        p, (n, length) = self.pieces, cps.shape
        sums = np.zeros((length + 1, n), dtype=np.uint64)
        np.cumsum(letters(cps.T) * powers(BASE, length)[:, None], axis=0, dtype=np.uint64, out=sums[1:])
        back = powers(BACK, length + 1)
        last = np.full((length + 1, n), _NONE, dtype=np.int32)
        for end in range(1, length + 1):
            first = max(0, end - p.longest)
            spans = (sums[end] - sums[first:end]) * back[first:end, None]
            found = p.find(spans.ravel()).reshape(spans.shape)
            # The longest piece that may follow is the maximum, so the search goes from long to short.
            for start in range(first, end):
                some = np.flatnonzero((found[start - first] >= 0) & (last[end] < 0))
                if start and len(some):
                    before = last[start, some]
                    fits = before >= 0
                    fits[fits] = self.may_follow(before[fits], found[start - first, some[fits]])
                    some = some[fits]
                last[end, some] = found[start - first, some]
        # Follow the backpointers from the end.
        out, at, who = [], np.full(n, length), np.arange(n)
        while len(who):
            ids = last[at[who], who]
            if (ids < 0).any():
                raise ValueError("a unit without a segmentation")
            out.append((who, ids))
            at[who] -= p.length[ids]
            who = who[at[who] > 0]
        owner = np.concatenate([w for w, _ in reversed(out)])
        ids = np.concatenate([i for _, i in reversed(out)])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=n)

    def viterbi_one(self, cps: np.ndarray) -> np.ndarray:
        """Pieces of one unit of any length, in memory and time that grow with it."""
        p, n = self.pieces, len(cps)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(letters(cps) * powers(BASE, n), dtype=np.uint64, out=sums[1:])
        back = powers(BACK, n + 1)
        ends, ids = [], []
        for length in range(min(p.longest, n), 0, -1):
            found = p.find((sums[length:] - sums[:-length]) * back[: n - length + 1])
            at = np.flatnonzero(found >= 0)
            ends.append(at + length)
            ids.append(found[at])
        ends, ids = np.concatenate(ends), np.concatenate(ids)
        # By end, the longest piece first.
        order = np.argsort(ends, kind="stable")
        ends, ids = ends[order], ids[order]
        last = [int(_NONE)] * (n + 1)
        fits: dict[tuple[int, int], bool] = {}
        for end, piece, start in zip(ends.tolist(), ids.tolist(), (ends - p.length[ids]).tolist()):
            if last[end] >= 0:
                continue
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before, piece
                if pair not in fits:
                    fits[pair] = bool(self.may_follow(np.array([before], np.int32), np.array([piece], np.int32))[0])
                if not fits[pair]:
                    continue
            last[end] = piece
        out, at = [], n
        while at:
            if last[at] < 0:
                raise ValueError("a unit without a segmentation")
            out.append(last[at])
            at -= int(p.length[last[at]])
        return np.array(out[::-1], dtype=np.int32)

    def _learn(self, units: Units, new: np.ndarray, known: np.ndarray) -> None:
        p, cps = self.pieces, units.cps
        starts, lengths = units.starts[new], units.lengths[new]
        ids, sizes, numbers = [], [], []
        first_two = (lengths > 1) & (cps[starts] == ord(BLANK))
        first_two[first_two] = cps[starts[first_two] + 1] == ord(BLANK)
        runs = first_two & known[starts]
        plain = (lengths <= LONGEST) & ~first_two & known[starts]
        for length in np.unique(lengths[plain]):
            who = np.flatnonzero(plain & (lengths == length))
            flat, n = self.viterbi(cps[starts[who, None] + np.arange(length)])
            ids.append(flat)
            sizes.append(n)
            numbers.append(new[who])
        for k, run in zip(new[~plain], runs[~plain]):
            unit = units.text(k)
            if run:
                one = np.array(p.merge(unit), dtype=np.int32)
            elif known[units.starts[k]]:
                one = self.viterbi_one(code_points(unit))
            else:
                one = p.bytes_ids[np.frombuffer(unit.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
            ids.append(one)
            sizes.append(np.array([len(one)]))
            numbers.append(np.array([k]))
        self.memory.add(units, np.concatenate(numbers), np.concatenate(ids), np.concatenate(sizes))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        return [ids for part in in_parts(texts, BATCH_CHARS) for ids in self._encode([t or "" for t in part])]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        p = self.pieces
        full = [BLANK + t.replace(" ", BLANK) if t else "" for t in texts]
        cps = code_points("".join(full))
        if not len(cps):
            return [np.zeros(0, dtype=np.int32) for _ in texts]
        ends = np.cumsum([len(t) for t in full])
        known = p.char_id[cps] >= 0
        blank = cps == ord(BLANK)
        cut = np.zeros(len(cps), dtype=bool)
        cut[1:] = ~known[1:] | ~known[:-1] | (blank[1:] & ~blank[:-1])
        cut[np.append(0, ends[:-1])[np.array([len(t) > 0 for t in full])]] = True
        starts = np.flatnonzero(cut)
        units = Units(cps, starts)
        new = self.memory.missing(units)
        if len(new):
            self._learn(units, new, known)
        return split_by_text(*self.memory.gather(units), starts, ends)


_encoder: Encoder | None = None


def encoder_of(pieces: Pieces) -> Encoder:
    """The worker's encoder, which remembers units from one task to the next."""
    global _encoder
    if _encoder is None or _encoder.pieces is not pieces:
        _encoder = Encoder(pieces)
    return _encoder


def decode(pieces: Pieces, ids: np.ndarray | list[int]) -> str:
    spelled = b"".join(map(pieces.spelled.__getitem__, ids)).decode("utf-8", "replace").replace(BLANK, " ")
    return spelled[1:] if spelled.startswith(" ") else spelled


def encoded(path: str, text: Column) -> Column:
    """struct<ids array<int>, exact>: the pieces of each text, and whether they read back as the text."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(Pieces(path))

    @F.pandas_udf("ids array<int>, exact boolean")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(shared.value)
        for texts in batches:
            for part in in_parts(texts.to_list(), BATCH_CHARS):
                ids = encoder(part)
                exact = [decode(encoder.pieces, i.tolist()) == (t or "") for i, t in zip(ids, part)]
                yield pd.DataFrame({"ids": ids, "exact": exact})

    return encode.asNondeterministic()(text)


def decoded(path: str, ids: Column) -> Column:
    """The texts of arrays of ids; null reads as empty."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(Pieces(path))

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([decode(shared.value, [] if r is None else r) for r in rows], dtype="object")

    return read(ids)
