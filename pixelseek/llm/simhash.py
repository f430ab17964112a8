"""SimHash near-duplicates, searched by the generalised pigeonhole principle.

Fingerprints. A text's A-Z are lower-cased, its words are the runs of bytes other than ASCII white space, its shingles
are ``words`` successive words joined by one space. A bit of the 64-bit fingerprint is 1 if it is set in more than half
of the shingles' XXH64 values (seed 42). Two fingerprints link at ``distance`` differing bits or fewer.

Search. The 64 bits are cut into partitions of correlated bits: strongly correlated bits say little more together than
one of them, so gathering them leaves the other partitions selective. For thresholds t_i with sum(t_i) = distance - m + 1
over m partitions, any fingerprint within the distance of q is within t_i of q in some partition i (t_i = -1: partition
not used). Each fingerprint gets its own thresholds, by dynamic programming over the partitions on the candidate counts
that a histogram of partition values foretells: where a value is frequent, the partition is skipped and a selective one
is searched with a wider threshold instead. All equal fingerprints are one row before the search.

Probing. Rows of (partition, value) meet in cells: once as the ones searched, and once for each value that they probe.
Cells with more than ``BLOCK`` members are cut into pairs of blocks, so no task holds a whole cell. Within a cell, every
candidate is verified by its distance; what leaves the task is a spanning forest of the verified links, at most one row
for each member, never the pairs. Components over these links are found by alternating large-star and small-star steps.

Defined cases: null and empty texts, and texts of white space only, have fingerprint zero and link like any other; fewer
words than a shingle form one shingle of the whole sequence; rows that repeat an id are documents of their own; a null id
is larger than any other, so a component is named null only if it has no other; an empty table gives an empty table;
other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelseek.llm.common import stored
from pixelseek.llm.components import components

WORDS = 3
DISTANCE = 3
SEED = 42
#: Members of a cell that are compared in one piece.
BLOCK = 4096
#: Partition values are counted by so many of their bits, so the histogram has at most 4 x 65536 rows.
HISTOGRAM_BITS = 16

_CHUNK = 1 << 16
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    counts, n = np.zeros(64, dtype=np.int64), len(tokens) - words + 1
    for start in range(0, n, _CHUNK):
        part = tokens[start : start + _CHUNK + words - 1]
        joined = map(b" ".join, zip(*[part[k:] for k in range(words)]))
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in joined])
        # Digests are big-endian: bit 63 comes first.
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, h) of every row: the fingerprint as a signed 64-bit number, and a hash of the text."""

    @F.pandas_udf("long")
    def tell(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], dtype=np.uint64).astype(np.int64))

    return docs.select("doc_id", tell(F.col("text")).alias("fp"), F.xxhash64("text").alias("h"))


def bit_groups(fps: DataFrame, parts: int) -> list[np.ndarray]:
    """Bits of each partition, equal in number: greedily, the bits most correlated with those gathered so far."""

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, ones, both = 0, np.zeros(64), np.zeros((64, 64))
        for batch in batches:
            bits = _bits(batch["fp"].to_numpy().view(np.uint64)).astype(np.float64)
            n, ones, both = n + len(bits), ones + bits.sum(axis=0), both + bits.T @ bits
        yield pd.DataFrame({"v": [np.concatenate(([n], ones, both.ravel())).tolist()]})

    sums = (
        fps.mapInPandas(moments, "v array<double>").select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x"))
    ).collect()
    total = np.zeros(1 + 64 + 64 * 64)
    for i, x in sums:
        total[i] = x
    n = max(total[0], 1.0)
    mean = total[1:65] / n
    cov = total[65:].reshape(64, 64) / n - np.outer(mean, mean)
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    corr = np.abs(cov / np.outer(spread, spread))
    np.fill_diagonal(corr, 0.0)
    left, groups = list(range(64)), []
    for size in _widths(parts)[:-1]:
        group = [max(left, key=lambda b: corr[b, left].max())]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: corr[b, group].sum()))
            left.remove(group[-1])
        groups.append(np.array(sorted(group)))
    return [*groups, np.array(left)]


def _widths(parts: int) -> list[int]:
    return [64 // parts + (i < 64 % parts) for i in range(parts)]


def _bits(fps: np.ndarray) -> np.ndarray:
    return ((fps[:, None] >> _BITS[None, :]) & np.uint64(1)).astype(np.uint8)


def part_values(fps: np.ndarray, groups: list[np.ndarray]) -> np.ndarray:
    """Values of the partitions (parts x fingerprints): the group's bits, the first one lowest."""
    out = np.zeros((len(groups), len(fps)), dtype=np.int64)
    for i, group in enumerate(groups):
        for k, bit in enumerate(group):
            out[i] |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def _flips(width: int, radius: int) -> np.ndarray:
    """Masks of exactly ``radius`` bits."""
    masks = np.zeros(1, dtype=np.int64)
    for _ in range(radius):
        masks = np.unique((masks[:, None] ^ (1 << np.arange(width, dtype=np.int64))[None, :]).ravel())
    return masks[np.bitwise_count(masks) == radius]


def balls(histogram: np.ndarray, width: int, radius: int) -> np.ndarray:
    """Counts within 0 … radius bits of each histogram value ((radius + 1) x values)."""
    values = np.arange(len(histogram))
    bits = int(np.log2(len(histogram)))
    # Counts by fewer bits than the partition has are spread evenly over the rest.
    share = 2.0 ** (width - bits)
    rings = [sum(histogram[values ^ m] for m in _flips(bits, r)) / share for r in range(radius + 1)]
    return np.cumsum(rings, axis=0)


def allocate(candidates: np.ndarray, probes: np.ndarray, distance: int) -> np.ndarray:
    """Thresholds (parts x fingerprints) of least cost, by dynamic programming over the partitions.

    ``candidates[i, t + 1, q]``: expected candidates of q in partition i at threshold t (none at -1); ``probes[i, t + 1]``:
    values that threshold t probes. Thresholds add up to distance - parts + 1."""
    parts, levels, n = candidates.shape
    cost = candidates + probes[:, :, None]
    # Each threshold is one more than the level's place less two, so levels' places add up to distance + 1.
    goal = distance + 1
    best = np.full((goal + 1, n), np.inf)
    best[0] = 0
    back = np.zeros((parts, goal + 1, n), dtype=np.int8)
    for i in range(parts):
        after = np.full((goal + 1, n), np.inf)
        for t in range(levels):
            for s in range(goal + 1 - t):
                new = best[s] + cost[i, t]
                better = new < after[s + t]
                after[s + t][better] = new[better]
                back[i, s + t][better] = t
        best = after
    out = np.zeros((parts, n), dtype=np.int64)
    at = np.full(n, goal)
    for i in reversed(range(parts)):
        t = back[i, at, np.arange(n)]
        out[i] = t - 1
        at = at - t
    return out


def spanning_links(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph with edges a - b, by union-find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def _links(probing: np.ndarray, lying: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Verified links of the probing to the lying fingerprints, thinned to a forest block by block."""
    found_a, found_b = [], []
    step = max(1, (1 << 22) // max(1, len(lying)))
    for start in range(0, len(probing), step):
        part = probing[start : start + step]
        near = np.bitwise_count(part[:, None] ^ lying[None, :]) <= distance
        i, j = np.nonzero(near)
        other = part[i] != lying[j]
        if not other.any():
            continue
        forest = spanning_links(part[i][other], lying[j][other])
        found_a += [x for x, _ in forest]
        found_b += [y for _, y in forest]
    return spanning_links(np.array(found_a, dtype=np.uint64), np.array(found_b, dtype=np.uint64)) if found_a else []


def near_links(fps: DataFrame, distance: int = DISTANCE, parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints that join all those within ``distance`` of each other.

    ``fps`` (fp) holds distinct fingerprints."""
    n = fps.count()
    # More rows ask for wider, so fewer, partitions: a cell should hold few fingerprints by chance.
    parts = parts or (distance + 1 if n <= 1 << 26 else max(2, distance))
    groups = bit_groups(fps, parts)
    radius = distance - parts + 2 if parts <= distance else 1
    hist_bits = [min(HISTOGRAM_BITS, len(g)) for g in groups]

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = part_values(batch["fp"].to_numpy().view(np.uint64), groups)
            for i in range(parts):
                v, c = np.unique(values[i] & ((1 << hist_bits[i]) - 1), return_counts=True)
                yield pd.DataFrame({"part": np.int32(i), "v": v, "c": c})

    counted = fps.mapInPandas(histogram, "part int, v long, c long").groupBy("part", "v").agg(F.sum("c").alias("c"))
    hists = [np.zeros(1 << b) for b in hist_bits]
    got = counted.toPandas()
    for i in range(parts):
        mine = got[got["part"] == i]
        hists[i][mine["v"].to_numpy()] = mine["c"].to_numpy()
    ball = [balls(hists[i], len(g), radius).astype(np.float32) for i, g in enumerate(groups)]
    flips = [[_flips(len(g), r) for r in range(radius + 1)] for g in groups]
    probes = np.array([np.cumsum([0] + [len(x) for x in flips[i]]) for i in range(parts)], dtype=float)
    shared = fps.sparkSession.sparkContext.broadcast((groups, hist_bits, ball, flips, probes))

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, hist_bits, ball, flips, probes = shared.value
        for batch in batches:
            fp = batch["fp"].to_numpy()
            if not len(fp):
                continue
            values = part_values(fp.view(np.uint64), groups)
            low = [values[i] & ((1 << hist_bits[i]) - 1) for i in range(parts)]
            expected = np.stack([np.vstack([np.zeros(len(fp)), ball[i][:, low[i]]]) for i in range(parts)])
            thresholds = allocate(expected, probes, distance)
            for i in range(parts):
                for r in range(radius + 1):
                    who = np.flatnonzero(thresholds[i] >= r)
                    for mask in flips[i][r]:
                        v = values[i][who] ^ mask
                        # Cells without anyone, or with the prober alone, need no probe.
                        some = ball[i][0][v & ((1 << hist_bits[i]) - 1)] * 2.0 ** (len(groups[i]) - hist_bits[i])
                        at = some >= (2 if mask == 0 else 1)
                        if at.any():
                            yield pd.DataFrame({"part": np.int8(i), "v": v[at], "fp": fp[who][at], "probe": True})
                some = ball[i][0][low[i]] * 2.0 ** (len(groups[i]) - hist_bits[i])
                # Someone else may probe this cell by flipping bits, also where its owner is alone.
                yield pd.DataFrame({"part": np.int8(i), "v": values[i], "fp": fp, "probe": False, "n": some})

    def with_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A probe goes to every block of its cell, a searched one to its own block."""
        groups, hist_bits, ball, _, _ = shared.value
        for rows in cells(batches):
            i = int(rows["part"].iloc[0])
            many = ball[i][0][rows["v"].to_numpy() & ((1 << hist_bits[i]) - 1)] * 2.0 ** (len(groups[i]) - hist_bits[i])
            blocks = np.maximum(1, np.ceil(many / block)).astype(np.int64)
            if rows["probe"].iloc[0]:
                spread = rows.loc[rows.index.repeat(blocks)].copy()
                spread["block"] = np.concatenate([np.arange(b) for b in blocks])
                yield spread[["part", "v", "block", "fp", "probe"]]
            else:
                mix = rows["fp"].to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                rows["block"] = mix.astype(np.int64) % blocks
                yield rows[["part", "v", "block", "fp", "probe"]]

    dealt = fps.mapInPandas(with_blocks, "part byte, v long, block long, fp long, probe boolean")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by cell and block, the searched before those that probe; a cell may span batches."""
        key, lying, held = None, np.zeros(0, np.uint64), []

        def search(probing: np.ndarray, lying: np.ndarray) -> list[tuple[int, int]]:
            return _links(probing, lying, distance) if len(lying) and len(probing) else []

        def rows(links: list[tuple[int, int]]) -> pd.DataFrame:
            pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).astype(np.int64)
            return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

        for batch in batches:
            fp = batch["fp"].to_numpy().view(np.uint64)
            probe = batch["probe"].to_numpy()
            k = batch[["part", "v", "block"]].to_numpy()
            cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            links = []
            for s, e in zip(np.append(0, cuts), np.append(cuts, len(fp))):
                here = tuple(k[s])
                if here != key:
                    key, held = here, []
                mid = s + int((~probe[s:e]).sum())
                if mid > s:
                    held.append(fp[s:mid])
                if e > mid and held:
                    lying = held[0] if len(held) == 1 else np.concatenate(held)
                    held = [lying]
                    if e - mid > 1 or len(lying) > 1 or fp[mid] != lying[0]:
                        links += search(fp[mid:e], lying)
            if links:
                yield rows(links)

    return (
        dealt.repartition("part", "v", "block")
        .sortWithinPartitions("part", "v", "block", "probe")
        .mapInPandas(verify, "a long, b long")
        .distinct()
    )


def _rooted(docs: DataFrame, words: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, h) of every row, and (fp, first_id, root): root is the smallest fingerprint of the component."""
    fps = stored(fingerprints(docs, words), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    links = stored(near_links(nodes.select("fp"), distance), "links")
    # Fingerprint to the smallest fingerprint of its component; only those with links.
    label = components(links, "a", "b")
    named = nodes.join(label, nodes["fp"] == label["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    return fps, stored(named, "roots")


def near_groups(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest doc_id reachable."""
    fps, named = _rooted(docs, words, distance)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(least, "root").select("fp", "component_id")
    # A fingerprint with a third of all documents: its component travels to the documents where that table is small,
    # else Spark splits the skewed side of the join.
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row of each component stays, with its columns: that with the smallest doc_id, of equal ids by a text hash."""
    fps, named = _rooted(docs, words, distance)
    # Null ids come last; the minimum is combined before the shuffle, however many documents a component has.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "h")
    first = fps.groupBy("fp").agg(F.min(order).alias("first")).join(named, "fp").groupBy("root").agg(F.min("first").alias("first"))
    keep = stored(first.select(F.struct("first.id", "first.h").alias("_key")), "kept")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).alias("_key"),
    )
    # Rows that repeat id and text: one stays; the limit is applied before the shuffle too.
    one = Window.partitionBy("_key").orderBy(F.lit(0))
    kept = rows.join(keep, "_key", "left_semi").withColumn("_n", F.row_number().over(one))
    return kept.filter("_n = 1").select("row.*")
