"""The prefix trie of conversations.

A conversation is its list of turns (role, text); each distinct sequence of first d turns is a node of depth d below the
textless root. Texts are read once and never shuffled: a turn becomes a digest and a length, a prefix the chained
digest of its turns (the first 128 bits of SHA-256, which two prefixes share by chance about once in 10^18 pairs of a
table of 10^10).

A count-min sketch of all prefix digests screens them: where the least of a digest's cells says one, no other
conversation has that prefix, nor any longer one. From there on a conversation is a tail of nodes of its own that are
emitted where they are. Only the prefixes before it, possibly shared, are exploded and grouped exactly; those that turn
out to be single are right all the same. The sketch has ``ROWS`` rows of cells that stop counting at two, twice as many
cells a row as prefixes, at most ``max_width`` (so at most 4 MB a row are added up in tasks, fetched and sent out).
Beyond that size of table it proves fewer tails; results do not depend on it.

Sums over a node's subtree do not climb the trie level by level: each node is owned by its smallest member, whose own
path below any ancestor says what it adds there. A node that is the parent of very many is looked up by a broadcast of
such nodes, whose number is bounded by the share of rows that makes them so; lists of the conversations that end at a
node are hashed as a stream of pieces of ``PIECE`` ids, so no list of a frequent conversation is held in memory.

Defined cases: rows of null conv_id belong to no conversation and are left out; turns are ordered by turn (null first),
equal ones by the digest of role and text; null role or text counts as empty; repeated rows are repeated turns; a
conversation is one row and must fit into a task; without any conversation there is no node, not even a root; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelseek.llm.common import stored

ROWS = 4
MIN_WIDTH, MAX_WIDTH = 1 << 12, 1 << 22
#: Cells in one row of a task's sketch.
BLOCK = 1 << 16
DIGEST_BYTES = 16
#: Conversation ids in one piece of the list of those that end at a node.
PIECE = 512
#: A parent of more nodes than this share of all is broadcast; so there are at most so many of them.
MAX_HOT = 50_000
LEAST_HOT = 100
ROOT = hashlib.sha256(b"").digest()[:DIGEST_BYTES]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest, chars>>) of a table (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    # The length of the role in front keeps (a, bc) and (ab, c) apart.
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, DIGEST_BYTES)
    turns = rows.filter("conv_id is not null").select(
        "conv_id", F.struct("turn", digest.alias("digest"), F.length(text).alias("chars")).alias("at")
    )
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["chars"])).alias("turns"))


def grafted(convs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % block, h = crc32(c) % most.

    All of that conversation's turns where it has fewer, none where it is absent; c's own turns follow after its first
    h. One head has at most ``block`` conversations and is cut to ``most`` - 1 turns before it is joined."""
    head = convs.filter(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = convs.withColumn("h", h).join(head, F.col("conv_id") - F.col("conv_id") % block == F.col("base"), "left")
    own = F.slice(F.col("turns"), F.col("h") + 1, F.size("turns"))
    lent = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(lent, own).alias("turns"))


def _prefixes(digests) -> list[bytes]:
    out, last = [], ROOT
    for d in digests:
        last = hashlib.sha256(last + d).digest()[:DIGEST_BYTES]
        out.append(last)
    return out


def _chained(digests: Column) -> Column:
    @F.pandas_udf("array<binary>")
    def chained(rows: pd.Series) -> pd.Series:
        return rows.map(_prefixes)

    return chained(digests)


def _cells(keys: np.ndarray, width: int) -> np.ndarray:
    """(rows, keys) cell numbers, from the two halves of each digest; width is a power of two."""
    halves = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2)
    step = halves[:, 1] | np.uint64(1)
    rows = np.arange(1, ROWS + 1, dtype=np.uint64)[:, None]
    return ((halves[:, 0] + rows * step) >> np.uint64(20)) & np.uint64(width - 1)


def _sketch_of_task(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((ROWS, width), dtype=np.uint8)
        for batch in batches:
            keys = [k for ks in batch["keys"] for k in ks]
            if not keys:
                continue
            for row, cells in zip(table, _cells(keys, width)):
                cell, times = np.unique(cells, return_counts=True)
                row[cell] = np.minimum(row[cell] + np.minimum(times, 2), 2)
        for r in range(ROWS):
            for start in range(0, width, BLOCK):
                part = table[r, start : start + BLOCK]
                if part.any():
                    yield pd.DataFrame({"place": [r * width + start], "cells": [part.tobytes()]})

    return run


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for place, cells in zip(batch["place"], batch["cells"]):
            part = np.frombuffer(cells, dtype=np.uint8)
            total[place] = np.minimum(total[place] + part, 2) if place in total else part
    for place, part in total.items():
        yield pd.DataFrame({"place": [place], "cells": [part.tobytes()]})


def sketch(convs: DataFrame, max_width: int = MAX_WIDTH) -> np.ndarray:
    """Saturated counts (rows, width) of all prefix digests of a table with ``keys``."""
    n = convs.agg(F.sum(F.size("keys"))).first()[0] or 0
    width = min(max_width, max(MIN_WIDTH, 1 << (2 * n - 1).bit_length() if n else 0))
    parts = convs.select("keys").mapInPandas(_sketch_of_task(width), "place long, cells binary")
    whole = parts.repartition("place").mapInPandas(_merged, "place long, cells binary")
    table = np.zeros(ROWS * width, dtype=np.uint8)
    for r in whole.toLocalIterator():
        table[r["place"] : r["place"] + len(r["cells"])] = np.frombuffer(r["cells"], dtype=np.uint8)
    return table.reshape(ROWS, width)


def _screen(table: np.ndarray, spark: SparkSession) -> Column:
    """Leading prefixes of ``keys`` that the sketch does not prove to be single."""
    shipped = spark.sparkContext.broadcast(table)

    @F.pandas_udf("int")
    def shared(keys: pd.Series) -> pd.Series:
        counts = shipped.value
        sizes = keys.map(len).to_numpy()
        flat = [k for ks in keys for k in ks]
        if not flat:
            return pd.Series(np.zeros(len(keys), dtype=np.int32))
        cells = _cells(flat, counts.shape[1])
        single = np.min([row[c] for row, c in zip(counts, cells)], axis=0) < 2
        ends = np.cumsum(sizes)
        # The first single prefix at or after each start, or the end.
        found = np.append(np.flatnonzero(single), len(flat))
        starts = ends - sizes
        first = found[np.searchsorted(found, starts)]
        return pd.Series(np.minimum(first, ends) - starts).astype(np.int32)

    return shared(F.col("keys"))


def _ends_hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces sorted by (key, piece) to one hash per key, across batches."""
    key, state = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch["key"], batch["ids"]):
            if k != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if state:
        yield pd.DataFrame([(key, state.hexdigest())], columns=["key", "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the hash of the ascending, comma-joined conv_ids of each key of (key, conv_id)."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    # Distinct ids: no more than PIECE of them are in a piece.
    piece = F.floor(F.col("conv_id") / PIECE).alias("piece")
    pieces = ends.groupBy("key", piece).agg(ids.alias("ids"))
    ordered = pieces.repartition("key").sortWithinPartitions("key", "piece")
    return ordered.mapInPandas(_ends_hash, "key binary, ends_sha256 string")


def _parents_of(lookups: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lookups`` (conv_id, top, key) with ``parent_conv_id``, the owner of the node ``key``.

    Nodes asked for by very many rows are broadcast, so no task gets all the rows of one key."""
    asked = nodes.select("key", F.col("rep").alias("parent_conv_id"), "n_children")
    n = nodes.agg(F.sum("n_children")).first()[0] or 0
    least = max(LEAST_HOT, n // MAX_HOT)
    hot = asked.filter(F.col("n_children") > least).drop("n_children")
    cold = asked.filter(F.col("n_children") <= least).drop("n_children")
    near = lookups.join(F.broadcast(hot), "key", "left")
    found = near.filter("parent_conv_id is not null")
    rest = near.filter("parent_conv_id is null").drop("parent_conv_id").join(cold, "key")
    return found.unionByName(rest).select("conv_id", "top", "parent_conv_id")


def prefix_trie(convs: DataFrame, max_width: int = MAX_WIDTH) -> DataFrame:
    """One row per node of conversations (conv_id, turns array<struct<digest, chars>>), conv_id distinct and not null.

    (conv_id smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); the
    root's depth is 0. saved_tokens sums over the subtree, the node included, (n_convs - 1) times the characters of the
    last turn."""
    spark = convs.sparkSession
    digests = F.transform("turns", lambda t: t["digest"])
    chained = convs.select("conv_id", _chained(digests).alias("keys"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    chained = stored(chained, "prefixes")
    table = sketch(chained, max_width)
    convs = stored(chained.withColumn("shared", _screen(table, spark)), "screened")
    depth = F.size("keys")

    path = F.transform(
        F.sequence(F.lit(0), F.col("shared")),
        lambda d: F.struct(
            d.alias("depth"),
            F.coalesce(F.get("keys", d - 1), F.lit(ROOT)).alias("key"),
            F.when(d > 0, F.coalesce(F.get("keys", d - 2), F.lit(ROOT))).alias("parent"),
            F.coalesce(F.get("chars", d - 1), F.lit(0)).alias("chars"),
            (d == depth).alias("ends"),
            ((d == F.col("shared")) & (d < depth)).alias("tail"),
        ),
    )
    members = convs.select("conv_id", F.explode(path).alias("at")).select("conv_id", "at.*")
    # Depth, parent and last text are the same in all members of a node.
    grouped = stored(
        members.groupBy("key", "parent", "depth", "chars").agg(
            F.min("conv_id").alias("rep"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(F.col("tail").cast("long")).alias("tails"),
        ),
        "grouped",
    )
    below = grouped.filter("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("below"))
    children = F.col("tails") + F.coalesce("below", F.lit(0))
    own = grouped.join(below, "key", "left").withColumn("n_children", children)
    own = stored(
        own.select(
            "key",
            "rep",
            "depth",
            "n_convs",
            "n_children",
            # Every tail has one leaf; it counts at the node that it hangs from.
            (F.col("tails") + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
            ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        ),
        "nodes",
    )

    # The nodes of one owner are the lower end of its path: what hangs below each, by a running sum from the deepest.
    down = Window.partitionBy("rep").orderBy(F.desc("depth"))
    under = own.select("key", *[F.sum(c).over(down).alias(c) for c in ("leaves", "saved")])
    tops = own.groupBy(F.col("rep").alias("conv_id")).agg(
        F.min("depth").alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
    )
    # Above its topmost node an owner adds all that it owns.
    above = convs.join(tops.filter("top > 0"), "conv_id").select(
        F.explode(F.concat(F.array(F.lit(ROOT)), F.slice("keys", F.lit(1), F.col("top") - 1))).alias("key"), "leaves", "saved"
    )
    totals = under.unionByName(above).groupBy("key").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    ends = ends_hashes(members.filter("ends").select("key", "conv_id"))

    # Each conversation asks for one parent that it does not own: that of the topmost node of its own.
    topped = convs.join(tops.select("conv_id", "top"), "conv_id", "left").withColumn(
        "top", F.coalesce("top", F.col("shared") + 1)
    )
    lookups = topped.filter((F.col("top") > 0) & (F.col("top") <= depth)).select(
        "conv_id", "top", F.coalesce(F.get("keys", F.col("top") - 2), F.lit(ROOT)).alias("key")
    )
    parents = stored(_parents_of(lookups, own), "parents")

    shared = (
        own.join(totals, "key")
        .join(ends, "key", "left")
        .join(parents, (F.col("rep") == parents["conv_id"]) & (F.col("depth") == parents["top"]), "left")
        .select(
            F.col("rep").alias("conv_id"),
            F.col("depth").cast("long").alias("depth"),
            F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "rep")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
    )
    tails = (
        convs.filter(F.col("shared") < depth)
        .select("conv_id", depth.alias("size"), F.explode(F.sequence(F.col("shared") + 1, depth)).alias("depth"))
        .join(parents, "conv_id", "left")
    )
    last = F.col("depth") == F.col("size")
    tails = tails.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return shared.unionByName(tails)
