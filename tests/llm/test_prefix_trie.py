"""The prefix trie against a dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pixelseek.llm import prefix_trie
from pixelseek.llm.prefix_trie import conversations_of, ends_hashes, grafted
from tests.llm.helpers import clash

ROWS = "conv_id long, turn long, role string, text string"


def lists(rows):
    """conv_id to its turns in order; here no two rows of a conversation have the same turn but equal ones."""
    told = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            told[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(ts)] for c, ts in told.items()}


def rebuilt(told):
    out = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = told.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)

    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(cs) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (
            min(cs),
            len(node),
            min(members[node[:-1]]) if node else None,
            len(cs),
            len(kids[node]),
            leaves[node],
            saved[node],
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, cs in members.items()
    )


def found(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert tuple(df.columns) == columns
    return sorted(map(tuple, df.collect()))


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(4)


def chats(seed, n):
    """Conversations of few different turns, long ones, and a third that are the same."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(5 * n), n):
        if c % 3 == 0:
            turns = [("user", "same"), ("assistant", "answer" * 3), ("user", "end")]
        else:
            turns = [(rng.choice("ua"), rng.choice(["x", "yy", "é", "", None])) for _ in range(rng.choice([1, 2, 4, 9]))]
            turns += [("user", f"own {c}")] * rng.choice([0, 0, 1, 3])
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(7, i, "user", f"{i}") for i in range(300)] if 7 not in {r[0] for r in rows} else []
    return rows


@pytest.mark.parametrize("width", [1 << 22, 4])
def test_against_a_dictionary(spark, width):
    rows = chats(1, 250)
    told = conversations_of(table(spark, rows))
    assert found(prefix_trie.prefix_trie(grafted(told), max_width=width)) == brute(rebuilt(lists(rows)))
    assert found(prefix_trie.prefix_trie(told, max_width=width)) == brute(lists(rows))


def test_frequent_parents_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_HOT", 1)
    monkeypatch.setattr(prefix_trie, "MAX_HOT", 50)
    rows = chats(2, 200)
    assert found(prefix_trie.prefix_trie(conversations_of(table(spark, rows)))) == brute(lists(rows))


def test_the_sketch_proves_most_tails(spark):
    rows = [(c, i, "user", f"{c}-{i}" if i else "hi") for c in range(300) for i in range(4)]
    digests = F.transform("turns", lambda t: t["digest"])
    keys = conversations_of(table(spark, rows)).select("conv_id", prefix_trie._chained(digests).alias("keys"))
    counts = prefix_trie.sketch(keys)
    shared = [r[0] for r in keys.select(prefix_trie._screen(counts, spark)).collect()]
    assert min(shared) == 1 and sum(s == 1 for s in shared) > 290
    assert counts.max() == 2


def test_lists_of_ends_in_pieces(spark):
    """A list in many pieces, whose hash must run over batches, and negative ids."""
    ids = list(range(-700, 3000, 7))
    ends = spark.createDataFrame([(b"a", i) for i in ids] + [(b"b", 5)], "key binary, conv_id long").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = {bytes(r[0]): r[1] for r in ends_hashes(ends).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {
        b"a": hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        b"b": hashlib.sha256(b"5").hexdigest(),
    }


def test_defined_cases(spark):
    rows = [
        (0, 0, "u", "a"), (0, None, "u", "first"), (0, 0, "u", "a"), (0, 1, None, None),
        (1, 0, "", ""), (101, 5, "u", "a" * 100_000), (None, 0, "u", "lost"), (None, 1, "u", "lost"),
        (200, 0, "u", "😀"), (201, 0, "ab", "c"), (202, 0, "a", "bc"),
    ]
    df = clash(table(spark, rows), F).withColumn("depth", F.lit("own"))
    assert found(prefix_trie.prefix_trie(conversations_of(df))) == brute(lists(rows))
    assert found(prefix_trie.prefix_trie(grafted(conversations_of(df)))) == brute(rebuilt(lists(rows)))
    none = spark.createDataFrame([], ROWS)
    assert found(prefix_trie.prefix_trie(grafted(conversations_of(none)))) == []


def test_turnless_conversations(spark):
    """All turns of 4 (crc32 % 6 > 1) are cut, and 0 is absent: it ends at the root."""
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(c, 0, "u", "only")]
    got = found(prefix_trie.prefix_trie(grafted(conversations_of(table(spark, rows)))))
    assert got == brute(rebuilt(lists(rows))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
