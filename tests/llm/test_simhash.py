from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pixelseek.llm import simhash as s
from pixelseek.llm.components import components
from tests.llm.helpers import clash, docs, rows


def brute_fingerprint(text):
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower)
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, distance=3):
    """The smallest place reachable, for each place."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def planted(n=220, seed=3):
    """Chains and stars of fingerprints that differ in few bits, and lone ones."""
    rng = random.Random(seed)
    out = [0]
    while len(out) < n:
        near = rng.choice(out) if rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            near ^= 1 << b
        out.append(near)
    return out


@pytest.mark.parametrize(
    "text", [None, "", " \t\n", "One", "one two", "A b C d é\x0b日本 Z z a", "x " * 70_000 + "y", "a b c d e f " * 9]
)
def test_fingerprint(text):
    assert s.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("distance,parts,block", [(3, 4, 4096), (3, 4, 3), (3, 3, 4096), (3, 2, 8), (2, 3, 4096), (1, 2, 5)])
def test_links_join_all_near_fingerprints(spark, checkpoint_dir, distance, parts, block):
    fps = sorted(set(planted()))
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long").repartition(3)
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in s.near_links(table, distance, parts, block).collect()]
    assert all(0 < (a ^ b).bit_count() <= distance for a, b in links)
    place = {x: i for i, x in enumerate(fps)}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[place[a]], label[place[b]])
            for x in (a, b):
                if label[place[x]] != low:
                    label[place[x]], changed = low, True
    assert label == brute_groups(fps, distance)


def test_allocation_adds_up_and_skips_crowded_partitions():
    candidates = np.zeros((4, 3, 2))
    candidates[:, 1, :], candidates[:, 2, :] = 10.0, 100.0
    candidates[2, 1, 1], candidates[2, 2, 1] = 1e6, 1e6
    probes = np.array([[0.0, 1.0, 17.0]] * 4)
    t = s.allocate(candidates, probes, 3)
    assert (t.sum(axis=0) == 0).all()
    assert t[:, 0].tolist() == [0, 0, 0, 0] and t[2, 1] == -1 and sorted(t[:, 1].tolist()) == [-1, 0, 0, 1]


def test_groups(spark, checkpoint_dir):
    base = " ".join(f"word{i}" for i in range(400))
    table = [(i, base + f" tail{i % 4}", "en", "s") for i in range(10, 30)]
    table += [(5, None, None, None), (3, "", "en", "s"), (4, " \n", "en", "s"), (70, "one", "en", "s"), (70, "one", "en", "s")]
    table += [(None, "quite another text here", "en", "s"), (90, base.upper() + " tail1", "en", "s")]
    got = s.near_groups(clash(docs(spark, table), F)).collect()
    fps = [s.fingerprint(t) for _, t, *_ in table]
    label = brute_groups(fps)
    least = {}
    for (i, *_), k in zip(table, label):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = sorted(((i, f, least.get(k)) for (i, *_), f, k in zip(table, fps, label)), key=repr)
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=repr) == want


def test_drop(spark, checkpoint_dir):
    table = [(2, "a b c d", "en", "s"), (1, "A b c d", "en", "s"), (1, "A b c d", "en", "s"), (3, None, "en", "s")]
    table += [(9, "", "en", "s"), (None, "all on its own", "en", "s"), (None, "and one more of them", "en", "s")]
    table += [(None, "a b c d", "en", "s"), (1, "another text of the same id", "en", "s")]
    d = clash(docs(spark, table), F)
    kept = s.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert rows(kept, "doc_id", "text") == sorted(
        [(1, "A b c d"), (3, None), (None, "all on its own"), (None, "and one more of them"), (1, "another text of the same id")],
        key=repr,
    )


def test_empty(spark, checkpoint_dir):
    assert s.near_groups(docs(spark, [])).count() == 0
    assert s.drop_near_duplicates(docs(spark, [])).count() == 0


def test_components(spark, checkpoint_dir):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, k) for k in range(1, 40)] + [(7, 7), (None, 3)]
    edges += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(1, 0)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in root}
