from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from pixelseek.llm import exact_dedup
from tests.llm.helpers import clash, docs, rows


def brute(table):
    groups = defaultdict(list)
    for i, t, *_ in table:
        groups[t or ""].append(i)
    out = []
    for i, t, *_ in table:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def test_groups(spark, checkpoint_dir):
    table = [(i, f"text {i % 7}", "en", "s") for i in range(40)]
    table += [(100, None, None, None), (101, "", "en", "s"), (None, "text 1", "en", "s"), (None, "alone", "en", "s")]
    table += [(200, "x" * 200_000, "en", "s"), (200, "x" * 200_000, "en", "s"), (201, "Text 1", "en", "s")]
    assert rows(exact_dedup.duplicate_groups(docs(spark, table)), *COLUMNS) == brute(table)


def test_frequent_text_is_decided_by_broadcast(spark, checkpoint_dir, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FREQUENT", 5)
    table = [(i, "hot" if i % 3 else f"t{i // 6}", "en", "s") for i in range(200)]
    d = docs(spark, table)
    winners = exact_dedup.frequent_digests(exact_dedup._digests(d)).collect()
    assert [w["group_size"] for w in winners] == [sum(t == "hot" for _, t, *_ in table)]
    assert rows(exact_dedup.duplicate_groups(d), *COLUMNS) == brute(table)
    kept = rows(exact_dedup.drop_duplicates(d), "doc_id")
    assert kept == sorted(((i,) for i, _, _, k, _ in brute(table) if k), key=repr)


def test_drop_keeps_one_row_and_all_columns(spark, checkpoint_dir):
    table = [(1, "a", "en", "s"), (1, "a", "en", "s"), (2, "a", None, "t"), (2, "a", None, "t"), (3, None, "en", "s")]
    table += [(4, "", "en", "s"), (None, "a", "en", "s"), (None, "b", "en", "s")]
    d = clash(docs(spark, table), F)
    kept = exact_dedup.drop_duplicates(d)
    assert kept.columns == d.columns
    assert rows(kept, "doc_id", "text") == sorted([(2, "a"), (4, ""), (None, "b")], key=repr)


def test_empty(spark, checkpoint_dir):
    assert exact_dedup.duplicate_groups(docs(spark, [])).count() == 0
    assert exact_dedup.drop_duplicates(docs(spark, [])).count() == 0
