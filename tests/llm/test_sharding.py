from __future__ import annotations

import zlib
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pixelseek.llm import queries, sharding
from pixelseek.llm.common import shared_folder
from tests.llm.helpers import clash, docs, rows


def table(n=300):
    return [(i, f"t{i}", "en", None if i % 10 == 9 else "big" if i % 3 else f"s{i % 5}") for i in range(n)]


@pytest.mark.parametrize("limits", [{}, {"bucket_rows": 7, "max_offsets": 0}])
def test_mixture_counts_and_slots(spark, checkpoint_dir, limits):
    t = table()
    got = sharding.interleave(docs(spark, t), 8, **limits).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(t)))
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(8))
    whole = Counter(s for *_, s in t)
    for shard in range(8):
        mine = [r for r in got if r["shard"] == shard]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        for source, n in Counter(r["source"] for r in mine).items():
            assert abs(n - whole[source] / 8) <= 1.01


def test_buckets_change_nothing_but_the_work(spark, checkpoint_dir):
    d = docs(spark, table())
    a = rows(sharding.interleave(d, 4), "doc_id", "shard", "slot")
    assert a == rows(sharding.interleave(d, 4, bucket_rows=20_000), "doc_id", "shard", "slot")
    assert a != rows(sharding.interleave(d, 4, seed=1), "doc_id", "shard", "slot")


@pytest.mark.parametrize("limits", [{}, {"bucket_rows": 7, "max_offsets": 0, "rows_per_file": 3}])
def test_order_in_plain_python(spark, checkpoint_dir, limits):
    """Ranks in each source by hash, fractions over all, equal cuts; rows repeated across several shards and files."""
    t = table(90) + [(7, "again", "en", "big")] * 40 + [(1, "twice", "en", "s1")] * 2
    d = docs(spark, t)
    h = F.shiftrightunsigned(F.xxhash64(F.lit(0), F.col("doc_id").cast("string")), 1)
    keyed = d.select(*d.columns, h.alias("h"), F.xxhash64(*d.columns).alias("tie")).collect()
    by_source = {}
    for r in sorted(keyed, key=lambda r: (r["h"], r["tie"])):
        by_source.setdefault("null" if r["source"] is None else "s" + r["source"], []).append(r)
    order = sorted(
        ((2 * i + 1) / (2 * len(rs)), source, i, r["doc_id"], r["text"]) for source, rs in by_source.items() for i, r in enumerate(rs)
    )
    starts = [-(-s * len(t) // 8) for s in range(9)]
    want = [
        (*order[at][3:], s, at - starts[s]) for s in range(8) for at in range(starts[s], starts[s + 1])
    ]
    got = sharding.interleave(d, 8, **limits)
    assert rows(got, "doc_id", "text", "shard", "slot") == sorted(want, key=repr)


def test_texts_are_shuffled_once(spark, checkpoint_dir):
    plan = sharding.interleave(docs(spark, table()), 8)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "shard" in exchanges[0]


def test_awkward_rows(spark, checkpoint_dir):
    t = [(1, "a", "en", "s")] * 3 + [(None, None, None, None), (2, "", "en", "s"), (1, "b", "en", "null")]
    d = clash(docs(spark, t), F)
    got = sharding.interleave(d, 8)
    assert got.count() == len(t) and set(got.columns) == set(d.columns) | {"shard", "slot"}
    assert got.filter("slot <> 0").count() == 0
    assert sharding.interleave(docs(spark, []), 8).count() == 0


def test_written_shards(spark, checkpoint_dir, tmp_path):
    d = docs(spark, table(50))
    sharding.write_shards(sharding.interleave(d, 4), str(tmp_path / "out"), rows_per_file=5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows(back, "doc_id", "text", "source") == rows(d, "doc_id", "text", "source")
    assert len(list((tmp_path / "out" / "shard=0").glob("*.parquet"))) >= 3


@pytest.mark.parametrize("t", [table(60) + [(None, None, None, None), (3, "t3", "en", "s")], []])
def test_query_writes_the_documents(spark, checkpoint_dir, tmp_path, t):
    docs(spark, t).write.parquet(str(tmp_path / "documents.parquet"))
    parent = Path(shared_folder(spark).removeprefix("file:")) / "pixelseek"
    before = set(parent.glob("shards-*"))
    got = queries.op8(spark, str(tmp_path))
    (folder,) = set(parent.glob("shards-*")) - before
    told = "doc_id long, text string, lang string, source string, shard int, slot long"
    written = spark.read.schema(told).parquet(str(folder))
    assert rows(written, "doc_id", "text", "lang", "source") == sorted(t, key=repr)
    digests = sorted(((i, len(x or "") + 1, zlib.crc32((x or "").encode())) for i, x, *_ in t), key=repr)
    assert rows(got, "doc_id", "size", "text_crc32") == digests
    assert rows(got, "doc_id", "shard", "slot") == rows(written, "doc_id", "shard", "slot")
