from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from pixelseek.llm import queries
from pixelseek.llm.common import stored
from tests.llm.helpers import clash
from tests.llm.helpers import docs as make_docs

SF = "/root/testdata/sf0.001"


def test_stages(spark, checkpoint_dir):
    """Each stage's rows against plain rules on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stored(stage(spark, docs, SF), name)
        after = {r["doc_id"] for r in docs.collect()}
        assert docs.count() == len(after) and after <= set(before)
        if name == "pieces":
            assert after == set(before) and docs.filter("NOT exact").count() == 0
            continue
        assert docs.columns == columns
        gone = set(before) - after
        if name == "language_id":
            assert len(gone) <= 0.02 * len(before)
        elif name == "exact_dedup":
            last = {}
            for i, t in sorted(before.items()):
                last[t] = i
            assert after == set(last.values())
        elif name == "decontaminate":
            assert gone == {i for i, t in before.items() if any(x in t for x in items)}
        else:
            assert len(gone) <= 0.1 * len(before)


def test_run(spark, checkpoint_dir):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and got.filter("n_pieces <> size(ids)").count() == 0


def test_names():
    assert [int(n[2:].split("_")[0]) for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))


def test_awkward_rows(spark, checkpoint_dir, tmp_path):
    """Nulls, empty texts, repeated ids and rows, clashing column names, and an empty table."""
    told = "the cat and the dog walk to the house of the old man number {} with the {} of the year and go home again"
    full = [(i, told.format(i, "abcdefgh"[i % 8] * (i + 2)), "en", "s") for i in range(40)]
    odd = [(None, None, None, None), (100, "", "en", "s"), (101, "½ ①", "en", "s"), (None, full[3][1], "en", "s")]
    again = [full[5], full[5], (6, "another text with the words of a row that repeats an id of the table", "en", "s")]
    table = clash(make_docs(spark, full + odd + again), F)
    for docs in (table, table.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, SF), name)
            assert name == "pieces" or docs.columns == columns
            if name == "exact_dedup" and columns and docs.count():
                kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
                assert not {100, 101} & {i for i, _ in kept} and all(t for _, t in kept)
                assert len(kept) == len({t for _, t in kept}) and (3, full[3][1]) in kept and (None, full[3][1]) not in kept
                assert {i for i, _ in kept if i is not None} >= {0, 3, 5, 6} and [i for i, _ in kept].count(6) == 2
    assert docs.count() == 0
