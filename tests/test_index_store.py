"""An index that is stored, appended to, merged and probed by file."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pixelseek.operators import postings as po
from pixelseek.sources import index_store as st

POSTINGS = "word_id int, vec_id long, weight double"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def path(tmp_path):
    return f"file:{tmp_path}/index"


def made(spark, first, n, words=40):
    """Word 0 is in every image, others in some."""
    data = [(0, i, 0.5) for i in range(first, first + n)]
    data += [(1 + (i * 7 + k) % words, i, k / 10) for i in range(first, first + n) for k in range(2)]
    return spark.createDataFrame(data, POSTINGS)


def test_append_and_merge(spark, path):
    a, b = made(spark, 0, 200), made(spark, 150, 200)
    again = spark.createDataFrame([(0, 5, 0.1), (0, 6, 0.9)], POSTINGS)
    st.append_postings(a, path, files=6, list_docs=50)
    first = rows(st.read_postings(spark, path))
    assert first == rows(a)
    st.append_postings(b, path, files=6, list_docs=50)
    st.append_postings(again, path, files=1)
    want = rows(po.postings(a.unionByName(b).unionByName(again)))
    assert rows(st.read_postings(spark, path)) == want and (0, 5, 0.1) in want and (0, 6, 0.5) in want
    assert len(st.segments(spark, path)) == 3 and len(st.segments(spark, path, version=1)) == 1
    stored = {r["word_id"]: r["n"] for r in st.word_counts(spark, path).collect()}
    assert stored[0] == 402
    st.merge_segments(spark, path, files=5)
    assert len(st.segments(spark, path)) == 1 and rows(st.read_postings(spark, path)) == want
    assert {r["word_id"]: r["n"] for r in st.word_counts(spark, path).collect()}[0] == 350
    # What an older version reads is still there.
    (old,) = st.segments(spark, path, version=1)
    kept = spark.read.parquet(f"{path}/segments/{old}").select("word_id", "vec_id", "weight")
    assert rows(kept) == first


def test_probe_reads_the_files_of_its_words(spark, path):
    a, b = made(spark, 0, 300), made(spark, 300, 300)
    for part in (a, b):
        st.append_postings(part, path, files=12, list_docs=60)
    asked = spark.createDataFrame([(1, 7), (1, 7), (2, 30), (2, 99), (3, None)], "query_id int, word_id int")
    found = st.postings_of(asked, path)
    whole = spark.read.parquet(*[f"{path}/segments/{n}" for n in st.segments(spark, path)])
    # A word's postings lie together: two words of each of two segments are in a file or two.
    assert 2 <= len(found.inputFiles()) <= 8 < len(whole.inputFiles())
    assert rows(st.probe_store(asked, path)) == rows(po.probe(asked, a.unionByName(b)))
    assert rows(st.search_store(asked, path)) == rows(po.candidates(po.probe(asked, a.unionByName(b))))
    # The word of every image is spread over files by blocks.
    common = st.postings_of(asked.limit(1).select(F.lit(0).alias("word_id")), path)
    assert len(common.inputFiles()) >= 6 and common.where("word_id = 0").count() == 600


def test_nothing_found_and_nothing_stored(spark, path):
    asked = spark.createDataFrame([(1, 77)], "query_id int, word_id int")
    with pytest.raises(ValueError):
        st.search_store(asked, path)
    st.append_postings(made(spark, 0, 5), path, files=2)
    assert st.search_store(asked, path).count() == 0
    st.append_postings(made(spark, 0, 5).limit(0), path, files=2)
    assert st.read_postings(spark, path).count() == 15


def test_unfinished_version_is_not_read(spark, path, tmp_path):
    st.append_postings(made(spark, 0, 5), path, files=2)
    before = st.segments(spark, path)
    (tmp_path / "index" / "versions" / f"{2:0{st.DIGITS}d}").mkdir()
    assert st.segments(spark, path) == before
