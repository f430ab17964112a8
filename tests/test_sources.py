from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pixelseek.operators.ranking import k_grid
from pixelseek.sources import images as im
from pixelseek.sources import tables as tb
from pixelseek.sources import text as tx


def write(path, text):
    path.write_text(text)
    return str(path)


def test_read_vectors(spark, tmp_path):
    p = write(tmp_path / "v.txt", "a 1 2.5e-3\n  b\t-3   4 \n\nc 1\n")
    assert {tuple([r.vec_id, *r.vec]) for r in tx.read_vectors(spark, p).collect()} == {("a", 1, 0.0025), ("b", -3, 4), ("c", 1)}
    assert {r.vec_id for r in tx.read_vectors(spark, p, dim=2).collect()} == {"a", "b"}


def test_bad_numbers(spark, tmp_path):
    p = write(tmp_path / "v.txt", "a 1 x\nb 1 2\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tx.read_vectors(spark, p).collect()
    assert [r.vec_id for r in tx.read_vectors(spark, p, skip_bad=True).collect()] == ["b"]


def test_later_key_wins(spark, tmp_path):
    a, b = write(tmp_path / "a", "0-0 1 1\n0-1 2 2\n0-0 3 3\n"), write(tmp_path / "b", "0-1 9 9\n1-0 4\n")
    got = {(r.gid, r.cid): r.c for r in tx.read_centers(spark, [a, b]).collect()}
    assert got == {(0, 0): [3, 3], (0, 1): [9, 9], (1, 0): [4]}
    assert {r.word_id: r.wv for r in tx.read_words(spark, write(tmp_path / "w", "7 1\n7 2 3\n8\n")).collect()} == {7: [2, 3], 8: []}


def test_labels_codes_grid(spark, tmp_path):
    assert {tuple(r) for r in tx.read_labels(spark, write(tmp_path / "l", "a 1\nb 2\nc\n")).collect()} == {("a", 1), ("b", 2)}
    assert [tuple(r) for r in tx.read_codes(spark, write(tmp_path / "c", "a 3  0 12\n")).collect()] == [("a", [3, 0, 12])]
    out = str(tmp_path / "k")
    tx.write_k_grid(k_grid(spark), out)
    assert sorted(r.k for r in tx.read_k_grid(spark, out).collect())[-1] == 5000


def test_index_round_trip_replaces_output(spark, tmp_path):
    rows = spark.createDataFrame([(0, f"i{n}", 0.1) for n in range(50)] + [(1, "x", 0.2)], "word_id int, vec_id string, weight double")
    out = str(tmp_path / "index")
    for docs in (1000, 10):
        tx.write_index(rows, out, docs)
        back = {tuple(r) for r in tx.read_index(spark, out).collect()}
        assert back == {(r.word_id, r.vec_id) for r in rows.collect()}
    assert spark.read.text(out).count() > 2


def test_text_round_trips(spark, tmp_path):
    centers = spark.createDataFrame([(0, 1, [0.1, 1e-9]), (1, 0, [3.0])], "gid int, cid int, c array<double>")
    tx.write_lines(tx.center_lines(centers), str(tmp_path / "c"))
    assert {(r.gid, r.cid, *r.c) for r in tx.read_centers(spark, str(tmp_path / "c")).collect()} == {(0, 1, 0.1, 1e-9), (1, 0, 3.0)}
    codes = spark.createDataFrame([("a", [1, 2])], "vec_id string, code array<int>")
    tx.write_lines(tx.code_lines(codes), str(tmp_path / "d"))
    assert tx.read_codes(spark, str(tmp_path / "d")).collect() == codes.collect()
    words = spark.createDataFrame([(4, [0.5, 0.25])], "word_id int, wv array<double>")
    tx.write_lines(tx.word_lines(words), str(tmp_path / "e"))
    assert tx.read_words(spark, str(tmp_path / "e")).collect() == words.collect()


def test_descriptors_and_features(spark, tmp_path):
    desc = spark.createDataFrame([(0, 0, [1.0], "x"), (1, 0, [2.0], "y")], "image_id int, desc_id int, d array<double>, class_name string")
    tb.write_descriptors(desc, str(tmp_path / "d"))
    assert tb.read_descriptors(spark, str(tmp_path / "d")).where("class_name = 'y'").first().d == [2.0]
    features = spark.createDataFrame([(0, 1, 2, 0.5)], "image_id int, bin int, word_id int, v double")
    for n, label in enumerate((1, 2)):
        labels = spark.createDataFrame([(0, label)], "vec_id int, label int")
        tb.write_image_features(features, labels, str(tmp_path / f"f{n}"))
    both = tb.assemble_features(spark, str(tmp_path / "f0"), str(tmp_path / "f1"))
    assert {r.label for r in both.collect()} == {1, 2}


def test_by_key_and_single(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("query_id"), F.col("id").alias("vec_id"))
    tb.write_by_key(df, "query_id", str(tmp_path / "k"))
    assert sorted(p.name for p in (tmp_path / "k").glob("query_id=*")) == [f"query_id={n}" for n in range(3)]
    assert spark.read.parquet(str(tmp_path / "k")).count() == 100
    tb.write_single(df.repartition(5), str(tmp_path / "s"))
    assert len(list((tmp_path / "s").glob("*.parquet"))) == 1


def test_catalogue(spark, tmp_path):
    for folder, names in (("b", ["1.png", "2.png", "n.txt"]), ("a", ["1.png"])):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"x")
    got = {(r.class_name, r["name"], r.label) for r in im.list_images(spark, str(tmp_path), "png").collect()}
    assert got == {("a", "1.png", 1), ("b", "1.png", 2), ("b", "2.png", 2)}
    (tmp_path / "b" / "3.PNG").write_bytes(b"x")
    flat = {(r["name"], r.extension) for r in im.list_files(spark, str(tmp_path / "b"), [".png", "txt"]).collect()}
    assert flat == {("1", "png"), ("2", "png"), ("3", "PNG"), ("n", "txt")}
