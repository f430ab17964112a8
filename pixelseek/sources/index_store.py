"""A stored inverted index that is appended to and probed where it lies.

``path/segments/<id>`` holds postings (word_id, block, vec_id, weight) as Parquet files in ranges of (word, block), so a
file has few words, and a word of very many images lies in several files. ``path/words/<id>`` is the segment's directory:
which words stand in which files, and how often. ``path/versions/<number>`` lists the segments that make up a version of
the index. Added images are a segment of their own and a new version; merging writes all segments as one. A version
counts once Spark has finished writing it, the highest is read, and files that an older one reads are left alone, so
searches go on while an index grows. Writers must take turns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseek.functions.hashing import hash_bucket
from pixelseek.operators.postings import LIST_DOCS, candidates, postings, probe
from pixelseek.operators.relational import join_side, salts_of

DIGITS = 12


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    done = [s.getPath() for s in system.listStatus(folder)]
    return sorted(
        int(p.getName()) for p in done if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    )


def segments(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """Segments of the last version, or of an older one; none if nothing has been written."""
    found = _versions(spark, path)
    if not found:
        return []
    listed = spark.read.schema("segment string").parquet(f"{path}/versions/{version or found[-1]:0{DIGITS}d}")
    return sorted(r["segment"] for r in listed.collect())


def _publish(spark: SparkSession, path: str, names: list[str]) -> None:
    number = max(_versions(spark, path), default=0) + 1
    listed = spark.createDataFrame([(n,) for n in names], "segment string")
    listed.coalesce(1).write.parquet(f"{path}/versions/{number:0{DIGITS}d}")


def _write_segment(rows: DataFrame, path: str, files: int | None, list_docs: int) -> str:
    name = uuid.uuid4().hex
    spark = rows.sparkSession
    counts = rows.groupBy("word_id").agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.select("word_id", F.ceil(F.col("n") / list_docs).cast("int").alias("blocks"))
    placed = join_side(rows, blocks, "word_id").select(
        "word_id", hash_bucket(F.col("blocks"), F.col("vec_id")).alias("block"), "vec_id", "weight"
    )
    ranges = placed.repartitionByRange(files or salts_of(spark), "word_id", "block", "vec_id")
    folder = f"{path}/segments/{name}"
    ranges.sortWithinPartitions("word_id", "block", "vec_id").write.parquet(folder)
    words = spark.read.schema(placed.schema).parquet(folder).groupBy("word_id", F.input_file_name().alias("file"))
    words.agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/words/{name}")
    return name


def append_postings(rows: DataFrame, path: str, files: int | None = None, list_docs: int = LIST_DOCS) -> None:
    """Add postings (word_id, vec_id, weight) as a segment; the first call makes the index."""
    rows = rows.select("word_id", "vec_id", "weight")
    spark = rows.sparkSession
    _publish(spark, path, [*segments(spark, path), _write_segment(rows, path, files, list_docs)])


def _rows(spark: SparkSession, files: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def _schema(spark: SparkSession, path: str, names: list[str]) -> str:
    types = dict(spark.read.parquet(f"{path}/segments/{names[0]}").dtypes)
    return ", ".join(f"{c} {types[c]}" for c in ("word_id", "block", "vec_id", "weight"))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(word_id, vec_id, weight) of the whole index; an image that was added again keeps its least weight per word."""
    names = segments(spark, path)
    if not names:
        raise ValueError(f"no index at {path}")
    rows = _rows(spark, [f"{path}/segments/{n}" for n in names], _schema(spark, path, names))
    return postings(rows, unique_ids=False)


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word_id, n) stored postings of each word, from the directory alone."""
    names = segments(spark, path)
    directory = spark.read.parquet(*[f"{path}/words/{n}" for n in names])
    return directory.groupBy("word_id").agg(F.sum("n").alias("n"))


def merge_segments(spark: SparkSession, path: str, files: int | None = None, list_docs: int = LIST_DOCS) -> None:
    """All segments as one, each (word, image) once; older versions stay readable."""
    _publish(spark, path, [_write_segment(read_postings(spark, path), path, files, list_docs)])


def postings_of(words: DataFrame, path: str) -> DataFrame:
    """(word_id, vec_id, weight) from the files that hold any of ``words`` (word_id), and no others.

    The directory is met with the words by a join; only the names of the files found reach the driver.
    """
    spark = words.sparkSession
    names = segments(spark, path)
    if not names:
        raise ValueError(f"no index at {path}")
    directory = spark.read.parquet(*[f"{path}/words/{n}" for n in names])
    files = directory.join(words.select("word_id").distinct(), "word_id", "left_semi").select("file").distinct()
    return _rows(spark, sorted(r["file"] for r in files.collect()), _schema(spark, path, names)).drop("block")


def probe_store(query_words: DataFrame, path: str) -> DataFrame:
    """(query_id, word_id, vec_id): query words met with the stored postings of their words."""
    return probe(query_words, postings_of(query_words, path))


def search_store(query_words: DataFrame, path: str) -> DataFrame:
    """Distinct (query_id, vec_id) that share at least one word."""
    return candidates(probe_store(query_words, path))
