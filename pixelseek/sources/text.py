"""Text formats: one record per line, fields split by white space, the first field the key.

Every reader is a projection over ``spark.read.text``; the ``parse_*`` functions take any table
with a ``value`` column. Numbers that do not parse fail the job; ``skip_bad=True`` leaves such
lines out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseek.operators.postings import posting_lists
from pixelseek.operators.relational import with_dim

Paths = str | Sequence[str]


def _tokens() -> Column:
    return F.split(F.btrim("value", F.lit(" \t\r\n\f")), r"\s+")


def _split(lines: DataFrame) -> DataFrame:
    rows = lines.withColumn("_t", _tokens())
    return rows.withColumn("_key", F.element_at("_t", 1)).where(F.length("_key") > 0)


def _numbers(kind: str, skip_bad: bool) -> Column:
    rest = F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0)))
    if skip_bad:
        return F.transform(rest, lambda t: t.try_cast(kind))
    return rest.cast(f"array<{kind}>")


def _whole(df: DataFrame, col: str, skip_bad: bool) -> DataFrame:
    return df.where(~F.exists(col, lambda x: x.isNull())) if skip_bad else df


def parse_vectors(lines: DataFrame, dim: int | None = None, skip_bad: bool = False) -> DataFrame:
    """(vec_id, vec); with ``dim`` only vectors of that length."""
    rows = _split(lines).select(F.col("_key").alias("vec_id"), _numbers("double", skip_bad).alias("vec"))
    rows = _whole(rows, "vec", skip_bad)
    return rows if dim is None else with_dim(rows, dim)


def parse_labels(lines: DataFrame) -> DataFrame:
    """(vec_id, label); lines without a label are left out."""
    rows = _split(lines).where(F.size("_t") > 1)
    return rows.select(F.col("_key").alias("vec_id"), F.element_at("_t", 2).cast("int").alias("label"))


def parse_index(lines: DataFrame) -> DataFrame:
    """(word_id, vec_id), one row per image of a line."""
    rows = _split(lines).select(
        F.col("_key").cast("int").alias("word_id"),
        F.explode(F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0)))).alias("vec_id"),
    )
    return rows.distinct()


def parse_codes(lines: DataFrame) -> DataFrame:
    return _split(lines).select(F.col("_key").alias("vec_id"), _numbers("int", False).alias("code"))


def _later_wins(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    last = F.max_by(value, F.struct("_file", "_line")).alias(value)
    return rows.groupBy(*keys).agg(last)


def parse_words(lines: DataFrame) -> DataFrame:
    """(word_id, wv) from numbered lines; a word given again replaces the earlier one."""
    rows = _split(lines).select(
        F.col("_key").cast("int").alias("word_id"), _numbers("double", False).alias("wv"), "_file", "_line"
    )
    return _later_wins(rows, ["word_id"], "wv")


def parse_centers(lines: DataFrame) -> DataFrame:
    """(gid, cid, c) from numbered lines ``gid-cid v1 v2 ...``; a centre given again replaces the earlier one."""
    ids = F.split("_key", "-")
    rows = _split(lines).select(
        ids[0].cast("int").alias("gid"),
        ids[1].cast("int").alias("cid"),
        _numbers("double", False).alias("c"),
        "_file",
        "_line",
    )
    return _later_wins(rows, ["gid", "cid"], "c")


def numbered(lines: DataFrame, file: int = 0) -> DataFrame:
    """Lines with the place of their file and their order in it."""
    return lines.select("value", F.lit(file).alias("_file"), F.monotonically_increasing_id().alias("_line"))


def _numbered(spark: SparkSession, paths: Paths) -> DataFrame:
    files = [paths] if isinstance(paths, str) else list(paths)
    both = numbered(spark.read.text(files[0]))
    for n, p in enumerate(files[1:], start=1):
        both = both.unionByName(numbered(spark.read.text(p), n))
    return both


def _text(spark: SparkSession, paths: Paths) -> DataFrame:
    return spark.read.text(paths if isinstance(paths, str) else list(paths))


def read_vectors(spark: SparkSession, paths: Paths, dim: int | None = None, skip_bad: bool = False) -> DataFrame:
    return parse_vectors(_text(spark, paths), dim, skip_bad)


def read_words(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_words(_numbered(spark, paths))


def read_labels(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_labels(_text(spark, paths))


def read_index(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_index(_text(spark, paths))


def read_centers(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_centers(_numbered(spark, paths))


def read_codes(spark: SparkSession, paths: Paths) -> DataFrame:
    return parse_codes(_text(spark, paths))


def read_k_grid(spark: SparkSession, paths: Paths) -> DataFrame:
    return _split(_text(spark, paths)).select(F.col("_key").cast("int").alias("k"))


def _joined(key: Column, array: str) -> Column:
    return F.concat_ws(" ", key.cast("string"), F.array_join(F.col(array).cast("array<string>"), " "))


def vector_lines(vectors: DataFrame) -> DataFrame:
    return vectors.select(_joined(F.col("vec_id"), "vec").alias("value"))


def word_lines(words: DataFrame) -> DataFrame:
    return words.select(_joined(F.col("word_id"), "wv").alias("value"))


def center_lines(centers: DataFrame) -> DataFrame:
    return centers.select(_joined(F.concat_ws("-", "gid", "cid"), "c").alias("value"))


def code_lines(codes: DataFrame) -> DataFrame:
    return codes.select(_joined(F.col("vec_id"), "code").alias("value"))


def index_lines(postings: DataFrame, list_docs: int = 100_000) -> DataFrame:
    """``word \\t image image ...``; a long list takes several lines, which ``read_index`` unites."""
    docs = F.array_join(F.transform("docs", lambda d: d["vec_id"].cast("string")), " ")
    return posting_lists(postings, list_docs).select(
        F.concat_ws("\t", F.col("word_id").cast("string"), docs).alias("value")
    )


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files; earlier output at ``path`` is replaced."""
    lines.write.mode("overwrite").text(path)


def write_index(postings: DataFrame, path: str, list_docs: int = 100_000) -> None:
    write_lines(index_lines(postings, list_docs), path)


def write_k_grid(grid: DataFrame, path: str) -> None:
    write_lines(grid.select(F.col("k").cast("string").alias("value")), path)
