"""A corpus pipeline of five stages over ``documents``.

Defined cases: documents of null or empty text, or without a letter, have no language and go with the first stage; a null
doc_id is a value like any other, and of equal texts the row with the largest doc_id stays (null before all others); rows
that repeat an id with another text are documents of their own; an empty table gives an empty result. All stages but the
last return the columns of their input, whatever further ones it has; the last returns its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseek.llm import decontaminate, exact_dedup, language, pieces, simhash
from pixelseek.llm.common import stored

#: File of the piece model; None: that of the public tokenizers.
PIECE_MODEL: str | None = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: without letters, or with all languages in doubt."""
    return language.keep_known(docs, language.fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near fingerprints the document with the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids, exact) of every document."""
    path = PIECE_MODEL
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    told = docs.select("doc_id", "lang", "source", pieces.encoded(path, F.col("text")).alias("p"))
    return told.select("doc_id", "lang", "source", F.size("p.ids").cast("long").alias("n_pieces"), "p.ids", "p.exact")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("decontaminate", benchmark),
    ("pieces", tokens),
]

#: Models, components and pieces are beyond SQL. Tests compare exact dedup and pieces with plain Python and bound what the
#: language and near-duplicate stages drop; the operators have their own brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
