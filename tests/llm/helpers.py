"""Small document tables with awkward rows."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows (doc_id, text, lang, source), spread over two partitions."""
    full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows]
    return spark.createDataFrame(full, DOCS).repartition(2) if full else spark.createDataFrame([], DOCS)


def clash(df, spark_functions):
    """The table with extra columns named like those that operators use inside."""
    F = spark_functions
    for name in ("row", "digest", "_n", "_id", "fp", "h", "p", "shard", "tokens", "_rank", "group_size", "a.b"):
        df = df.withColumn(name, F.lit("own"))
    return df


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)
