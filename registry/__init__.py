"""Registered queries and, beside each, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def fragment(name: str, sql: str, *needs: str) -> None:
    FRAGMENTS[name] = (needs, sql)


def with_fragments(final: str, *needs: str) -> str:
    """``final`` behind a WITH clause of the named fragments and what they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in FRAGMENTS[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return final
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({FRAGMENTS[n][1]})" for n in order) + "\n" + final


def register(name: str, sql: str | None = None, *needs: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_fragments(sql, *needs)
        return fn

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def cells(df: DataFrame, *keys: str, array: str = "out") -> DataFrame:
    """An array column as rows (keys, i, x), i from 1 and x rounded."""
    rows = df.select(*keys, F.posexplode(array).alias("p", "e"))
    return rows.select(*keys, (F.col("p") + 1).cast("int").alias("i"), r6("e").alias("x"))
