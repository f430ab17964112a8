"""Run registered queries next to their SQL and compare rows, names, types and values."""

from __future__ import annotations

import sys
import time

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(v):
    if isinstance(v, float):
        return (1, repr(v + 0.0))
    return (0, "") if v is None else (1, str(v))


def canonical(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    rows = zip(*[table.column(n).to_pylist() for n in names])
    return sorted(tuple(_key(v) for v in r) for r in rows)


def plain(t: pa.DataType) -> str:
    return str(t).replace("large_", "").replace("string_view", "string")


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got, want = df.toArrow(), con.sql(sql).to_arrow_table()
    got_types = {f.name: plain(f.type) for f in got.schema}
    want_types = {f.name: plain(f.type) for f in want.schema}
    if got_types != want_types:
        return f"schema {got_types} against {want_types}"
    if got.num_rows != want.num_rows:
        return f"{got.num_rows} rows against {want.num_rows}"
    a, b = canonical(got), canonical(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {bad[:2]}" if bad else None


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main() -> None:
    from tests.conftest import session

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        t0 = time.time()
        try:
            if name in sql:
                out = compare(queries[name](spark, sf_dir), con, sql[name])
                text = "ok" if out is None else "DIFF " + out
            else:
                text = f"rows {queries[name](spark, sf_dir).count()}"
        except Exception as e:  # report and go on with the next query
            text = "FAIL " + str(e)[:600]
        print(f"{name:28s} {time.time() - t0:6.2f}s {text}", flush=True)


if __name__ == "__main__":
    main()
