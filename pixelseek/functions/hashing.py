"""A seeded 32-bit hash that any SQL engine with md5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | int | str) -> Column:
    """First eight hex digits of the md5 of the ':'-joined parts, as a bigint."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    joined = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts: Column | int | str) -> Column:
    """Hash mapped to [0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)


def hash_bucket(buckets: Column | int, *parts: Column | int | str) -> Column:
    n = buckets if isinstance(buckets, Column) else F.lit(buckets)
    return F.pmod(hash32(*parts), n).cast("int")
