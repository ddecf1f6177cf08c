"""Content-based identities of records and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\u0000"


def digest(*parts: Column, size: int = 64) -> Column:
    """Hex SHA-256 of the parts joined by NUL, cut to ``size`` digits. Null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws(NUL, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, size)


def record_id(prefix: Column, *parts: Column, size: int = 32) -> Column:
    return F.concat(prefix, F.lit(":"), digest(*parts, size=size))


def hashed_party(identifier: Column, namespace: str = "global") -> Column:
    """A pseudonym that can't be linked across namespaces; null for null."""
    return F.when(identifier.isNotNull(), F.concat(F.lit("sha256:"), digest(F.lit(namespace), identifier)))


def tie_breaker(key: Column, seed: int) -> Column:
    """A stable pseudo-random order of keys: SHA-256 of ``seed:key``."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def table_hash(df: DataFrame, *columns: str) -> DataFrame:
    """(rows, checksum): the same for any order of rows, whatever their partitioning. An empty table has checksum 0."""
    head = F.conv(digest(*(F.col(c) for c in columns), size=12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(head), F.lit(0).cast("decimal(38,0)")).cast("string").alias("checksum"))
