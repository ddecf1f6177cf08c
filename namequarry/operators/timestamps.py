"""Mixed time notations normalised through a dictionary of distinct raw strings."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namequarry.functions.instants import NORMAL_TEXT, with_instant
from namequarry.session import Files, work_dir
from namequarry.skew import join_counted

KEYS = ["raw", "zone", "day_order"]


class InstantDictionary:
    """A stored dictionary (raw text, zone, order of numeric dates) -> epoch milliseconds.

    Every distinct key is parsed once in the dictionary's life: ``update`` keeps the keys it doesn't hold yet,
    parses those and appends them as one more generation (a folder of Parquet files that becomes visible with its
    success marker). Null raw text has no key and no instant. A missing zone or order is kept as an empty string.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or work_dir(spark, "instants")
        self.files = Files(spark, self.path)

    def generations(self) -> list[str]:
        names = [n for n in self.files.names(self.path) if n.startswith("gen=")]
        return [f"{self.path}/{n}" for n in names if self.files.exists(f"{self.path}/{n}/_SUCCESS")]

    def entries(self) -> DataFrame | None:
        made = self.generations()
        return self.spark.read.parquet(*made) if made else None

    def update(self, rows: DataFrame) -> DataFrame:
        """Add the keys of ``rows`` (columns raw, zone, day_order); gives each of its keys with its count and instant."""
        wanted = rows.where(F.col("raw").isNotNull()).select("raw", *(F.coalesce(F.col(k), F.lit("")).alias(k) for k in KEYS[1:]))
        counted = wanted.groupBy(*KEYS).agg(F.count("*").alias("n"))
        held = self.entries()
        fresh = counted if held is None else counted.join(held.select(*KEYS), KEYS, "left_anti")
        fresh = fresh.withColumns({"own_zone": F.nullif("zone", F.lit("")), "own_order": F.nullif("day_order", F.lit(""))})
        parsed = with_instant(fresh, "raw", "epoch_ms", "own_zone", "own_order").select(*KEYS, "n", "epoch_ms")
        parsed.write.parquet(f"{self.path}/gen={len(self.generations()):06d}-{uuid.uuid4().hex[:8]}")  # what a failed run left has no success marker and is never in the way
        now = self.entries()
        return now if held is None else counted.join(now.drop("n"), KEYS)


def normalised(rows: DataFrame, dictionary: InstantDictionary) -> DataFrame:
    """``rows`` (with raw, zone, day_order) that have an instant, with ``epoch_ms``; rows without one are left out."""
    known = dictionary.update(rows).where(F.col("epoch_ms").isNotNull())
    keyed = rows.where(F.col("raw").isNotNull()).withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in KEYS[1:]})
    return join_counted(keyed, known, KEYS, "n")


def denormal_times(fields: dict[tuple[str, str], DataFrame], feeds: DataFrame, dictionary: InstantDictionary) -> DataFrame:
    """Values that have an instant but not the normal form, as (tab, field, row_key, epoch_ms).

    fields: for each (table, field) rows of (row_key bigint, raw string, source string); whole numbers must come as
    text. The normal form is ``yyyy-MM-ddTHH:mm:ss.SSSZ`` for text and whole seconds (9 to 11 digits) for fields
    whose name ends in ``_utime``. feeds: (source, clock_zone, day_order), a dimension of at most a few thousand rows.
    Null, blank and unusable values and normal forms give no row; repeated rows give one row each.
    """
    parts = []
    for (tab, field), rows in fields.items():
        form = r"^\d{9,11}$" if field.endswith("_utime") else NORMAL_TEXT
        parts.append(rows.where(~F.col("raw").rlike(form)).select(F.lit(tab).alias("tab"), F.lit(field).alias("field"), "row_key", "raw", "source"))
    raw = reduce(DataFrame.unionByName, parts)
    clocks = F.broadcast(feeds.where(F.col("source").isNotNull()).groupBy("source").agg(F.first("clock_zone").alias("zone"), F.first("day_order").alias("day_order")))
    return normalised(raw.join(clocks, "source", "left").drop("source"), dictionary).select("tab", "field", "row_key", "epoch_ms")
