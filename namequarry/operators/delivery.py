"""One copy of each message that was delivered at least once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from namequarry.session import checkpointed
from namequarry.skew import join_counted


def id_bytes(text: Column) -> Column:
    """The 32-byte value that a text writes as hex (any case, 0x or not) or base64 (either alphabet, padded or not), in lower-case hex.

    Surrounding white space and percent encoding don't count. Null, and text that denotes no 32 bytes, give null.
    """
    flat = F.regexp_replace(text, r"^\s+|\s+$", "")
    flat = F.when(flat.contains("%"), F.try_url_decode(F.replace(flat, F.lit("+"), F.lit("%2B")))).otherwise(flat)
    flat = F.regexp_replace(flat, r"^\s+|\s+$", "")
    hexed = F.regexp_extract(flat, r"^(?:0[xX])?([0-9a-fA-F]{64})$", 1)
    based = F.translate(F.regexp_extract(flat, r"^([A-Za-z0-9+/_-]{43})=?$", 1), "-_", "+/")
    return F.when(hexed != "", F.lower(hexed)).when(based != "", F.lower(F.hex(F.unbase64(F.concat(based, F.lit("=")))))).otherwise(None)


def first_deliveries(rows: DataFrame, raw_id: str, order: str) -> DataFrame:
    """One row of each identifier, that of its smallest ``order``, and every row whose id denotes nothing.

    One aggregation with partial sums carries the message of the smallest ``order``, so singletons leave it as they
    are, without a join, and so does the copy to keep of each repeated group.
    """
    key = F.coalesce(id_bytes(F.col(raw_id)), F.concat(F.lit("no id "), F.col(order).cast("string")))
    keyed = rows.select(key.alias("__key"), F.col(order).alias("__order"), F.struct(*rows.columns).alias("__row"))
    return keyed.groupBy("__key").agg(F.min_by("__row", "__order").alias("r")).select("r.*")


def split_deliveries(messages: DataFrame, raw_id: str, order: str, stored: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, repeats) of all stored and new messages.

    Identifiers are split by their frequency: singletons pass directly out of the aggregation that counts, and only
    rows of repeated groups are ranked, against the smallest ``order`` of their group, so that no group is gathered or
    sorted. Kept are singletons, the first of each group, and messages whose id denotes
    nothing (null, blank, provisional or of wrong size), which repeat nothing. ``order`` must be unique.
    """
    rows = messages if stored is None else stored.unionByName(messages, allowMissingColumns=True)
    return first_deliveries(rows, raw_id, order), repeated_deliveries(rows, raw_id, order)


def repeated_deliveries(rows: DataFrame, raw_id: str, order: str) -> DataFrame:
    """Every row of an identifier but the one with its smallest ``order``. Frequencies are counted once and kept for groups that repeat."""
    keyed = rows.withColumn("__key", id_bytes(F.col(raw_id))).where(F.col("__key").isNotNull())
    groups = keyed.groupBy("__key").agg(F.count("*").alias("__n"), F.min(order).alias("__first")).where("__n > 1")
    seen = Observation()
    groups = checkpointed(groups.observe(seen, F.sum("__n").alias("total"), F.max("__n").alias("most")), "repeated")
    found = join_counted(keyed, groups, ["__key"], "__n", known=(seen.get["total"] or 0, seen.get["most"] or 0))
    return found.where(F.col(order) > F.col("__first")).drop("__key", "__first")
