"""Queries of the operators for training data (problems 1, 4, 8, 9, 10)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namequarry.functions.instants import with_instant
from namequarry.functions.names import shown_name
from namequarry.llm.incremental_dedup import SaleIndex
from namequarry.llm.mixing import Mix
from namequarry.llm.residue import residue_documents, validation
from namequarry.llm.survivors import survivor_rows, survivor_values, survivors
from namequarry.llm.tokenize import encoded, token_counts
from namequarry.plans.pipeline_queries import market_instants, table
from namequarry.session import Files, checkpointed, work_dir


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    feeds = F.broadcast(table(spark, sf, "source_feeds").select("source", "clock_zone", "day_order"))
    rows = table(spark, sf, "sold_records").select("row_id", "batch_no", "eventId", "username", "priceTon", "saleAt", "source")
    timed = with_instant(rows.join(feeds, "source", "left"), "saleAt", "ms", "clock_zone", "day_order")
    clean = timed.select("row_id", "batch_no", F.col("eventId").alias("event_id"), shown_name(F.col("username")).alias("name"), F.col("priceTon").alias("price"), "ms")
    at = work_dir(spark, "sold")
    clean.write.partitionBy("batch_no").parquet(at)  # times are parsed once, and a batch reads its own rows
    stored = spark.read.schema(clean.schema).parquet(at)
    index = SaleIndex(spark)
    names = [n.split("=")[1] for n in Files(spark, at).names(at) if n.startswith("batch_no=")]
    for no in sorted((int(n) if re.match(r"-?\d+$", n) else None for n in names), key=lambda n: (n is not None, n)):  # one name per batch; null first
        index.ingest(stored.where(F.col("batch_no").eqNullSafe(no)))
    return index.assigned().where("batch_no >= 1 and root <> row_id").select(F.col("root").alias("first_row_id"), "row_id")


def _survivors(spark: SparkSession, sf: str) -> DataFrame:
    trimmed = F.lower(F.regexp_replace("eventId", r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    # rows without an id are dropped at the scan, before their times are parsed
    rows = market_instants(spark, sf, "eventId", "confidence", "identityKind", "provenance", where=trimmed != "")
    fields = table(spark, sf, "market_events").schema["provenance"].dataType.fieldNames()
    return survivors(rows.withColumn("event_id", trimmed), fields)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivor_rows(_survivors(spark, sf))


def p4_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return survivor_values(checkpointed(_survivors(spark, sf), "survivors"), table(spark, sf, "market_events"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(table(spark, sf, "documents"))


def _mix(spark: SparkSession, sf: str, total: str | None = "corpus") -> Mix:
    sized = token_counts(table(spark, sf, "documents"), "doc_id", also=("source",))
    return Mix(sized, table(spark, sf, "mix_targets"), total)


def p9_sequence(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).sequence()


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).shares()


def p9_shares_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf, "corpus").shares()


def p9_shares_met(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf, None).shares()


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue_documents(table(spark, sf, "documents")).select("doc_id")


def p10_validation(spark: SparkSession, sf: str) -> DataFrame:
    return validation(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p4_found, p4_survivors, p8_ids, p9_sequence, p9_shares, p9_shares_corpus, p9_shares_met, p10_found, p10_validation)}
ORACLE: dict[str, str] = {}
