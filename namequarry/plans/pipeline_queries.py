"""Queries of the general data-preparation operators (problems 2, 3, 5, 6, 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namequarry.functions.instants import with_instant
from namequarry.functions.names import shown_name
from namequarry.operators.delivery import first_deliveries, repeated_deliveries
from namequarry.operators.intervals import gaps, listing_intervals, merged_periods, stream_gaps
from namequarry.operators.late import CorrectedCounts
from namequarry.operators.nested import nested_children
from namequarry.operators.timestamps import InstantDictionary, denormal_times


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    sold, events = table(spark, sf, "sold_records"), table(spark, sf, "market_events")
    event = lambda c: events.select(F.col("row_id").alias("row_key"), F.col(c).alias("raw"), F.col("provenance.source").alias("source"))
    actions = table(spark, sf, "raw_actions")
    fields = {
        ("sold_records", "saleAt"): sold.select(F.col("row_id").alias("row_key"), F.col("saleAt").alias("raw"), "source"),
        ("market_events", "eventAt"): event("eventAt"),
        ("market_events", "observedAt"): event("observedAt"),
        ("raw_actions", "start_utime"): actions.select(F.col("delivery_id").alias("row_key"), F.col("start_utime").cast("string").alias("raw"), F.lit(None).cast("string").alias("source")),
    }
    return denormal_times(fields, table(spark, sf, "source_feeds"), InstantDictionary(spark))


def _listings(spark: SparkSession, sf: str) -> DataFrame:
    return listing_intervals(table(spark, sf, "listing_observations"), shown_name(F.col("username")))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return gaps(_listings(spark, sf)).select(F.col("entity").alias("username"), F.col("gap_from").alias("gap_from_ms"), F.col("gap_to").alias("gap_to_ms"))


def p3_periods(spark: SparkSession, sf: str) -> DataFrame:
    return merged_periods(_listings(spark, sf)).select(F.col("entity").alias("username"), F.col("start").alias("from_ms"), F.col("stop").alias("to_ms"))


def p3_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The gaps of p3_found through keyed state that outlives the batches of a stream."""
    seen = spark.readStream.schema(table(spark, sf, "listing_observations").schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/listing_observations*.parquet")
    found = stream_gaps(listing_intervals(seen, shown_name(F.col("username"))))
    return found.select(F.col("entity").alias("username"), F.col("gap_from").alias("gap_from_ms"), F.col("gap_to").alias("gap_to_ms"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    actions = table(spark, sf, "raw_actions").select("delivery_id", "action_id")
    return repeated_deliveries(actions, "action_id", "delivery_id").select("delivery_id")


def p5_kept(spark: SparkSession, sf: str) -> DataFrame:
    actions = table(spark, sf, "raw_actions").select("delivery_id", "action_id", "trace_id", "batch_no")
    return first_deliveries(actions, "action_id", "delivery_id").select("delivery_id", "trace_id", "batch_no")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested_children(table(spark, sf, "raw_actions")).withColumnRenamed("row_key", "delivery_id")


def market_instants(spark: SparkSession, sf: str, *columns: str, where: Column | None = None) -> DataFrame:
    """market_events with event_ms and observed_ms; ``where`` is applied at the scan."""
    feeds = F.broadcast(table(spark, sf, "source_feeds").select(F.col("source").alias("feed"), "clock_zone", "day_order"))
    events = table(spark, sf, "market_events")
    rows = (events if where is None else events.where(where)).select("row_id", *columns, "eventAt", "observedAt", F.col("provenance.source").alias("feed")).join(feeds, "feed", "left")
    rows = with_instant(rows, "eventAt", "event_ms", "clock_zone", "day_order")
    return with_instant(rows, "observedAt", "observed_ms", "clock_zone", "day_order")


def _late(spark: SparkSession, sf: str, batches: int = 3) -> CorrectedCounts:
    """The whole table taken in as so many batches in the order of arrival."""
    low, high = table(spark, sf, "market_events").agg(F.min("row_id"), F.max("row_id")).first()
    store = CorrectedCounts(spark)
    if low is not None:
        step = (high - low) // batches + 1
        for i in range(batches):
            rows = market_instants(spark, sf, "username", where=F.col("row_id").between(low + i * step, low + (i + 1) * step - 1))
            store.ingest(rows.select("row_id", shown_name(F.col("username")).alias("entity"), "event_ms", "observed_ms"))
    return store


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    found = _late(spark, sf).late_rows()
    return found.select(F.col("entity").alias("username"), F.date_from_unix_date("event_day").cast("string").alias("event_day"), "row_id", "fate")


def p7_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = _late(spark, sf).counts()
    return counts.select(F.col("entity").alias("username"), F.date_from_unix_date("event_day").cast("string").alias("event_day"), "events", "late_events")


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_periods, p3_stream, p5_found, p5_kept, p6_found, p7_found, p7_counts)}

_SHOWN = "nullif(regexp_replace(translate(lower(username), 'ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ０１２３４５６７８９＿', 'abcdefghijklmnopqrstuvwxyz0123456789_'), '[^a-z0-9_]', '', 'g'), '')"
_PERIODS = f"""WITH i AS (SELECT {_SHOWN} AS username, epoch_ms(listedAt) AS a, epoch_ms(coalesce(endedAt, soldAt, lastObservedAt)) AS b FROM listing_observations),
j AS (SELECT *, max(b) OVER (PARTITION BY username ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i WHERE username IS NOT NULL AND a < b),
k AS (SELECT *, sum(CASE WHEN seen IS NULL OR a > seen THEN 1 ELSE 0 END) OVER (PARTITION BY username ORDER BY a, b) AS period FROM j)"""
_ID_BYTES = r"""WITH t AS (SELECT *, regexp_replace(action_id, '^\s+|\s+$', '', 'g') AS x FROM raw_actions), u AS (SELECT *, CASE WHEN contains(x, '%') THEN regexp_replace(url_decode(x), '^\s+|\s+$', '', 'g') ELSE x END AS y FROM t),
v AS (SELECT *, CASE WHEN regexp_full_match(y, '(0[xX])?[0-9a-fA-F]{64}') THEN lower(right(y, 64)) WHEN regexp_full_match(y, '[A-Za-z0-9+/_-]{43}=?') THEN lower(hex(from_base64(translate(left(y, 43), '-_', '+/') || '='))) END AS id FROM u),
w AS (SELECT *, min(delivery_id) OVER (PARTITION BY id) AS first FROM v)"""
ORACLE = {
    "p3_stream": _PERIODS + " SELECT username, seen AS gap_from_ms, a AS gap_to_ms FROM j WHERE a > seen",
    "p3_found": _PERIODS + " SELECT username, seen AS gap_from_ms, a AS gap_to_ms FROM j WHERE a > seen",
    "p3_periods": _PERIODS + " SELECT username, min(a) AS from_ms, max(b) AS to_ms FROM k GROUP BY username, period",
    "p5_found": _ID_BYTES + " SELECT delivery_id FROM w WHERE id IS NOT NULL AND delivery_id > first",
    "p5_kept": _ID_BYTES + " SELECT delivery_id, trace_id, batch_no FROM w WHERE id IS NULL OR delivery_id = first",
}
