"""Structured Streaming over event files: bounded runs that end when the input is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namequarry.session import work_dir


def read_events(spark: SparkSession, path: str, schema, per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drained(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream to the end of its input into Parquet in the shared folder and read the result."""
    out = work_dir(stream.sparkSession, label)
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/data")


def latest(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run an aggregation in update mode, each batch replacing its keys; gives the last state of every key."""
    spark, out = stream.sparkSession, work_dir(stream.sparkSession, label)

    def keep(batch: DataFrame, no: int) -> None:
        batch.withColumn("__batch", F.lit(no)).write.mode("append").parquet(f"{out}/data")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(f"{out}/data")
    rest = [c for c in stream.columns if c not in keys]
    return seen.groupBy(*keys).agg(F.max(F.struct("__batch", *rest)).alias("m")).select(*keys, *(F.col("m")[c].alias(c) for c in rest))


def windowed_counts(events: DataFrame, at: str, by: list[str], window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Counts and sums per event-time window, with a watermark that bounds the state."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def once(events: DataFrame, at: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """Each key once, with state only as far back as the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
