"""Overlapping and gapped intervals per entity as continuous periods and gaps."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namequarry.session import Files, checkpointed, work_dir

BLOCK_MS = 86_400_000


class IntervalMap:
    """Disjoint closed intervals of one entity in order; touching ones are one.

    ``insert`` finds the intervals that overlap or touch the new one by binary search and merges them in place.
    """

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = starts or [], ends or []

    def insert(self, start: int, end: int) -> None:
        lo = bisect_left(self.ends, start)  # the first that ends at or after the new start
        hi = bisect_right(self.starts, end)  # beyond the last that starts at or before the new end
        if lo < hi:
            start, end = min(start, self.starts[lo]), max(end, self.ends[hi - 1])
        self.starts[lo:hi], self.ends[lo:hi] = [start], [end]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends))

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends[:-1], self.starts[1:]))


_OUT = "entity string, block bigint, gap_from bigint, gap_to bigint, block_end bigint"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keyed state over rows grouped by (entity, block): one interval map at a time, its gaps given out when its key ends.

    One row a gap, and one row a block with its first start as gap_to and no gap_from.
    """
    key, state = None, IntervalMap()
    schema = pa.schema([("entity", pa.string()), ("block", pa.int64()), ("gap_from", pa.int64()), ("gap_to", pa.int64()), ("block_end", pa.int64())])
    out: list[list] = [[], [], [], [], []]

    def close() -> None:
        if key is not None:
            gaps = [(None, state.starts[0]), *state.gaps()]
            for col, values in zip(out, ([key[0]] * len(gaps), [key[1]] * len(gaps), [g[0] for g in gaps], [g[1] for g in gaps], [state.ends[-1]] * len(gaps))):
                col.extend(values)

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    for batch in batches:
        for entity, block, start, stop in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (entity, block) != key:
                close()
                key, state = (entity, block), IntervalMap()
                if len(out[0]) >= 10_000:
                    yield made()
                    out = [[], [], [], [], []]
            state.insert(start, stop)
    close()
    yield made()


def _gaps(intervals: DataFrame, block_ms: int) -> DataFrame:
    """(entity, block, gap_from, gap_to, last): every gap of an entity, and one row with no gap_from for its first start; last: its last end so far.

    Intervals go, in no order, into the map of their (entity, block of their start), so a hot entity is spread over as many tasks as it
    has blocks. Only the longest interval of each (entity, start) matters, which is aggregated before anything is shuffled. The maps'
    gaps are written once. Blocks meet through one summary row each, whose number the calendar bounds: a gap of a
    block stays as far as no earlier block reaches into it.
    """
    thin = intervals.where("entity is not null and start < stop").groupBy("entity", F.floor(F.col("start") / block_ms).alias("block"), "start").agg(F.max("stop").alias("stop"))
    keyed = thin.select("entity", "block", "start", "stop").repartition("entity", "block").sortWithinPartitions("entity", "block")
    return _met(checkpointed(keyed.mapInArrow(_fold, _OUT), "intervals"))


def _met(kept: DataFrame) -> DataFrame:
    """The gaps of all blocks of an entity, shortened or filled by what earlier blocks reach into them."""
    earlier = Window.partitionBy("entity").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    reach = kept.where("gap_from is null").select("entity", "block", F.max("block_end").over(earlier).alias("reach"))
    met = kept.join(reach, ["entity", "block"]).where("reach is null or reach < gap_to")
    return met.select("entity", "block", F.greatest("gap_from", "reach").alias("gap_from"), "gap_to", "block_end")


def gaps(intervals: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """The gaps (entity, gap_from, gap_to) between the continuous periods of each entity.

    intervals: (entity string, start bigint, stop bigint), stops after starts; rows with a null or with no positive
    length are left out, repeated rows change nothing, extra columns are dropped. Periods that touch are one. An
    entity with one period, and an empty table, give no gap.
    """
    return _gaps(intervals, block_ms).where("gap_from is not null").select("entity", "gap_from", "gap_to")


def stream_gaps(intervals: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """``gaps`` of a stream of (entity string, start bigint, stop bigint), read to the end of its input.

    The interval map of each (entity, block) is keyed state that outlives batches and runs of the stream: a batch loads the
    maps of its own keys only, inserts by binary search, and puts out their gaps anew. Each batch is a folder of its own, written
    again if it is repeated; the last of a key holds.
    """
    spark, out = intervals.sparkSession, work_dir(intervals.sparkSession, "interval-stream")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        starts, ends = state.get if state.exists else ([], [])
        held = IntervalMap(list(starts), list(ends))
        for batch in batches:
            for start, stop in zip(batch["start"], batch["stop"]):
                held.insert(int(start), int(stop))
        state.update((held.starts, held.ends))
        rows = [(*key, None, held.starts[0], held.ends[-1]), *((*key, a, b, held.ends[-1]) for a, b in held.gaps())]
        made = pd.DataFrame(rows, columns=["entity", "block", "gap_from", "gap_to", "block_end"])
        yield made.astype({"gap_from": "Int64"})

    def keep(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/batch={no}")

    keyed = intervals.where("entity is not null and start < stop").withColumn("block", F.floor(F.col("start") / block_ms))
    kept = keyed.groupBy("entity", "block").applyInPandasWithState(step, _OUT, "starts array<bigint>, ends array<bigint>", "update", "NoTimeout")
    kept.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    schema = _OUT + ", batch bigint"
    seen = spark.read.schema(schema).parquet(f"{out}/data") if Files(spark, out).exists(f"{out}/data") else spark.createDataFrame([], schema)
    last = seen.groupBy("entity", "block").agg(F.max("batch").alias("batch"))
    current = checkpointed(seen.join(last, ["entity", "block", "batch"]).drop("batch"), "intervals")
    return _met(current).where("gap_from is not null").select("entity", "gap_from", "gap_to")


def merged_periods(intervals: DataFrame, block_ms: int = BLOCK_MS) -> DataFrame:
    """The continuous periods (entity, start, stop) of each entity; cases as in ``gaps``.

    A period begins where a gap ends (or at the first start) and ends where the next gap begins (or with the last end).
    """
    begins = _gaps(intervals, block_ms)
    last = intervals.where("entity is not null and start < stop").groupBy("entity").agg(F.max("stop").alias("last"))
    # ends shift by one among the gaps: within a block by lead, across blocks through each block's first gap
    in_block = Window.partitionBy("entity", "block").orderBy("gap_to")
    begins = begins.withColumns({"next": F.lead("gap_from").over(in_block), "rank": F.row_number().over(in_block)})
    heads = begins.where("rank = 1").select("entity", "block", "gap_from")
    ahead = heads.select("entity", "block", F.lead("gap_from").over(Window.partitionBy("entity").orderBy("block")).alias("ahead"))
    return begins.join(ahead, ["entity", "block"]).join(last, "entity").select("entity", F.col("gap_to").alias("start"), F.coalesce("next", "ahead", "last").alias("stop"))


def listing_intervals(listings: DataFrame, name) -> DataFrame:
    """Listings as intervals: listedAt to endedAt, else soldAt, else lastObservedAt, in epoch milliseconds; name: the entity's column."""
    stop = F.coalesce("endedAt", "soldAt", "lastObservedAt")
    return listings.select(name.alias("entity"), F.unix_millis(F.col("listedAt").cast("timestamp")).alias("start"), F.unix_millis(stop.cast("timestamp")).alias("stop"))
