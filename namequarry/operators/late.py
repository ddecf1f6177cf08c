"""Per-period aggregates by event time, corrected as late rows arrive, up to a cut-off."""

from __future__ import annotations

import json
import uuid
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namequarry.functions.instants import DAY_MS, utc_day
from namequarry.session import Files, work_dir

CUT_OFF_MS = 72 * 3_600_000


def fate(event_ms: Column, observed_ms: Column, cut_off_ms: int = CUT_OFF_MS) -> Column:
    """``on_time`` if observed before the end of the UTC day of the event, ``late`` before that plus the cut-off, else ``too_late``."""
    end = (F.floor(event_ms / DAY_MS) + 1) * DAY_MS
    return F.when(observed_ms < end, "on_time").when(observed_ms < end + cut_off_ms, "late").otherwise("too_late")


_RAW = "row_id bigint, entity string, event_day int, event_ms bigint, observed_ms bigint, month int"
_KEPT = "entity string, event_day int, events bigint, late_events bigint, row_id bigint, fate string"


class CorrectedCounts:
    """Counts per (entity, UTC day) that late rows correct, kept in the shared folder.

    ``ingest`` appends a batch to the retained raw rows, finds the periods (UTC days) that its admissible
    rows touch, recomputes those periods entirely from the retained rows (their counts, and which rows came late) and
    swaps them in by replacing one small manifest, which names the version of every day, so readers see either all old or all new. Rows that came after
    the cut-off are retained and put down as too late, but touch no period and are never counted.

    Raw rows lie in folders by month, ordered by day in each file, so a recomputation reads the row groups of its days. A
    version is one table; a day's old rows in it are passed over by the manifest, which the calendar bounds.
    A batch that failed can be taken in again; one that succeeded under a ``label`` is not taken in twice.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, cut_off_ms: int = CUT_OFF_MS):
        self.spark, self.path, self.cut_off_ms = spark, path or work_dir(spark, "late"), cut_off_ms
        self.files = Files(spark, self.path)

    def _manifest(self) -> dict:
        at = f"{self.path}/manifest.json"
        return json.loads(self.files.read(at)) if self.files.exists(at) else {"batches": [], "versions": [], "days": {}, "labels": []}

    def ingest(self, rows: DataFrame, label: str | None = None) -> list[int]:
        """rows: (row_id bigint, entity string, event_ms bigint, observed_ms bigint); those without both instants can't be placed and are left out. Gives the days recomputed, as days since 1970."""
        held = self._manifest()
        if label is not None and label in held["labels"]:
            return []
        name = uuid.uuid4().hex  # used once: what a failed run left is never in the way
        placed = rows.where("event_ms is not null and observed_ms is not null").select("row_id", "entity", utc_day(F.col("event_ms")).alias("event_day"), "event_ms", "observed_ms")
        day = F.date_from_unix_date("event_day")
        placed = placed.withColumn("month", F.year(day) * 12 + F.month(day) - 1)
        # rebalance keeps a month in few files, and splits one that holds much of the batch
        placed.hint("rebalance", "month").sortWithinPartitions("month", "event_day").write.partitionBy("month").parquet(f"{self.path}/raw/batch={name}")
        batches = [*held["batches"], f"raw/batch={name}"]
        late = fate(F.col("event_ms"), F.col("observed_ms"), self.cut_off_ms)
        touched = sorted(r[0] for r in self._raw(batches[-1:]).where(late != "too_late").select("event_day").distinct().collect())  # one row per calendar day
        months = sorted({(d.year * 12 + d.month - 1) for d in map(lambda n: date(1970, 1, 1) + timedelta(n), touched)})
        whole = self._raw(batches).where(F.col("month").isin(months) & F.col("event_day").isin(touched)).withColumn("fate", late).where("fate <> 'too_late'")
        counts = whole.groupBy("entity", "event_day").agg(F.count("*").alias("events"), F.count_if(F.col("fate") == "late").alias("late_events"))
        found = whole.where("fate = 'late'").select("entity", "event_day", "row_id", "fate")
        refused = self._raw(batches[-1:]).withColumn("fate", late).where("fate = 'too_late'").select("entity", "event_day", "row_id", "fate")
        parts = {"counts": counts, "late": found, "refused": refused}
        version = None
        for part, df in parts.items():
            df = df.withColumn("part", F.lit(part))
            version = df if version is None else version.unionByName(df, allowMissingColumns=True)
        version.write.partitionBy("part").parquet(f"{self.path}/periods/version={name}")
        days = held["days"] | {str(d): name for d in touched}
        self.files.put(f"{self.path}/manifest.json", json.dumps({"batches": batches, "versions": [*held["versions"], name], "days": days, "labels": [*held["labels"], *([label] if label is not None else [])]}))
        return touched

    def _raw(self, batches: list[str]) -> DataFrame:
        return self.spark.read.schema(_RAW + ", batch string").option("basePath", f"{self.path}/raw").parquet(*(f"{self.path}/{b}" for b in batches)).drop("batch") if batches else self.spark.createDataFrame([], _RAW)

    def _part(self, part: str, current: bool = True) -> DataFrame:
        """One part of all versions, in one read; of current days only, which a join with the manifest's days (bounded by the calendar) tells."""
        held = self._manifest()
        paths = [p for v in held["versions"] if self.files.exists(p := f"{self.path}/periods/version={v}/part={part}")]
        if not paths:
            return self.spark.createDataFrame([], _KEPT)
        rows = self.spark.read.schema(_KEPT + ", version string, part string").option("basePath", f"{self.path}/periods").parquet(*paths)
        if current:
            days = self.spark.createDataFrame([(int(d), v) for d, v in held["days"].items()], "event_day int, version string")
            rows = rows.join(F.broadcast(days), ["event_day", "version"])
        return rows.drop("version", "part")

    def raw(self) -> DataFrame:
        """The retained rows: row_id, entity, event_day, event_ms, observed_ms."""
        return self._raw(self._manifest()["batches"]).drop("month")

    def counts(self) -> DataFrame:
        """The current counts: entity, event_day, events, late_events."""
        return self._part("counts").select("entity", "event_day", "events", "late_events")

    def late_rows(self) -> DataFrame:
        """Rows that came after the end of their day: entity, event_day, row_id, fate. The late ones are those of the periods as last recomputed."""
        return self._part("late").unionByName(self._part("refused", current=False)).select("entity", "event_day", "row_id", "fate")
