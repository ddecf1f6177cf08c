"""Sources mixed to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namequarry.session import work_dir, written

SLOTS = 20_000  # blocks of a whole mix: bounds the schedule, and the deviation to 1/SLOTS of the mix
PER_BIN = 100_000_000  # tokens of a source that one bin sorts, about


def pfair_schedule(weights: dict[str, float], slots: int) -> list[tuple[int, str, int]]:
    """(slot, source, block): which block of which source each slot takes.

    Block j of a source of weight w is released at floor(j / w) and due at ceil((j + 1) / w); of the released blocks
    the one due first goes (ties by source). With weights that add up to 1 every block is in time, so each source
    stays within one block of its share at any point of the mix.
    """
    exact = {s: Fraction(w).limit_denominator(10**9) for s, w in weights.items() if w > 0}  # 0.05 is one in twenty, so that deadlines aren't a slot off
    share = {s: w / sum(exact.values()) for s, w in exact.items()}
    waiting = [(0, s, 0) for s in share]
    ready: list[tuple[int, str, int]] = []
    out = []
    heapq.heapify(waiting)
    for slot in range(slots if share else 0):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((j + 1) / share[s]), s, j))
        if not ready:
            continue
        _, s, j = heapq.heappop(ready)
        out.append((slot, s, j))
        heapq.heappush(waiting, (math.floor((j + 1) / share[s]), s, j + 1))
    return out


def _placed(sized: DataFrame, bins_of: dict[str, int]) -> DataFrame:
    """``sized`` with ``at``: the tokens before each document in its source's fixed shuffled order.

    Prefix sums in two steps: sums of (source, bin) are few (a source has bins by its tokens), then each bin adds up its own, so a
    source with most of the rows is spread over all its bins, and no bin grows with the corpus.
    """
    order = F.xxhash64("doc_id")
    n_bins = F.create_map(*(F.lit(x) for pair in bins_of.items() for x in pair)) if bins_of else F.create_map().cast("map<string,int>")
    rows = sized.withColumns({"order": order, "bin": F.pmod(order, n_bins[F.col("source")]).cast("int")})
    bins = rows.groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("source", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bin").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(bins, ["source", "bin"]).select("doc_id", "source", "n_tokens", (F.col("base") + F.col("within")).alias("at"))


class Mix:
    """A mix of ``sized`` (doc_id, source, n_tokens) to ``targets`` (source, target_weight, max_repeats).

    total: tokens of the mix. ``corpus``, which the queries use, is all tokens of the target sources; sources too small
    for their target then fall short, and ``shares`` says by how much. None is the largest total at which every source
    that has tokens reaches its target: the smallest source sets the size of the whole mix then. A source gives target_weight x total, or max_repeats times all it
    has if that is less; a source without tokens gives nothing. Documents of sources
    that aren't in targets, and of no source, are left out; documents of 0 tokens are never needed. Targets are few
    (one row a source) and come to the driver with their sums.
    """

    def __init__(self, sized: DataFrame, targets: DataFrame, total: int | str | None = None, slots: int = SLOTS):
        spark: SparkSession = sized.sparkSession
        self.spark = spark
        known = sized.where("n_tokens > 0").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
        self.sized = written(known.select("doc_id", "source", "n_tokens"), work_dir(spark, "mix-sized"))
        have = {r[0]: r[1] for r in self.sized.groupBy("source").agg(F.sum("n_tokens")).collect()}
        self.rows = [(r["source"], r["target_weight"] or 0.0, r["max_repeats"] or 0, have.get(r["source"], 0)) for r in targets.where("source is not null").collect()]
        full = [cap * n / w for _, w, cap, n in self.rows if w > 0 and cap > 0 and n > 0]
        self.total = math.floor(min(full, default=0)) if total is None else sum(have.values()) if total == "corpus" else total
        self.quota = {s: min(math.floor(w * self.total), cap * n) for s, w, cap, n in self.rows}
        self.slots = slots

    def sequence(self) -> DataFrame:
        """(doc_id, source, copy, n_tokens, slot, at): every use of a document and its place in the mix.

        Copy k of a source's pass holds the same order, so no document is used more than max_repeats times. A use
        belongs to the mix if at least half of it lies within its source's quota. Slots order the mix, and within a slot
        ``at``, the tokens of its source before it.
        """
        plan = [(s, q, n) for (s, _, _, n) in self.rows if (q := self.quota[s]) > 0]
        schema = "source string, quota bigint, have bigint"
        placed = _placed(self.sized, {s: 16 + n // PER_BIN for s, _, n in plan}).join(F.broadcast(self.spark.createDataFrame(plan, schema)), "source")
        passes = F.floor((F.col("quota") + F.col("have") - 1) / F.col("have")).cast("int")
        uses = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), passes - 1))).withColumn("at", F.col("at") + F.col("copy") * F.col("have"))
        uses = uses.where(F.col("at") + F.col("n_tokens") / 2 <= F.col("quota"))
        # equal blocks of the mix; a source's blocks come in its own order of tokens
        size = max(1.0, sum(self.quota.values()) / self.slots)
        schedule = pfair_schedule({s: float(q) for s, q in self.quota.items()}, self.slots)
        last = {s: j for _, s, j in schedule}
        known = self.spark.createDataFrame(schedule, "slot bigint, source string, block bigint")
        ends = F.create_map(*(x for s, j in last.items() for x in (F.lit(s), F.lit(j)))) if last else F.create_map().cast("map<string,int>")
        uses = uses.withColumn("block", F.least(F.floor(F.col("at") / size), ends[F.col("source")].cast("bigint")))
        return uses.join(F.broadcast(known), ["source", "block"]).select("doc_id", "source", "copy", "n_tokens", "slot", "at")

    def shares(self) -> DataFrame:
        """(source, target_weight, max_repeats, source_tokens, mixed_tokens, uses, most_repeats, short_tokens, actual_share): one row per target.

        short_tokens: what the source lacks for target_weight x total even with all its repeats; 0 if it isn't capped.
        """
        used = self.sequence().groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("k")).groupBy("source").agg(F.sum("t").alias("mixed_tokens"), F.sum("k").alias("uses"), F.max("k").alias("most_repeats"))
        targets = self.spark.createDataFrame([(s, w, cap, n, math.floor(w * self.total) - self.quota[s]) for s, w, cap, n in self.rows], "source string, target_weight double, max_repeats int, source_tokens bigint, short_tokens bigint")
        out = targets.join(used, "source", "left").fillna(0, ["mixed_tokens", "uses", "most_repeats"])
        whole = F.sum("mixed_tokens").over(Window.partitionBy())
        return out.withColumn("actual_share", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0))
