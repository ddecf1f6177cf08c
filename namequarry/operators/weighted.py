"""Quantiles, ranks, accuracy and survival as grouped DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namequarry.session import checkpointed


def running(df: DataFrame, by: list[str], order: str, *values: str) -> DataFrame:
    """``df`` with before and total of each value (``before_x`` and ``total_x`` where there are several): its sum over the rows of the group with a smaller ``order``, and over the whole group.

    ``order`` must be unique within a group. Rows are partitioned by range of (group, order), so that partitions have
    a size fit for a task whatever the table or group holds, and written once. Partitions are added up first (as many rows as there are partitions, for each group that reaches
    over several), then each runs by itself: neither a group nor the table is ordered in one task. An order of null comes first; null groups count as one.
    """
    ends = {v: ("before", "total") if len(values) == 1 else (f"before_{v}", f"total_{v}") for v in values}
    ranged = checkpointed(df.repartitionByRange(*by, order).withColumn("__bin", F.spark_partition_id()), "ranged")
    keys = by or ["__all"]
    rows = ranged if by else ranged.withColumn("__all", F.lit(0))
    sums = rows.groupBy(*keys, "__bin").agg(*(F.sum(v).alias(f"__s_{v}") for v in values))
    earlier, whole = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    sums = sums.select(*keys, "__bin", *(x for v, (b, t) in ends.items() for x in (F.coalesce(F.sum(f"__s_{v}").over(earlier), F.lit(0)).alias(f"__base_{v}"), F.coalesce(F.sum(f"__s_{v}").over(whole), F.lit(0)).alias(t))))
    inside = Window.partitionBy(*keys, "__bin").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"__in_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "__bin"]]
    out = rows.alias("l").join(sums.alias("r"), same)
    return out.select(*(F.col(f"l.{c}") for c in df.columns), *(x for v, (b, t) in ends.items() for x in ((F.col(f"__base_{v}") + F.col(f"__in_{v}")).alias(b), F.col(t))))


def _points(df: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """One row per (group, value) with the weight of ties added up, and cumulated weight ``c`` of total ``w``."""
    points = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("p"))
    return running(points, by, value, "p").withColumns({"c": F.col("before") + F.col("p"), "w": F.col("total")}).drop("before", "total")


def linear_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Exact quantiles (group, q_<percent>), interpolated on (n - 1) q, from counts of distinct values; no group is held in one place. Nulls are left out."""
    counts = running(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n")), by, value, "__n")
    at = lambda place: F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("__n")), F.col(value)))
    aggs = []
    for q in qs:
        place = (F.col("total") - 1) * q
        low, high = at(F.floor(place + 1e-9)), at(F.ceil(place - 1e-9))
        aggs.append((low + (high - low) * (F.max(place) - F.floor(F.max(place) + 1e-9))).alias(f"q_{round(100 * q)}"))
    return counts.groupBy(*by).agg(*aggs)


def step_quantile(df: DataFrame, by: list[str], value: str, weight: str, q: float) -> DataFrame:
    """The smallest value whose cumulated weight reaches q of the total. Groups without positive weight give no row."""
    return _points(df, by, value, weight).where(F.col("c") >= q * F.col("w") * (1 - 1e-12)).groupBy(*by).agg(F.min(value).alias("quantile"))


def midpoint_quantile(df: DataFrame, by: list[str], value: str, weight: str, qs: list[float]) -> DataFrame:
    """Weighted quantiles interpolated between the weight midpoints of neighbouring values; beyond the ends the ends hold.

    Columns q_<percent>. Ties are one point with their whole weight.
    """
    points = _points(df, by, value, weight).withColumn("at", (F.col("c") - F.col("p") / 2) / F.col("w"))
    point = F.struct("at", F.col(value).alias("v"))
    aggs = [x for i, q in enumerate(qs) for x in (F.max(F.when(F.col("at") < q, point)).alias(f"lo{i}"), F.min(F.when(F.col("at") >= q, point)).alias(f"hi{i}"))]
    ends = points.groupBy(*by).agg(*aggs)
    lo, hi = (lambda i: F.col(f"lo{i}")), (lambda i: F.col(f"hi{i}"))
    between = lambda i, q: lo(i)["v"] + (hi(i)["v"] - lo(i)["v"]) * (q - lo(i)["at"]) / (hi(i)["at"] - lo(i)["at"])
    return ends.select(*by, *(F.when(lo(i).isNull(), hi(i)["v"]).when(hi(i).isNull(), lo(i)["v"]).otherwise(between(i, q)).alias(f"q_{round(100 * q)}") for i, q in enumerate(qs)))


def effective_size(weight: Column) -> Column:
    return F.coalesce(F.try_divide(F.pow(F.sum(weight), 2), F.sum(weight * weight)), F.lit(0.0))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Fractional ranks over the whole table, ties sharing their mean rank. Distinct values are counted first, so the ordered pass is over values, not rows."""
    counts = running(df.groupBy(column).agg(F.count("*").alias("__n")), [], column, "__n")
    return df.join(counts.select(column, (F.col("before") + (F.col("__n") + 1) / 2).alias(out)), column)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation, 0 where either side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), F.lit(0.0))


def accuracy(df: DataFrame, by: list[str], actual: str, predicted: str) -> DataFrame:
    """n, rmsle, mean absolute log error, median factor error, shares within factors 2 and 3. Both columns must be positive."""
    a, p = F.col(actual), F.col(predicted)
    gap = F.abs(F.ln(p / a))
    rows = df.where((a > 0) & (p > 0)).withColumn("__gap", gap)
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.log1p(p) - F.log1p(a), 2))).alias("rmsle"), F.avg(F.abs(F.log1p(p) - F.log1p(a))).alias("male"),
        F.avg((gap <= F.ln(F.lit(2.0)) + 1e-12).cast("double")).alias("within2x"), F.avg((gap <= F.ln(F.lit(3.0)) + 1e-12).cast("double")).alias("within3x"),
    )
    return sums.join(linear_quantiles(rows, by, "__gap", [0.5]), by).withColumn("median_factor", F.exp("q_50")).drop("q_50")


def tail_recall(df: DataFrame, by: list[str], actual: str, predicted: str, share: float) -> DataFrame:
    """Recall of the top ``share`` by actual among the top by predicted; ties at either cutoff share the places left.

    Cutoffs come from counts per value, so no group is sorted whole in one row.
    """
    size = df.groupBy(*by).agg(F.count("*").alias("n")).withColumn("k", F.greatest(F.ceil(F.col("n") * share), F.lit(1)))

    def credit(column: str) -> DataFrame:
        counts = running(df.groupBy(*by, column).agg(F.count("*").alias("at")), by, column, "at").join(size, by)
        above = F.col("total") - F.col("before") - F.col("at")
        return counts.select(*by, column, "k", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("k") - above) / F.col("at"))).alias(f"w_{column}"))

    rows = df.join(credit(actual).drop("k"), [*by, actual]).join(credit(predicted), [*by, predicted])
    return rows.groupBy(*by).agg(F.max("k").alias("selected"), (F.sum(F.col(f"w_{actual}") * F.col(f"w_{predicted}")) / F.max("k")).alias("recall"))


def sale_curve(df: DataFrame, by: list[str], duration: str, event: str, weight: str) -> DataFrame:
    """Aalen-Johansen curve of competing risks: (group, duration, at_risk, cumulative).

    event: sale, competing, or anything else for censored. Rows are added up per (group, duration) first; what is at
    risk is a running sum from the end; survival is the running product of 1 - hazard, taken as a sum of
    logarithms up to the first time at which nothing survives and 0 after it.
    """
    w = F.col(weight)
    sums = df.where(F.col(duration).isNotNull() & (w > 0)).groupBy(*by, duration).agg(
        F.sum(w).alias("all"), F.sum(F.when(F.col(event) == "sale", w).otherwise(0.0)).alias("sale"), F.sum(F.when(F.col(event) == "competing", w).otherwise(0.0)).alias("other"),
    )
    down = Window.partitionBy(*by).orderBy(F.desc(duration)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("at_risk", F.sum("all").over(down)).where(F.col("sale") + F.col("other") > 0)
    keep = F.greatest(1 - (F.col("sale") + F.col("other")) / F.col("at_risk"), F.lit(0.0))
    sums = sums.withColumn("keep", F.when(keep > 1e-12, keep).otherwise(0.0))
    before = Window.partitionBy(*by).orderBy(duration).rowsBetween(Window.unboundedPreceding, -1)
    gone = F.coalesce(F.max((F.col("keep") == 0).cast("int")).over(before), F.lit(0))
    alive = F.exp(F.coalesce(F.sum(F.when(F.col("keep") > 0, F.ln("keep"))).over(before), F.lit(0.0)))
    sums = sums.withColumn("step", F.when(gone == 1, 0.0).otherwise(alive) * F.col("sale") / F.col("at_risk"))
    upto = Window.partitionBy(*by).orderBy(duration).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sums.select(*by, duration, "at_risk", F.least(F.sum("step").over(upto), F.lit(1.0)).alias("cumulative"))


def tie_aware_bins(df: DataFrame, score: str, bins: int) -> DataFrame:
    """(score, n, bin): bins of about equal numbers of rows over the whole table that never split equal scores; none is empty.

    A bin takes distinct scores in order until it has its share of the rows from there on, and leaves each bin after it one
    score at least. Counts and running totals by score are written once; each of the few edges is then found by one small aggregation.
    """
    counts = df.groupBy(score).agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    placed = running(counts, [], score, "n", "one").withColumnsRenamed({"before_n": "rows_before", "total_n": "rows", "before_one": "place", "total_one": "scores"})
    placed = checkpointed(placed.drop("one"), "score-counts")
    size = placed.agg(F.max("rows"), F.max("scores")).first()
    edges, start = [], 0  # the place of the first score of each bin after the first
    for b in range(min(max(1, bins), size[1] or 1) - 1):
        left = min(bins, size[1]) - b
        here = placed.where((F.col("place") >= (edges[-1] if edges else 0)) & (F.col("scores") - F.col("place") - 1 >= left - 1))
        full = F.col("rows_before") + F.col("n") - start >= F.ceil((F.col("rows") - F.col("rows_before")) / left)
        end = here.where(full).agg(F.min(F.struct("place", (F.col("rows_before") + F.col("n")).alias("upto")))).first()[0]
        if end is None:
            break
        edges.append(end["place"] + 1)
        start = end["upto"]
    bin_no = sum((F.col("place") >= e).cast("int") for e in edges) if edges else F.lit(0)
    return placed.select(score, "n", bin_no.cast("int").alias("bin"))


def median_duration(curve: DataFrame, by: list[str], duration: str) -> DataFrame:
    """(group, median): the first point of a ``sale_curve`` at which half are sold; null where the curve never gets there."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("cumulative") >= 0.5 - 1e-12, F.col(duration))).alias("median"))
