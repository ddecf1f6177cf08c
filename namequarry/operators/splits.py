"""Seeded splits into cohorts, of rows, of whole groups and in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namequarry.functions.identity import tie_breaker

ORDER = ("test", "calibration", "stacker", "validation", "train")


def hashed_cohort(key: Column, seed: int, shares: dict[str, float]) -> Column:
    """The cohort of a key by its seeded hash: shares hold in expectation, no row meets another. The rest is ``train``."""
    place = F.conv(F.substring(tie_breaker(key, seed), 1, 12), 16, 10).cast("double") / float(16**12)
    out, upto = F.when(F.lit(False), F.lit("")), 0.0
    for name, share in shares.items():
        upto += share
        out = out.when(place < upto, name)
    return out.otherwise("train")


def group_cohorts(rows: DataFrame, group: str, seed: int, shares: dict[str, float]) -> DataFrame:
    """(group, n, cohort): whole groups dealt out in a seeded order until each cohort has its share of the rows; the rest is ``train``.

    Group sizes are counted first. The running total is over groups in bins of their hash: sums per bin, then within
    the bin, so no task orders all groups. A group goes where its first row falls. Null is a group of its own.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("n")).withColumn("place", tie_breaker(F.coalesce(F.col(group).cast("string"), F.lit("\u0000")), seed))
    sizes = sizes.withColumn("bin", F.substring("place", 1, 2))
    bins = sizes.groupBy("bin").agg(F.sum("n").alias("bn"))
    bins = bins.select("bin", F.coalesce(F.sum("bn").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("bn").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("bin").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(bins), "bin")  # 256 bins
    before, cohort, upto = (F.col("base") + F.col("within")) / F.col("total"), F.when(F.lit(False), F.lit("")), 0.0
    for name, share in shares.items():
        upto += share
        cohort = cohort.when(before < upto - 1e-12, name)
    return sizes.select(group, "n", cohort.otherwise("train").alias("cohort"))


def temporal_cohorts(rows: DataFrame, group: str, t: str, cuts: list) -> DataFrame:
    """(group, first, n, cohort): groups by the time of their first row; cohort i starts at cuts[i]. Rows of a group that come at or after
    the next cut are counted in ``excluded``, so that no earlier cohort sees a later one's time."""
    agg = rows.groupBy(group).agg(F.min(t).alias("first"), F.count("*").alias("n"), *(F.count_if(F.col(t) >= F.lit(c)).alias(f"from_{i}") for i, c in enumerate(cuts)))
    cohort, excluded = F.lit(len(cuts)), F.lit(0)
    for i in reversed(range(len(cuts))):
        cohort = F.when(F.col("first") < F.lit(cuts[i]), i).otherwise(cohort)
        excluded = F.when(F.col("first") < F.lit(cuts[i]), F.col(f"from_{i}")).otherwise(excluded)
    return agg.select(group, "first", "n", cohort.alias("cohort"), excluded.alias("excluded"))
