"""Residual bins and monotone calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namequarry.operators.weighted import linear_quantiles, running, tie_aware_bins


def residual_bins(df: DataFrame, score: str, residual: str, bins: int) -> DataFrame:
    """Per tie-aware bin of the score: its largest score, rows, and finite-sample 10 % and 90 % and plain 50 % quantiles of the residual.

    The finite-sample rank is floor((n+1)p) below one half and ceil above, within 1..n.
    """
    placed = df.join(tie_aware_bins(df, score, bins).select(score, "bin"), score)
    counts = running(placed.groupBy("bin", residual).agg(F.count("*").alias("__n")), ["bin"], residual, "__n")
    lo = F.greatest(F.lit(1), F.floor((F.col("total") + 1) * 0.1 + 1e-9))
    hi = F.least(F.col("total"), F.ceil((F.col("total") + 1) * 0.9 - 1e-9))
    at = lambda rank: F.max(F.when((F.col("before") < rank) & (rank <= F.col("before") + F.col("__n")), F.col(residual)))
    ends = counts.groupBy("bin").agg(at(lo).alias("p10"), at(hi).alias("p90"))
    middle = linear_quantiles(placed, ["bin"], residual, [0.5]).withColumnRenamed("q_50", "p50")
    return placed.groupBy("bin").agg(F.max(score).alias("max_score"), F.count("*").alias("n")).join(ends, "bin").join(middle, "bin").select("bin", "max_score", "n", "p10", "p50", "p90")


def lookup_bin(df: DataFrame, score: str, bins: DataFrame) -> DataFrame:
    """Each row with the first bin whose largest score is at least its own, else the last. bins: a few rows, brought to the plan as a literal."""
    edges = [(r["max_score"], r["bin"]) for r in bins.select("max_score", "bin").orderBy("max_score").collect()]  # at most the number of bins asked for
    out = F.when(F.lit(False), F.lit(0))
    for top, b in edges[:-1]:
        out = out.when(F.col(score) <= top, F.lit(b))
    return df.withColumn("bin", out.otherwise(F.lit(edges[-1][1] if edges else None)))


def monotone(bins: list[tuple[float, float]]) -> list[float]:
    """Pool adjacent violators: (weight, mean) in order of score become non-decreasing means."""
    blocks: list[list[float]] = []
    for weight, mean in bins:
        blocks.append([weight, mean, 1])
        while len(blocks) > 1 and blocks[-2][1] > blocks[-1][1]:
            w, m, n = blocks.pop()
            total = blocks[-1][0] + w
            blocks[-1] = [total, (blocks[-1][0] * blocks[-1][1] + w * m) / total, blocks[-1][2] + n]
    return [m for _, m, n in blocks for _ in range(int(n))]


def confidence(df: DataFrame, score: str, hit: str) -> DataFrame:
    """(bin, max_score, n, probability): how often rows of a bin of the score hit (0 or 1), made non-decreasing in the score.

    2 to 6 tie-aware bins, one for each hundred rows; no row under 80 rows. Pooled bins keep their rows and have one probability.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(hit).isNotNull())
    n = rows.count()
    placed = rows.join(tie_aware_bins(rows, score, min(6, max(2, n // 100))).select(score, "bin"), score)
    bins = placed.groupBy("bin").agg(F.max(score).alias("max_score"), F.count("*").alias("n"), F.avg(hit).alias("mean")).orderBy("bin").collect() if n >= 80 else []  # at most six
    made = monotone([(b["n"], b["mean"]) for b in bins])
    return df.sparkSession.createDataFrame([(b["bin"], b["max_score"], b["n"], float(p)) for b, p in zip(bins, made)], "bin int, max_score double, n bigint, probability double")


def quantile_thresholds(df: DataFrame, column: str, bins: int) -> list[float]:
    """Upper ends of at most ``bins`` bins of equal counts: at each split the largest value before it, unless the next is the same. At most bins - 1 numbers."""
    counts = running(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n")), [], column, "__n")
    place = lambda b: F.floor(F.lit(b) * F.col("total") / bins)
    # a split between two values: the one that ends just there
    ends = counts.agg(*(F.max(F.when((F.col("before") + F.col("__n") == place(b)) & (place(b) < F.col("total")), F.col(column))).alias(f"t{b}") for b in range(1, bins))).first()
    return sorted({v for v in ends if v is not None}) if ends else []


def threshold_bin(x, thresholds: list[float]):
    """The number of thresholds below a value: the bin it is in."""
    return F.size(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t < x)) if thresholds else F.lit(0)
