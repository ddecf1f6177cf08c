"""Linear and tree models over DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _normal(df: DataFrame, features: list[str], target: str, weight) -> tuple[np.ndarray, np.ndarray]:
    """X'WX and X'Wy with an intercept, in one aggregation: (d+1)(d+4)/2 sums, whatever the rows."""
    cols = [F.lit(1.0), *(F.col(f) for f in features)]
    d, y = len(cols), F.col(target)
    sums = [F.sum(weight * cols[i] * cols[j]) for i in range(d) for j in range(i, d)] + [F.sum(weight * c * y) for c in cols]
    row = [float(x or 0.0) for x in df.agg(*sums).first()]
    gram, at = np.zeros((d, d)), 0
    for i in range(d):
        for j in range(i, d):
            gram[i, j] = gram[j, i] = row[at]
            at += 1
    return gram, np.array(row[at:])


_BINS, _FEW = 4_096, 20_000  # ranges that are counted at once; values that are sorted at once


def median(df: DataFrame, value: Column) -> float | None:
    """The exact median, the mean of the two middle values of an even number: what percentile(value, 0.5) gives, without holding the distinct values.

    The range that holds the middle is cut into _BINS parts and counted, until it holds few values or one.
    """
    values = df.select(value.cast("double").alias("v")).where("v is not null")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    if not np.isfinite([low, high]).all():
        return float(values.agg(F.percentile("v", F.lit(0.5))).first()[0])
    middle, below, inside = ((n - 1) // 2, n // 2), 0, n
    while low < high:
        within = values.where(F.col("v").between(low, high))
        if inside <= _FEW:
            found = sorted(r[0] for r in within.collect())
            return (found[middle[0] - below] + found[middle[1] - below]) / 2
        width = max(high / _BINS - low / _BINS, 5e-324)
        part = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(_BINS - 1))
        bins = sorted(within.groupBy(part.alias("part")).agg(F.count("*"), F.min("v"), F.max("v")).collect())
        ends = np.cumsum([r[1] for r in bins]) + below
        first, last = (int(np.searchsorted(ends, m, "right")) for m in middle)
        if first < last:  # the middle lies between two ranges
            return (bins[first][3] + bins[last][2]) / 2
        below, inside, (low, high) = int(ends[first]) - bins[first][1], bins[first][1], bins[first][2:]
    return low


def ridge(df: DataFrame, features: list[str], target: str, penalty: float = 1.0, huber: int = 0) -> np.ndarray:
    """Intercept and coefficients; ``huber`` rounds of reweighting at 1.345 robust deviations (1.4826 times the median absolute residual). Rows with nulls are left out.

    ``df`` is read once, and some five times more a round: a long way to it is best cut before.
    """
    rows = df.dropna(subset=[*features, target])
    weight, beta = F.lit(1.0), None
    for left in range(huber, -1, -1):
        gram, right = _normal(rows, features, target, weight)
        gram[np.diag_indices(len(gram))] += np.array([0.0] + [penalty] * len(features))
        beta = np.linalg.lstsq(gram, right, rcond=None)[0]
        if not left:
            break
        residual = F.abs(F.col(target) - predicted(beta, features))
        scale = 1.4826 * (median(rows, residual) or 0.0) + 1e-12
        weight = F.least(F.lit(1.0), F.lit(1.345 * scale) / F.greatest(residual, F.lit(1e-12)))
    return beta


def predicted(beta: np.ndarray, features: list[str]):
    """The linear prediction as a column."""
    out = F.lit(float(beta[0]))
    for b, f in zip(beta[1:], features):
        out = out + F.lit(float(b)) * F.col(f)
    return out


def tail_scores(df: DataFrame, features: list[str], price: str, thresholds: tuple[float, ...] = (100.0, 1000.0, 10000.0), penalty: float = 32.0) -> dict[float, np.ndarray]:
    """Per threshold the ridge on the indicator price > threshold, without reweighting."""
    out = {}
    for t in thresholds:
        out[t] = ridge(df.dropna(subset=[price]).withColumn("__tail", (F.col(price) > t).cast("double")), features, "__tail", penalty)
    return out


def boosted(df: DataFrame, features: list[str], target: str, rounds: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 7) -> tuple[VectorAssembler, GBTRegressionModel]:
    """Gradient boosted trees with squared loss."""
    vector = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    model = GBTRegressor(featuresCol="features", labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8, seed=seed).fit(vector.transform(df))
    return vector, model
