"""Numeric expressions of predictions: bounds, logarithmic prices, blends, labels and shares."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_PRICE = 1e12  # fixed value: the highest price that is put out


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b, 0 unless b is positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def price_from_log(x: Column) -> Column:
    """The price of log(1 + price), between 0 and MOST_PRICE; 0 for null and what is no finite number."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.expm1(F.least(x, F.lit(math.log1p(MOST_PRICE)))))).otherwise(0.0)


def blend_weight(confidence: Column, scale: float) -> Column:
    return F.least(F.lit(max(0.0, scale)), F.greatest(confidence, F.lit(0.0)) * max(0.0, scale))


def blended(model: Column, comparable: Column, confidence: Column, scale: float) -> Column:
    """A model's price moved towards a comparable one in log(1 + price) by its confidence; as it is without a positive comparable price."""
    w = blend_weight(confidence, scale)
    return F.when((comparable > 0) & F.lit(scale > 0), price_from_log(F.log1p(model) * (1 - w) + F.log1p(comparable) * w)).otherwise(model)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.72, "high").when(score >= 0.42, "medium").otherwise("low")


def softmax(xs: Column, temperature: float = 1.0) -> Column:
    """Shares of an array by exp(x / temperature); with none above 0, all of it on the first maximum. Empty and null stay so."""
    top = F.array_max(xs)
    if temperature <= 0:
        at = F.array_position(xs, top) - 1
        return F.transform(xs, lambda x, i: F.when(i == at, 1.0).otherwise(0.0))
    e = F.transform(xs, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def standardized(xs: Column, means: list[float], deviations: list[float]) -> Column:
    """(x - mean) / deviation, element by element; deviations up to 1e-12 count as 1."""
    m, d = F.array(*map(F.lit, means)), F.array(*(F.lit(1.0 if s <= 1e-12 else s) for s in deviations))
    return F.zip_with(F.zip_with(xs, m, lambda x, a: x - a), d, lambda x, b: x / b)


def evidence_weight(confidence: Column, parser: Column, exact: Column) -> Column:
    """Weight of a sold record between 0.2 and 1: its grade, the parser it came from, and whether it has an exact time."""
    # fixed values: weights of grades and parsers
    graded = F.when(confidence == "high", 1.0).when(confidence == "medium", 0.75).when(confidence == "low", 0.4).otherwise(0.65)
    parsed = F.when(parser == "fragment-embedded-json", 0.9).when(parser == "fragment-text", 0.7).otherwise(1.0)
    return clamp(graded * parsed * F.when(exact, 1.0).otherwise(0.9), 0.2, 1.0)


def _product32(a: Column, b: Column) -> Column:
    """The low 32 bits of the product of two numbers below 2**32."""
    high = (a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF)) * 65536
    return (high + a * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(F.lit(0xFFFFFFFF))


def uniform(seed: int, n: Column) -> Column:
    """The n-th number (from 1) of the 32-bit generator whose state grows by a constant, in [0, 1): any row of a sequence by itself, without those before it."""
    # fixed values: the generator's step and shifts
    state = (F.lit(seed % 2**32) + _product32(n.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0x6D2B79F5))).bitwiseAND(F.lit(0xFFFFFFFF))
    mixed = lambda x, k: x.bitwiseXOR(F.shiftright(x, k))
    v = _product32(mixed(state, 15), state.bitwiseOR(F.lit(1)))
    v = (v + _product32(mixed(v, 7), v.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(v)
    return mixed(v, 14) / float(2**32)
