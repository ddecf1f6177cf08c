"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000  # at most so many keys can each hold more than 1/HOT_KEYS of the rows


def join_counted(big: DataFrame, keyed: DataFrame, keys: list[str], count: str, least: int = 100_000, known: tuple[int, int] | None = None) -> DataFrame:
    """Inner join of ``big`` with ``keyed``, which has each key once and in ``count`` how many rows of ``big`` have it.

    A key is hot when it holds more than ``least`` rows and more than 1/HOT_KEYS of all rows, so there are fewer
    than HOT_KEYS hot keys whatever the input: that bound allows their broadcast. All other keys meet in a
    shuffle join of which no key is large. Without hot keys it is the plain join. Null keys match nothing.
    known: sum and maximum of ``count``, if the caller has them already (bounds from above will do).
    """
    total, most = known or keyed.agg(F.sum(count), F.max(count)).first()
    if not total or most <= max(least, total / HOT_KEYS):
        return big.join(keyed.drop(count), keys)
    limit = max(least, total / HOT_KEYS)
    hot = F.broadcast(keyed.where(F.col(count) > limit).drop(count))
    cold = keyed.where(F.col(count) <= limit).drop(count)
    rest = big.join(hot.select(*keys), keys, "left_anti")
    return big.join(hot, keys).unionByName(rest.join(cold, keys))
