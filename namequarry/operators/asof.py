"""As-of joins and running aggregates over strictly earlier rows, balanced for hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namequarry.operators.weighted import running


def _blocks(df: DataFrame, t: str, block: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(t) / block))


def asof_join(targets: DataFrame, facts: DataFrame, key: str, t: str, values: list[str], block: int) -> DataFrame:
    """Each target with the ``values`` of the last fact of its key strictly before its time, null if there is none.

    One union and one ordered pass per (key, block of time) instead of a range join: nothing is multiplied, and a hot
    key is spread over its blocks. What a block inherits comes from one summary row per (key, block). Facts at the
    same time are ordered by their values; facts with a null key or time are left out, targets keep all their rows.
    t: bigint column; block: its length in the same unit.
    """
    facts = facts.where(F.col(key).isNotNull() & F.col(t).isNotNull())
    payload = F.struct(*(F.col(v) for v in values))
    f = _blocks(facts.select(key, t, F.lit(True).alias("__fact"), payload.alias("__value")), t, block)
    rest = [c for c in targets.columns if c not in (key, t)]
    held = _blocks(targets.select(key, t, F.lit(False).alias("__fact"), F.struct(*(F.col(c) for c in rest)).alias("__row") if rest else F.lit(None).alias("__row")), t, block)
    both = f.unionByName(held, allowMissingColumns=True)
    # targets come before facts of the same time, so those stay unseen
    inside = Window.partitionBy(key, "__block").orderBy(t, F.col("__fact").cast("int"), "__value").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("__seen", F.last("__value", ignorenulls=True).over(inside))
    summary = f.groupBy(key, "__block").agg(F.max(F.struct(t, "__value")).alias("__last"))
    marks = summary.unionByName(held.select(key, "__block").distinct(), allowMissingColumns=True).groupBy(key, "__block").agg(F.max("__last").alias("__last"))
    earlier = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.select(F.col(key).alias("__k"), F.col("__block").alias("__b"), F.last("__last", ignorenulls=True).over(earlier)["__value"].alias("__carry"))
    out = both.where(~F.col("__fact")).join(carry, F.col(key).eqNullSafe(F.col("__k")) & F.col("__block").eqNullSafe(F.col("__b")), "left").withColumn("__v", F.coalesce("__seen", "__carry"))
    return out.select(key, t, *(F.col("__row")[c].alias(c) for c in rest), *(F.col("__v")[v].alias(v) for v in values))


def running_before(df: DataFrame, key: list[str], t: str, value: Column) -> DataFrame:
    """``df`` with n_before and sum_before: count and sum of ``value`` over the rows of the key with a strictly smaller time.

    Equal times see the same: rows are counted and added up by (key, time) first, and ``running`` totals of those, which
    no hot key and no number of rows gathers in one task, are joined back. Null values count in neither.
    """
    rows = df.withColumn("__v", value)
    sums = rows.groupBy(*key, t).agg(F.count("__v").alias("__n"), F.coalesce(F.sum("__v"), F.lit(0.0)).alias("__s"))
    totals = running(sums, key, t, "__n", "__s").select(*(F.col(c).alias(f"__k_{c}") for c in [*key, t]), F.col("before___n").alias("n_before"), F.col("before___s").cast("double").alias("sum_before"))
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in [*key, t]]
    return rows.drop("__v").join(totals, same).drop(*(f"__k_{c}" for c in [*key, t]))
