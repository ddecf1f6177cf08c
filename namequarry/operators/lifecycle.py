"""Listing lifecycles from sequences of market events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPENING, ENDING = ("listed",), ("sale", "expired", "cancelled", "transfer")


def listings(events: DataFrame, asset: str, at: str, kind: str, tie: str) -> DataFrame:
    """Listings of one market: (asset, listed_at, price, ended_at, ended_by, state).

    Events of an asset are ordered by (at, tie); tie must be unique. A listing ends with the next event that lists or
    ends: ``repriced`` if that lists again, else ``ended``; without one it is ``open``. Bids and other kinds don't
    end anything. Only lead over the asset's events is needed. Events without asset or time are left out.
    """
    moves = events.where(F.col(asset).isNotNull() & F.col(at).isNotNull() & F.col(kind).isin(*OPENING, *ENDING))
    order = Window.partitionBy(asset).orderBy(at, tie)
    moves = moves.withColumns({"ended_at": F.lead(at).over(order), "ended_by": F.lead(kind).over(order)})
    state = F.when(F.col("ended_by").isNull(), "open").when(F.col("ended_by").isin(*OPENING), "repriced").otherwise("ended")
    return moves.where(F.col(kind).isin(*OPENING)).select(asset, F.col(at).alias("listed_at"), "price", "ended_at", "ended_by", state.alias("state"))


def unmatched_endings(events: DataFrame, asset: str, at: str, kind: str, tie: str) -> DataFrame:
    """Ending events of an asset that no open listing precedes."""
    moves = events.where(F.col(asset).isNotNull() & F.col(at).isNotNull() & F.col(kind).isin(*OPENING, *ENDING))
    before = F.lag(kind).over(Window.partitionBy(asset).orderBy(at, tie))
    return moves.withColumn("before", before).where(F.col(kind).isin(*ENDING) & ~F.coalesce(F.col("before").isin(*OPENING), F.lit(False))).drop("before")


def stream_listings(events: DataFrame, asset: str = "asset") -> DataFrame:
    """The same lifecycle over a stream of (asset string, at timestamp, kind string, price double, tie bigint): closed listings as they close.

    State per asset is the open listing alone (its time, tie and price). Each micro-batch is ordered by (at, tie);
    a move older than the open listing's is late and ignored. Listings still open stay in the state.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, tie, price = state.get if state.exists else (None, None, None)
        moves = pd.concat(list(batches)).sort_values(["at", "tie"])
        out = []
        for m in moves[moves["kind"].isin([*OPENING, *ENDING])].itertuples():
            now = int(m.at.value // 1000)
            if at is not None and (now, m.tie) < (at, tie):
                continue
            if at is not None:
                out.append((key[0], pd.Timestamp(at * 1000), price, m.at, m.kind, "repriced" if m.kind in OPENING else "ended"))
                at = None
            if m.kind in OPENING:
                at, tie, price = now, int(m.tie), None if pd.isna(m.price) else float(m.price)
        if at is None:
            state.remove()
        else:
            state.update((at, tie, price))
        yield pd.DataFrame(out, columns=["asset", "listed_at", "price", "ended_at", "ended_by", "state"])

    keyed = events.where(F.col(asset).isNotNull() & F.col("at").isNotNull())
    return keyed.groupBy(asset).applyInPandasWithState(
        step, "asset string, listed_at timestamp, price double, ended_at timestamp, ended_by string, state string", "at bigint, tie bigint, price double", "append", "NoTimeout",
    )


def status_at(valuation: Column) -> Column:
    """What a listing (listedAt, lastObservedAt, soldAt, endedAt, status) was known to be at a time: struct (event, through).

    Ends in the future are unknown: the listing is censored at the valuation, or when last seen if that is earlier.
    Null where it wasn't listed yet or its times are impossible.
    """
    end = F.when(F.col("status") == "sold", F.coalesce("soldAt", "endedAt")).when(F.col("status").isin("expired", "cancelled"), F.col("endedAt"))
    known = end.isNotNull() & (end <= valuation)
    through = F.when(known, end).otherwise(F.least(F.coalesce("lastObservedAt", valuation), valuation))
    event = F.when(~known, "censored").when(F.col("status") == "sold", "sale").otherwise("competing")
    ok = (F.col("listedAt") <= valuation) & (through >= F.col("listedAt")) & F.col("status").isin("active", "sold", "expired", "cancelled")
    return F.when(ok, F.struct(event.alias("event"), through.alias("through")))
