"""Weighted estimates from similar earlier records: prices from comparable sales, time to sale from comparable listings."""

from __future__ import annotations

from collections.abc import Iterator

from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namequarry.functions.handles import shape
from namequarry.operators.similarity import NameIndex

DAY_MS = 86_400_000
# fixed values: defaults of the two estimators
COMPARABLE = {"half_life_days": 540.0, "most": 80, "least_similarity": 0.05, "power": 3.0, "clip_z": 3.5, "least_scale": 0.3, "most_adjustment": 2.25, "least_size": 3.0, "least_best": 0.42, "least_mean": 0.25, "observed_weight": 0.35}
LISTING = {"half_life_days": 365.0, "most": 300, "least_similarity": 0.03, "power": 2.0, "ask_bandwidth": 1.0, "cross_segment": 0.35, "least_size": 4.0, "least_best": 0.4, "least_mean": 0.22}
HORIZONS = (30, 90, 365)
_TARGETS, _RECORDS = 4_000, 400_000  # of a cell, about: a task holds one cell
_NEVER = np.iinfo(np.int64).max


def recency(age_days: np.ndarray, half_life_days: float) -> np.ndarray:
    """Weight that halves with every half-life, at least exp(-30)."""
    return np.exp(np.maximum(-30.0, -np.log(2.0) * age_days / half_life_days))


def ask_kernel(ask: np.ndarray, target_ask: float | None, bandwidth: float) -> np.ndarray:
    """Weight of an asking price by its distance from the target's in logarithms; 1 where the target has none."""
    if target_ask is None:
        return np.ones(len(ask))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.exp(np.fmax(-30.0, -np.abs(np.log(ask / target_ask)) / bandwidth))


def segment_weight(a: str, b: str, cross: float) -> float:
    """1 for one segment, the root of ``cross`` for segments of one shape (the part before the colon), else ``cross``."""
    return 1.0 if a == b else float(np.sqrt(cross)) if a.split(":")[0] == b.split(":")[0] else cross


def structural_adjustment(comparable: Column, target: Column, most: float) -> Column:
    """Logarithm of the factor from a comparable's price to the target's: shorter, fewer digits, underscores and runs are worth more, up to ``most``."""
    share = lambda n: F.coalesce(F.try_divide(F.length(F.regexp_replace(n, "[^0-9]", "")), F.length(n)), F.lit(0.0))
    under = lambda n: F.length(F.regexp_replace(n, "[^_]", ""))
    runs = lambda n: F.size(F.regexp_extract_all(n, F.lit("[a-z]+|[0-9]+|[^a-z0-9_]+"), F.lit(0)))
    gap = 0.1 * (F.length(comparable) - F.length(target)) + 0.4 * (share(comparable) - share(target)) + 0.1 * (under(comparable) - under(target)) + 0.06 * (runs(comparable) - runs(target))
    limit = float(np.log(most))
    return F.least(F.greatest(gap, F.lit(-limit)), F.lit(limit))


def midpoint(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """Weighted quantile between the midpoints of weights, every point for itself; beyond the ends the ends hold."""
    order = np.argsort(values, kind="stable")
    v, w = values[order], weights[order]
    return float(np.interp(q, (np.cumsum(w) - w / 2) / w.sum(), v))


def step(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """The smallest value whose cumulated weight reaches q of the total."""
    order = np.argsort(values, kind="stable")
    c = np.cumsum(weights[order])
    return float(values[order][min(np.searchsorted(c, q * c[-1], side="left"), len(c) - 1)])


def robust_price(logs: np.ndarray, weights: np.ndarray, options: dict) -> tuple[np.ndarray, np.ndarray]:
    """(clipped logs, weights that fall off beyond 2.5 scales): scale is the weighted median deviation from the weighted median."""
    center = midpoint(logs, weights, 0.5)
    scale = max(options["least_scale"], 1.4826 * midpoint(np.abs(logs - center), weights, 0.5))
    z = np.abs(logs - center) / scale
    clipped = np.clip(logs, center - options["clip_z"] * scale, center + options["clip_z"] * scale)
    return clipped, weights * np.where(z <= 2.5, 1.0, (2.5 / np.maximum(z, 2.5)) ** 2)


def sale_history(records: DataFrame) -> DataFrame:
    """Records (name, price, exact_ms, observed_ms, event_id) as history: one row an event, with the time from which its id is in conflict.

    A record's time is exact_ms, else observed_ms. Records without a name, a time or a positive price are left out. Records of one id
    that differ in name, time or price put the id in conflict from the time of the second on; without an id equal
    records are one. Blank ids are none.
    """
    rows = records.where((F.col("name") != "") & (F.col("price") > 0) & (F.col("price") < float("inf")))
    rows = rows.select("name", "price", F.coalesce("exact_ms", "observed_ms").alias("at"), F.col("exact_ms").isNotNull().alias("exact"), F.nullif(F.trim("event_id"), F.lit("")).alias("event_id")).where("at is not null")
    seen = rows.groupBy("event_id", "name", "at", "price").agg(F.max("exact").alias("exact"))  # all copies of one occurrence
    known = seen.where("event_id is not null")
    first = known.groupBy("event_id").agg(F.min(F.struct("at", (~F.col("exact")).alias("late"), "name", "price")).alias("f"))
    other = ~((F.col("name") == F.col("f.name")) & (F.col("at") == F.col("f.at")) & (F.col("price") == F.col("f.price")))
    once = known.join(first, "event_id").groupBy("event_id", "f").agg(F.min(F.when(other, F.col("at"))).alias("conflict_from"))
    once = once.select("event_id", "f.name", "f.at", "f.price", (~F.col("f.late")).alias("exact"), "conflict_from")
    return once.unionByName(seen.where("event_id is null").withColumn("conflict_from", F.lit(None).cast("bigint")))


def _best(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    """At most ``most`` rows a target: a limit that is the estimator's, applied before the shuffle too."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("target_id").orderBy(*order))).where(F.col("place") <= most)


def _places(*order: np.ndarray) -> np.ndarray:
    """Places of rows in an order, the first key first; equal rows in the order they stand in."""
    out = np.empty(len(order[0]), np.int64)
    out[np.lexsort(order[::-1])] = np.arange(len(out))
    return out


def _heaviest(weight: np.ndarray, most: int, *ties: np.ndarray) -> np.ndarray:
    """Positions of the ``most`` heaviest, equal ones by ``ties``."""
    at = np.arange(len(weight))
    if len(at) > most:
        at = at[weight >= np.partition(weight, -most)[-most]]
    return at[np.lexsort((*(x[at] for x in ties[::-1]), -weight[at]))][:most]


def _numbers(table: pa.Table, column: str, absent: float | None = None) -> np.ndarray:
    of = table[column] if absent is None else table[column].fill_null(absent)
    return of.to_numpy()


def _texts(table: pa.Table, column: str) -> tuple[list[str], np.ndarray]:
    """The distinct texts in their order, and the place of each row's."""
    coded = table[column].combine_chunks().dictionary_encode()
    texts = coded.dictionary.to_pylist()
    order = sorted(range(len(texts)), key=texts.__getitem__)
    place = np.empty(len(texts), np.int64)
    place[order] = np.arange(len(texts))
    return [texts[i] for i in order], place[coded.indices.to_numpy()]


def _met(targets: DataFrame, records: DataFrame, key: str, solve, schema: str, spread: list[str] | None = None) -> DataFrame:
    """What ``solve`` finds for cells of targets (target_id, name, ...) and records, in which every target meets every record once.

    Targets are dealt to groups, records too by ``key``; a cell is a pair of groups, and its size doesn't grow with
    the tables, only the number of cells does. Each record is shuffled once a group of targets and no pair ever is.
    spread: columns by which records are dealt whose key holds a large share of a cell.
    """
    spark = targets.sparkSession
    n, m = targets.count(), records.count()
    across = max(1, ceil(m / _RECORDS))
    down = max(1, ceil(n / _TARGETS), min(ceil(n / 50), ceil(2 * spark.sparkContext.defaultParallelism / across)))
    if across > 1 and spread:
        large = records.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > _RECORDS / 8)  # at most 8 a cell
        records = records.join(F.broadcast(large), key, "left").withColumn("__part", F.when(F.col("__n").isNotNull(), F.xxhash64(*spread)).otherwise(0)).drop("__n")
    else:
        records = records.withColumn("__part", F.lit(0))
    part = lambda n, *of: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("__down") * across + F.col("__across")).alias("__cell")
    left = targets.withColumn("__down", part(down, "target_id")).withColumn("__across", every(across))
    right = records.withColumn("__across", part(across, key, "__part")).withColumn("__down", every(down))
    left, right = (df.select(*(c for c in df.columns if not c.startswith("__")), cell).repartition(3 * down * across, "__cell") for df in (left, right))

    return left.groupBy("__cell").cogroup(right.groupBy("__cell")).applyInArrow(solve, schema)


def _found(targets: pa.Table, records: pa.Table, per_target: list[tuple[int, np.ndarray, dict[str, np.ndarray]]], made: dict[str, pa.DataType], kept: list[str]) -> pa.Table:
    """target_id, the columns of records that are ``kept``, and those that were ``made`` for (target, records)."""
    none = np.zeros(0, np.int64)
    t = np.concatenate([none, *(np.full(len(rows), i) for i, rows, _ in per_target)])
    r = np.concatenate([none, *(rows for _, rows, _ in per_target)])
    out = {"target_id": targets["target_id"].take(pa.array(t)), **{c: records[c].take(pa.array(r)) for c in kept}}
    for c, kind in made.items():
        out[c] = pa.array(np.concatenate([none, *(x[c] for _, _, x in per_target)]), kind)
    return pa.table(out)


def _by_name(targets: pa.Table, names: list[str], kind: str) -> Iterator[tuple[list[int], np.ndarray]]:
    """The rows of targets of one name with its similarity to each of ``names``, name by name."""
    rows: dict[str, list[int]] = {}
    for i, name in enumerate(targets["name"].to_pylist()):
        rows.setdefault(name, []).append(i)
    for name, similar in NameIndex(names, kind).similarities(list(rows)) if names else ():
        yield rows[name], similar


def comparable_estimates(targets: DataFrame, history: DataFrame, **options: float) -> DataFrame:
    """Price estimates of targets (target_id, name, at_ms) from ``sale_history``, one row each.

    Only sales strictly before a target's time count. Weights: similarity to a power, recency, and less for times that were only
    observed. The heaviest ``most`` are cleaned of outliers and give weighted quantiles, their effective size, means
    and a confidence. A target without comparables has nulls and n = 0; targets with a null or empty name too. reasons: why an estimate is out of distribution.
    Every target is compared with every name of the history, in cells (``_met``), each of which gives at most ``most`` sales a target.
    """
    o = COMPARABLE | options
    wanted = targets.select("target_id", "name", "at_ms")
    kind = targets.schema["target_id"].dataType.simpleString()
    sales = history.where("name <> ''").select(F.col("name").alias("other"), "at", "exact", "price", F.coalesce("event_id", F.lit("")).alias("event_id"), "conflict_from")

    def nearest(targets: pa.Table, records: pa.Table) -> pa.Table:
        names, of = _texts(records, "other")
        at, price, until = _numbers(records, "at"), _numbers(records, "price"), _numbers(records, "conflict_from", _NEVER)
        evidence = np.where(records["exact"].to_numpy(zero_copy_only=False).astype(bool), 1.0, o["observed_weight"])
        place = _places(of, at, price, _texts(records, "event_id")[1])
        out, times = [], targets["at_ms"].to_pylist()
        for rows, similar in _by_name(targets, names, "comparable"):
            near, strength = np.flatnonzero((similar >= o["least_similarity"])[of]), similar ** o["power"]
            for row in rows:
                now = times[row]
                r = near[(at[near] < now) & (until[near] >= now)]
                s, age = similar[of[r]], (now - at[r]) / DAY_MS
                w = strength[of[r]] * recency(age, o["half_life_days"]) * evidence[r]
                best = _heaviest(w, o["most"], -s, age, place[r])
                out.append((row, r[best], {"similarity": s[best], "weight": w[best]}))
        return _found(targets, records, out, {"similarity": pa.float64(), "weight": pa.float64()}, ["other", "at", "exact", "price", "event_id"])

    rows = _met(wanted.where("name <> '' and at_ms is not null"), sales, "other", nearest, f"target_id {kind}, other string, at bigint, exact boolean, price double, event_id string, similarity double, weight double", ["at", "price", "event_id"])
    rows = _best(rows, o["most"], F.desc("weight"), F.desc("similarity"), F.desc("at"), F.col("other"), F.col("price"), F.col("event_id")).join(wanted, "target_id")
    rows = rows.withColumns({"age": (F.col("at_ms") - F.col("at")) / DAY_MS, "log_price": F.ln("price") + structural_adjustment(F.col("other"), F.col("name"), o["most_adjustment"])})
    lists = rows.groupBy("target_id").agg(F.sort_array(F.collect_list(F.struct("place", "log_price", "weight", "similarity", "age", "exact"))).alias("c"))
    lists = lists.select("target_id", *(F.col("c")[f].alias(f) for f in ("log_price", "weight", "similarity", "age", "exact")))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, logs, weights, similar, age, exact in batch.itertuples(index=False):
                logs, w, similar, age, exact = (np.asarray(x, float) for x in (logs, weights, similar, age, exact))
                clipped, w = robust_price(logs, w, o)
                p10, p50, p90 = (float(np.exp(midpoint(clipped, w, q))) for q in (0.1, 0.5, 0.9))
                size, mean, old, share = w.sum() ** 2 / (w * w).sum(), np.average(similar, weights=w), np.average(age, weights=w), np.average(exact, weights=w)
                evidence = o["observed_weight"] + (1 - o["observed_weight"]) * share
                enough = min(1.0, np.log1p(size) / np.log1p(max(12.0, o["least_size"])))
                alike, fresh, tight = min(1.0, max(0.0, (mean - 0.1) / 0.65)), np.exp(-old / (2.5 * o["half_life_days"])), 1 / (1 + max(0.0, np.log(p90 / p10)) / 2)
                sure = min(1.0, max(0.0, enough * (0.55 * alike + 0.25 * fresh + 0.2 * tight) * evidence))
                n, k = len(logs), int(exact.sum())
                why = [r for r, yes in (("too-few-comparables", n < 3), ("low-effective-sample-size", size < o["least_size"]), ("no-close-match", similar.max() < o["least_best"]), ("low-average-similarity", mean < o["least_mean"]), ("observed-time-only", k == 0), ("mostly-observed-times", k > 0 and share < 0.5), ("low-confidence", sure < 0.25)) if yes]
                out.append((id_, p10, p50, p90, sure, size, n, k, evidence, why))
            yield pd.DataFrame(out, columns=["target_id", "p10", "p50", "p90", "confidence", "effective_size", "n", "n_exact", "evidence", "reasons"])

    made = lists.mapInPandas(solve, f"target_id {kind}, p10 double, p50 double, p90 double, confidence double, effective_size double, n int, n_exact int, evidence double, reasons array<string>")
    out = wanted.join(made, "target_id", "left").fillna(0, ["n", "n_exact", "confidence", "effective_size"])
    return out.withColumn("reasons", F.coalesce("reasons", F.array(F.lit("no-comparables"))))


def listing_estimates(targets: DataFrame, listings: DataFrame, **options: float) -> DataFrame:
    """Time to sale of targets (target_id, name, at_ms, ask) from listings (id, name, ask, segment, status, listed_ms, observed_ms, ended_ms, sold_ms, sale_price), one row each.

    Each listing counts as it was known at the target's time: later sales and endings are censored, when last seen
    if that is earlier. Of listings with one id (or, without one, of one name, start and ask) the furthest known counts. Weights: similarity to a power, segment, ask and recency of the start. The heaviest ``most``
    give the curve of competing risks, the sale probabilities within HORIZONS days, the median days to sale, an
    expected price and a confidence. A target without listings has nulls and n = 0.
    """
    o = LISTING | options
    wanted = targets.select("target_id", "name", "at_ms", F.col("ask").alias("target_ask"))
    kind = targets.schema["target_id"].dataType.simpleString()
    ok = listings.where((F.col("ask") > 0) & (F.col("ask") < float("inf")) & F.col("listed_ms").isNotNull() & F.col("status").isin("active", "sold", "expired", "cancelled") & (F.col("name") != ""))
    key = F.coalesce(F.concat(F.lit("id:"), F.nullif(F.trim("id"), F.lit(""))), F.concat_ws("\u0000", F.lit("row:"), "name", F.col("listed_ms").cast("string"), F.col("ask").cast("string")))
    end = F.when(F.col("status") == "sold", F.coalesce("sold_ms", "ended_ms")).when(F.col("status") != "active", F.col("ended_ms"))
    ok = ok.select(
        F.col("name").alias("other"), key.alias("key"), "ask", F.coalesce(F.nullif(F.lower(F.trim("segment")), F.lit("")), shape(F.col("name"))).alias("segment"), (F.col("status") == "sold").alias("sold"), "listed_ms", "observed_ms", end.alias("end_ms"),
        F.when(F.col("sale_price") > 0, F.col("sale_price")).otherwise(F.col("ask")).alias("price"),
    )

    def nearest(targets: pa.Table, records: pa.Table) -> pa.Table:
        keys, of_key = _texts(records, "key")
        # keys with several rows come first, key by key; the rest by their start
        several = (np.bincount(of_key, minlength=len(keys)) > 1)[of_key]
        order = np.lexsort((_numbers(records, "listed_ms"), np.where(several, of_key, 0), ~several))
        records, of_key, several = records.take(pa.array(order)), of_key[order], int(several.sum())
        starts = np.flatnonzero(np.diff(of_key[:several], prepend=-1))
        group = np.cumsum(np.diff(of_key[:several], prepend=-1) != 0) - 1
        names, of = _texts(records, "other")
        segments, segment = _texts(records, "segment")
        ask, price, listed = (_numbers(records, c) for c in ("ask", "price", "listed_ms"))
        seen, end, sold = _numbers(records, "observed_ms", _NEVER), _numbers(records, "end_ms", _NEVER), records["sold"].to_numpy(zero_copy_only=False).astype(bool)
        furthest = [_places(of, segment, ask, listed), _places(of, segment, ask, price, listed)]  # which of equal ends of one key counts: unsold, sold
        place = _places(-listed, of, of_key, ask)
        out, times, asks, shapes = [], targets["at_ms"].to_pylist(), targets["target_ask"].to_pylist(), targets["shape"].to_pylist()

        def top(values: np.ndarray, ok: np.ndarray) -> np.ndarray:
            """Of the rows that are ok, those with the highest value of their key."""
            values = np.where(ok, values, -_NEVER)
            return ok & (values == np.maximum.reduceat(values, starts)[group]) if several else ok

        for rows, similar in _by_name(targets, names, "listing"):
            near, strength = (similar >= o["least_similarity"])[of], similar ** o["power"]
            alike = np.array([segment_weight(shapes[rows[0]], s, o["cross_segment"]) for s in segments])
            for row in rows:
                now = times[row]
                n = several + int(np.searchsorted(listed[several:], now, "right"))  # the rest start later
                known = end[:n] <= now
                through = np.where(known, end[:n], np.minimum(seen[:n], now))
                event = np.where(known, 1 + sold[:n], 0)  # censored, competing, sale
                kept = near[:n] & (listed[:n] <= now) & (through >= listed[:n])
                e = event[:several]
                first = top(through[:several], top(e, kept[:several]))
                kept[:several] = top(np.where(e == 2, furthest[1][:several], furthest[0][:several]), first)
                r = np.flatnonzero(kept)
                w = strength[of[r]] * alike[segment[r]] * ask_kernel(ask[r], asks[row], o["ask_bandwidth"]) * recency((now - listed[r]) / DAY_MS, o["half_life_days"])
                s = similar[of[r]]
                best = _heaviest(w, o["most"], -s, place[r])
                out.append((row, r[best], {"similarity": s[best], "weight": w[best], "event": event[r[best]], "through": through[r[best]]}))
        return _found(targets, records, out, {"similarity": pa.float64(), "weight": pa.float64(), "event": pa.int32(), "through": pa.int64()}, ["other", "key", "ask", "price", "listed_ms"])

    made = f"target_id {kind}, other string, key string, ask double, price double, listed_ms bigint, similarity double, weight double, event int, through bigint"
    rows = _met(wanted.where("name <> '' and at_ms is not null").withColumn("shape", shape(F.col("name"))), ok, "key", nearest, made)
    rows = rows.withColumns({"days": (F.col("through") - F.col("listed_ms")) / DAY_MS, "price": F.when(F.col("event") == 2, F.col("price"))})
    best = _best(rows, o["most"], F.desc("weight"), F.desc("similarity"), F.desc("listed_ms"), F.col("other"), F.col("key"), F.col("ask")).join(wanted.select("target_id", "target_ask"), "target_id")
    lists = best.groupBy("target_id", "target_ask").agg(F.sort_array(F.collect_list(F.struct("place", "days", "event", "weight", "similarity", "ask", "price"))).alias("c"))
    lists = lists.select("target_id", "target_ask", *(F.col("c")[f].alias(f) for f in ("days", "event", "weight", "similarity", "ask", "price")))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for id_, ask, days, event, w, similar, asks, price in batch.itertuples(index=False):
                days, w, similar, asks, price = (np.asarray(x, float) for x in (days, w, similar, asks, price))
                event, total = np.asarray(event), w.sum()
                curve = competing_curve(days, event, w)
                within = [max([c for d, c in curve if d <= h], default=0.0) for h in HORIZONS]
                median = next((d for d, c in curve if c >= 0.5), None)
                size, mean = total**2 / (w * w).sum(), np.average(similar, weights=w)
                followed = [float(w[(days >= h) | (event > 0)].sum() / total) for h in HORIZONS]
                sold = event == 2
                expected = None
                if sold.any():
                    logs = np.log(price[sold]) if pd.isna(ask) else np.log(ask) + np.log(price[sold] / asks[sold])
                    center = step(logs, w[sold], 0.5)
                    scale = max(0.15, 1.4826 * step(np.abs(logs - center), w[sold], 0.5))
                    expected = float(np.exp(np.average(np.clip(logs, center - 3.5 * scale, center + 3.5 * scale), weights=w[sold])))
                enough = min(1.0, np.log1p(size) / np.log1p(max(16.0, o["least_size"])))
                told = 0.5 * followed[1] + 0.3 * w[event > 0].sum() / total + 0.2 * w[sold].sum() / total
                sure = min(1.0, max(0.0, enough * (0.6 * min(1.0, max(0.0, (mean - 0.08) / 0.72)) + 0.4 * min(1.0, told))))
                far = not pd.isna(ask) and np.abs(np.log(asks / ask)).min() > 2 * o["ask_bandwidth"]
                why = [r for r, yes in (("too-few-observations", len(w) < 3), ("low-effective-sample-size", size < o["least_size"]), ("no-close-match", similar.max() < o["least_best"]), ("low-average-similarity", mean < o["least_mean"]), ("insufficient-followup", followed[1] < 0.3), ("no-observed-sales", not sold.any()), ("ask-price-out-of-range", far), ("low-confidence", sure < 0.2)) if yes]
                out.append((id_, *within, median, expected, sure, size, len(w), int(sold.sum()), followed[1], followed[2], why))
            yield pd.DataFrame(out, columns=["target_id", *(f"sold_{h}d" for h in HORIZONS), "median_days", "expected", "confidence", "effective_size", "n", "n_sold", "followed_90d", "followed_365d", "reasons"])

    made = lists.mapInPandas(solve, f"target_id {kind}, " + ", ".join(f"sold_{h}d double" for h in HORIZONS) + ", median_days double, expected double, confidence double, effective_size double, n int, n_sold int, followed_90d double, followed_365d double, reasons array<string>")
    out = wanted.join(made, "target_id", "left").fillna(0, ["n", "n_sold", "confidence", "effective_size"])
    return out.withColumn("reasons", F.coalesce("reasons", F.array(F.lit("no-observations"))))


def competing_curve(days: np.ndarray, event: np.ndarray, weights: np.ndarray) -> list[tuple[float, float]]:
    """Points (days, share sold) of the Aalen-Johansen curve; event: 2 sold, 1 ended otherwise, 0 censored."""
    points, alive, sold = [], 1.0, 0.0
    for d in np.unique(days[event > 0]):
        risk = weights[days >= d].sum()
        here = days == d
        sale = weights[here & (event == 2)].sum() / risk
        other = min(weights[here & (event == 1)].sum() / risk, 1 - sale)
        sold, alive = min(1.0, sold + alive * sale), max(0.0, alive * (1 - sale - other))
        points.append((float(d), float(sold)))
    return points
