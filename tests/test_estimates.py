import math
import random

from pyspark.sql import functions as F

from namequarry.functions.handles import name_similarity
from namequarry.operators import estimates
from namequarry.operators.estimates import comparable_estimates, listing_estimates, sale_history
from namequarry.operators.similarity import NameIndex, listing_similarity, scores_between

DAY = 86_400_000
SALE = "name string, price double, exact_ms bigint, observed_ms bigint, event_id string"
TARGET = "target_id bigint, name string, at_ms bigint"
LISTING = "id string, name string, ask double, segment string, status string, listed_ms bigint, observed_ms bigint, ended_ms bigint, sold_ms bigint, sale_price double"


def priced(spark, sales, targets):
    history = sale_history(spark.createDataFrame(sales, SALE).withColumn("place", F.lit("clash")))
    return {r["target_id"]: r for r in comparable_estimates(spark.createDataFrame(targets, TARGET), history).collect()}


def test_scores_between_are_whole(spark):
    rng = random.Random(3)
    names = [(n,) for n in {"".join(rng.choice("abc1_") for _ in range(rng.randrange(1, 8))) for _ in range(120)}] + [(None,), ("",)]
    left, right = spark.createDataFrame(names[::5], "name string"), spark.createDataFrame(names, "name string")
    pairs = left.select(F.col("name").alias("target")).where("target <> ''").distinct().join(right.where("name <> ''").distinct(), F.lit(True))
    for kind, plain, least in (("comparable", name_similarity, 0.05), ("listing", listing_similarity, 0.3)):
        want = {(r[0], r[1]): r[2] for r in pairs.withColumn("s", plain(F.col("target"), F.col("name"))).where(F.col("s") >= least + 1e-9).collect()}
        got = {(r[0], r[1]): r[2] for r in scores_between(left, right, least, kind).collect()}
        assert set(want) <= set(got) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert all(got[k] < least + 1e-8 for k in set(got) - set(want))


def test_comparables(spark):
    sales = [("market" + c, 100.0 + i, i * DAY, None, f"e{i}") for i, c in enumerate("abcdefghi")] + [("marketz", 1e12, 5 * DAY, None, "wild")]
    at = 30 * DAY
    r = priced(spark, sales, [(1, "markets", at), (2, "", at), (3, None, at), (4, "markets", -1)])
    assert r[1]["n"] == 10 and r[1]["p50"] < 150 and r[1]["p90"] < 500 and r[1]["effective_size"] > 5
    assert all(r[i]["n"] == 0 and r[i]["p50"] is None and r[i]["reasons"] == ["no-comparables"] for i in (2, 3, 4))
    # what is sold at the valuation or later isn't known, nor are rows without a price, name or time
    later = [("markets", 5e6, at, None, "same time"), ("markets", 9e6, at + 1, None, None), ("markets", 0.0, 1, None, None), ("markets", None, 1, None, None), (None, 4.0, 1, None, None), ("markets", 4.0, None, None, None)]
    again = priced(spark, [*sales, *later, sales[0], sales[0]], [(1, "markets", at)])
    assert {k: v for k, v in again[1].asDict().items()} == {k: v for k, v in r[1].asDict().items()}
    # an id that two different sales have is left out, from when the second is known
    both = [("alpha", 10.0, DAY, None, "x"), ("alpha", 20.0, 3 * DAY, None, "x"), ("alpha", 30.0, None, DAY, " ")]
    r = priced(spark, both, [(1, "alpha", 2 * DAY), (2, "alpha", 4 * DAY)])
    assert (r[1]["n"], r[1]["n_exact"], r[2]["n"], r[2]["n_exact"]) == (2, 1, 1, 0)
    assert "observed-time-only" in r[2]["reasons"] and abs(r[2]["p50"] - 30) < 1e-9
    assert priced(spark, [], [(1, "alpha", 5)])[1]["n"] == 0


def test_comparables_by_hand(spark):
    sales = [("alpha", 100.0, 0, None, None), ("alpha", 400.0, None, 540 * DAY, None)]
    r = priced(spark, sales, [(1, "alpha", 1080 * DAY)])[1]
    w = [0.25, 0.5 * 0.35]  # two half-lives; one, and only observed
    logs = [math.log(100), math.log(400)]
    where = [w[0] / 2 / sum(w), (w[0] + w[1] / 2) / sum(w)]
    mid = logs[0] + (0.5 - where[0]) / (where[1] - where[0]) * (logs[1] - logs[0])
    assert abs(r["p50"] - math.exp(mid)) < 1e-6 and abs(r["effective_size"] - sum(w) ** 2 / sum(x * x for x in w)) < 1e-9
    assert abs(r["evidence"] - (0.35 + 0.65 * w[0] / sum(w))) < 1e-9


def test_listings(spark):
    def at(day, rows, ask=None, name="alpha"):
        target = spark.createDataFrame([(1, name, day * DAY, ask)], TARGET + ", ask double")
        return listing_estimates(target, spark.createDataFrame(rows, LISTING)).collect()[0]

    sold = ("a", "alpha", 10.0, None, "sold", 0, None, None, 10 * DAY, 9.0)
    active = ("b", "alpha", 10.0, None, "active", 15 * DAY, None, None, None, None)
    ended = ("c", "alpha", 10.0, None, "expired", 0, None, 5 * DAY, None, None)
    r = at(20, [sold, active])
    assert (r["sold_30d"], r["median_days"], r["n"], r["n_sold"]) == (1.0, 10.0, 2, 1) and abs(r["expected"] - 9.0) < 1e-9
    assert at(20, [sold, active, ended])["sold_30d"] < 1
    assert at(20, [sold, active, (*ended[:4], "cancelled", *ended[5:])])["sold_30d"] < 1
    assert at(9, [sold])["sold_365d"] == 0 and at(9, [sold])["expected"] is None  # a later sale isn't known yet
    assert abs(at(20, [sold], ask=20.0)["expected"] - 18.0) < 1e-9
    stale = ("d", "alpha", 10.0, None, "active", 0, 2 * DAY, None, None, None)
    assert at(400, [stale])["followed_90d"] == 0 and "no-observed-sales" in at(400, [stale])["reasons"]
    assert at(20, [sold, (*sold[:4], "active", 0, None, None, None, None)])["n"] == 1  # one id, the sale is furthest
    assert at(20, [("e", None, 1.0, None, "sold", 0, None, None, 5, None), ("f", "alpha", -1.0, None, "sold", 0, None, None, 5, None), ("g", "alpha", 1.0, None, "gone", 0, None, None, 5, None), ("h", "alpha", 1.0, None, "sold", 9, None, None, 5, None)])["n"] == 0


def counted(monkeypatch):
    """How many rows each estimate ranks: no row for each pair of a target and a record."""
    seen, best = [], estimates._best

    def spy(rows, *args):
        seen.append(rows.count())
        return best(rows, *args)

    monkeypatch.setattr(estimates, "_best", spy)
    return seen


def test_comparables_rank_few_rows(spark, monkeypatch):
    seen = counted(monkeypatch)
    sales = [(f"market{'abcdefghij'[i % 10]}", 100.0 + i % 7, i * DAY, None, f"e{i}") for i in range(600)]
    targets = [(t, "markets", (400 + t) * DAY) for t in range(3)]
    whole = priced(spark, sales, targets)
    assert seen == [3 * 80] and all(r["n"] == 80 for r in whole.values())
    # many cells give what one gives, with one name that is spread over them
    monkeypatch.setattr(estimates, "_RECORDS", 70)
    monkeypatch.setattr(estimates, "_TARGETS", 2)
    assert priced(spark, sales, targets) == whole


def test_listings_rank_few_rows(spark, monkeypatch):
    seen = counted(monkeypatch)
    # an id twice: as seen active, and as sold later under another name
    rows = [(f"l{i}", "alpha" if i % 2 else "alphas", 10.0 + i % 9, None, "active", i * DAY, None, None, None, None) for i in range(900)]
    rows += [(f"l{i}", "alpha", 10.0, None, "sold", i * DAY, None, None, (i + 20) * DAY, 9.0) for i in range(0, 900, 3)]
    targets = spark.createDataFrame([(t, "alpha", (880 + t) * DAY, 12.0) for t in range(3)], TARGET + ", ask double")
    run = lambda: {r["target_id"]: r for r in listing_estimates(targets, spark.createDataFrame(rows, LISTING)).collect()}
    whole = run()
    assert seen == [3 * 300] and all(r["n"] == 300 and r["n_sold"] > 50 for r in whole.values())
    monkeypatch.setattr(estimates, "_RECORDS", 200)
    monkeypatch.setattr(estimates, "_TARGETS", 2)
    assert run() == whole


def test_similarities_of_long_and_odd_names(spark):
    names = ["a", "_", "a_1", "x" * 130, "x" * 120 + "y" * 9, "éa1", "Ab-9", "alpha", "a1b2c3"]
    for kind, plain in (("comparable", name_similarity), ("listing", listing_similarity)):
        pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
        want = {(r[0], r[1]): r[2] for r in pairs.select("a", "b", plain(F.col("a"), F.col("b"))).collect()}
        for a, found in NameIndex(names, kind).similarities(names):
            assert all(abs(found[i] - want[a, b]) < 1e-9 for i, b in enumerate(names))
