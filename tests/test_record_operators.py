import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namequarry.functions import handles as H
from namequarry.operators import asof, calibrate, generate, lifecycle, merge, models, similarity, splits, validate, weighted
from namequarry.plans import reference_queries
from namequarry.sources import files


def one(spark, column, *values, schema="a string"):
    return spark.createDataFrame([values], schema).select(column).first()[0]


@pytest.mark.parametrize("text,want", [("1,583,948", 1583948.0), ("12.345,75", 12345.75), ("1.234.567", 1234567.0), ("12,5", 12.5), ("1,234", 1234.0), ("12.5 TON", 12.5), ("n/a", None), ("", None), (None, None)])
def test_amounts(spark, text, want):
    assert one(spark, H.amount(F.col("a")), text) == want


def test_name_functions(spark):
    assert one(spark, H.handle(F.col("a")), " @@Alpha_1 ") == "alpha_1"
    assert one(spark, H.valid_handle(F.col("a")), "ab__cd") is False
    assert one(spark, H.shape(F.col("a")), "ab12") == "letter-digit:4"
    assert one(spark, H.lexical_family(F.col("a")), "a12__b3") == "a#_b#"
    assert one(spark, H.transliterated(F.col("a")), "Щука ёж") == "shchukaezh"
    assert one(spark, H.class_runs(F.col("a")), "ab12_c") == "ad_a"
    assert one(spark, H.pronounceable(F.col("a")), "strngth") is False
    f = spark.createDataFrame([("aab12_xyz",), ("",)], "a string").select(*(c.alias(k) for k, c in H.numeric_features(F.col("a")).items())).collect()
    assert f[0]["digits"] == 2 and f[0]["letter_run"] == 3 and f[0]["repeats"] == 1 and f[0]["length"] == 9
    assert f[1]["length"] == 0 and f[1]["digit_ratio"] == 0
    v = one(spark, H.hashed_ngrams(F.col("a")), "alpha")
    assert len(v) == 32 and v == one(spark, H.hashed_ngrams(F.col("a")), "alpha")
    assert 0 < one(spark, H.entropy(F.col("a")), "abcd") < 1


def test_quantile_goldens(spark):
    df = spark.createDataFrame([(4.0,), (1.0,), (3.0,), (2.0,)], "x double").withColumns({"g": F.lit(1), "w": F.lit(1.0)})
    assert df.select(F.percentile("x", F.lit(0.5))).first()[0] == 2.5
    assert weighted.step_quantile(df, ["g"], "x", "w", 0.5).first()["quantile"] == 2.0
    q = weighted.midpoint_quantile(df, ["g"], "x", "w", [0.0, 0.5, 1.0]).first()
    assert (q["q_0"], q["q_50"], q["q_100"]) == (1.0, 2.5, 4.0)


def test_accuracy_goldens(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 2.0)], "a double, p double").withColumn("g", F.lit(1))
    r = weighted.accuracy(df, ["g"], "a", "p").first()
    assert r["within2x"] == 0.5 and r["within3x"] == 1.0
    r = weighted.accuracy(spark.createDataFrame([(10.0, 10.0, 1), (100.0, 200.0, 1), (1000.0, 500.0, 1)], "a double, p double, g int"), ["g"], "a", "p").first()
    assert r["within2x"] == 1.0 and math.isclose(r["median_factor"], 2.0)


@pytest.mark.parametrize("a,p,want", [([100, 90, 1, 0], [10, 10, 10, 0], 1 / 3), ([100, 100, 1, 0], [10, 9, 8, 7], 0.5), ([1, 2, 3, 100], [100, 3, 2, 1], 0.0)])
def test_tail_recall(spark, a, p, want):
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(a, p)], "g int, a double, p double")
    assert math.isclose(weighted.tail_recall(df, ["g"], "a", "p", 0.25).first()["recall"], want, abs_tol=1e-12)


def test_survival(spark):
    df = spark.createDataFrame([(1, 5.0, "sale", 1.0), (1, 10.0, "sale", 1.0), (1, 7.0, "censored", 1.0), (1, 12.0, "competing", 1.0), (1, None, "sale", 1.0)], "g int, d double, e string, w double")
    got = {r["d"]: r["cumulative"] for r in weighted.sale_curve(df, ["g"], "d", "e", "w").collect()}
    assert math.isclose(got[5.0], 0.25) and math.isclose(got[10.0], 0.25 + 0.75 / 2) and math.isclose(got[12.0], got[10.0])


def test_asof_against_brute_force(spark):
    rng = random.Random(2)
    facts = [(rng.choice("ab"), rng.randrange(100), float(i)) for i in range(40)] + [(None, 3, 1.0), ("a", None, 2.0)]
    targets = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(100)])) for i in range(60)]
    f = spark.createDataFrame(facts, "k string, t bigint, v double")
    t = spark.createDataFrame(targets, "i int, k string, t bigint")
    got = {r["i"]: r["v"] for r in asof.asof_join(t, f, "k", "t", ["v"], 7).collect()}
    assert len(got) == 60
    for i, k, at in targets:
        before = [(ft, v) for fk, ft, v in facts if fk == k and k is not None and ft is not None and at is not None and ft < at]
        assert got[i] == (max(before)[1] if before else None)


def test_running_before(spark):
    rows = [("a", t, float(v)) for t, v in [(1, 10), (1, 20), (2, 5), (30, 1)]]
    got = {(r["t"], r["v"]): (r["n_before"], r["sum_before"]) for r in asof.running_before(spark.createDataFrame(rows, "k string, t bigint, v double"), ["k"], "t", F.col("v")).collect()}
    assert got == {(1, 10.0): (0, 0.0), (1, 20.0): (0, 0.0), (2, 5.0): (2, 30.0), (30, 1.0): (3, 35.0)}


def test_similarity_is_exact(spark):
    rng = random.Random(3)
    names = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), (next(iter(names)),)], "n string")

    def grams(s):
        p = f"^{s}$"
        return {p[i : i + 3] for i in range(max(1, len(p) - 2))}

    want = {(a, b) for a in names for b in names if a < b and len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.4}
    assert {(r["a"], r["b"]) for r in similarity.similar_names(df, "n", 0.4).collect()} == want


def test_similar_names_make_rows_of_the_result_only(spark, monkeypatch):
    rng = random.Random(5)
    names = sorted({"".join(rng.choice(x) for x in ("bdkt", "ae", "bdkt", "ae", "bd", "a_1")) for _ in range(80)}) + ["", "я", "\U0001f600"]
    grams = lambda s: {f"^{s}$"[i : i + 2] for i in range(len(s) + 1)}
    want = {(a, b): len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a in names for b in names if a < b}
    want = {k: v for k, v in want.items() if v >= 0.3}
    df = spark.createDataFrame([(x,) for x in [*names, *names[:9], None]], "n string")
    for size in (10_000, 11):
        monkeypatch.setattr(similarity, "_GROUP", size)
        found = similarity.similar_names(df, "n", 0.3, 2)
        rows = found.collect()
        assert len(rows) == len(want) and all(abs(want[r["a"], r["b"]] - r["jaccard"]) < 1e-12 for r in rows)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # pairs that share a gram never are rows
    assert similarity.similar_names(df.limit(0), "n", 0.3, 2).count() == 0


def test_merges(spark):
    df = spark.createDataFrame([("k", 1.0, "x", "LOW"), ("k", 1.0 + 1e-14, None, "high"), ("j", 1.0, "x", None), ("j", 2.0, "y", "?"), (None, 1.0, "x", "high")], "id string, p double, t string, c string")
    got = {r["id"]: r for r in merge.merged_events(df, "id", ["p"], ["t"], "c").collect()}
    assert got["k"]["conflicts"] == "" and got["k"]["grade_rank"] == 3 and got["k"]["t"] == "x"
    assert got["j"]["conflicts"] == "p,t" and got["j"]["p"] is None and len(got) == 2
    kept = merge.without_conflicts(df, "id", ["p", "t"]).collect()
    assert [r["id"] for r in kept] == [None]
    r = {x["k"]: x["state"] for x in merge.reconciled(spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(2,), (3,), (3,), (4,)], "k int"), "k").collect()}
    assert r == {1: "missing", 2: "matched", 3: "duplicate", 4: "foreign"}
    up = merge.upserted(spark.createDataFrame([("a", 1, "n")], "k string, x int, y string"), spark.createDataFrame([("a", None, "m"), ("b", 2, None)], "k string, x int, y string"), ["k"])
    assert {tuple(r) for r in up.collect()} == {("a", 1, "m"), ("b", 2, None)}


def test_lifecycle(spark):
    rows = [("a", 1, 1, "listed", 5.0), ("a", 2, 2, "bid", 6.0), ("a", 3, 3, "listed", 4.0), ("a", 4, 4, "sale", 4.0), ("a", 5, 5, "sale", 4.0), (None, 1, 6, "listed", 1.0), ("b", 1, 7, "listed", 1.0)]
    df = spark.createDataFrame(rows, "asset string, at bigint, tie bigint, kind string, price double")
    got = {(r["asset"], r["listed_at"]): r["state"] for r in lifecycle.listings(df, "asset", "at", "kind", "tie").collect()}
    assert got == {("a", 1): "repriced", ("a", 3): "ended", ("b", 1): "open"}
    assert [r["tie"] for r in lifecycle.unmatched_endings(df, "asset", "at", "kind", "tie").collect()] == [5]


def test_splits_keep_groups_whole(spark):
    df = spark.range(1000).select((F.col("id") % 37).alias("g"), "id")
    c = splits.group_cohorts(df, "g", 5, {"test": 0.2, "calibration": 0.1})
    assert c.count() == 37 and c.agg(F.sum("n")).first()[0] == 1000
    share = {r["cohort"]: r["s"] for r in c.groupBy("cohort").agg(F.sum("n").alias("s")).collect()}
    assert 150 < share["test"] < 260


def test_monotone():
    assert calibrate.monotone([(1, 1.0), (1, 3.0), (1, 2.0)]) == [1.0, 2.5, 2.5]
    assert calibrate.monotone([]) == []


def test_generators(spark):
    a = generate.readable(spark, 500, 5, 9, 1).toPandas()["name"]
    assert list(sorted(a)) == list(sorted(generate.readable(spark, 500, 5, 9, 1).toPandas()["name"])) and a.is_unique
    assert a.str.fullmatch("[a-z]{5,9}").all()
    assert generate.random_names(spark, 200, 5, 8, 1).where(~H.valid_handle(F.col("name"), 5)).count() == 0


def test_median_is_exact(spark, monkeypatch):
    rng = random.Random(9)
    cases = [[], [3.0], [1.0, 2.0], [5.0] * 9, [1.0] * 4 + [2.0] * 4, [1.0, 1.0 + 2**-52] * 8, [rng.lognormvariate(0, 9) for _ in range(501)], [rng.gauss(0, 1) for _ in range(500)] + [0.25] * 30, [0.0, 5e-324, 1e-323, 1e308, -1e308]]
    for few in (0, 7):
        monkeypatch.setattr(models, "_FEW", few)
        monkeypatch.setattr(models, "_BINS", 8)
        for values in cases:
            df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
            assert models.median(df, F.col("v")) == df.agg(F.percentile("v", F.lit(0.5))).first()[0]


def test_ridge_keeps_no_distinct_values(spark, monkeypatch):
    def refuse(*args):
        raise AssertionError("an exact percentile holds every distinct value at one place")

    monkeypatch.setattr(models.F, "percentile", refuse)
    df = spark.createDataFrame([(float(i), 2.0 * i + (1e6 if i % 50 == 0 else 0.01 * (i % 3))) for i in range(1, 200)], "x double, y double")
    beta = models.ridge(df, ["x"], "y", penalty=1e-9, huber=25)
    assert abs(beta[1] - 2) < 0.5


def test_ridge_without_rounds_takes_no_median(spark, monkeypatch):
    def refuse(*args):
        raise AssertionError("its scale is never used")

    monkeypatch.setattr(models.F, "percentile", refuse)
    monkeypatch.setattr(models, "median", refuse)
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(20)], "x double, y double")
    assert abs(models.ridge(df, ["x"], "y", penalty=1e-9)[1] - 3) < 1e-6


def test_ridge(spark):
    df = spark.range(200).select((F.col("id") / 50).alias("x"), (F.col("id") % 7).cast("double").alias("z")).withColumn("y", 3 + 2 * F.col("x") - F.col("z"))
    beta = models.ridge(df, ["x", "z"], "y", penalty=1e-6)
    assert abs(beta - [3, 2, -1]).max() < 1e-3


def test_sources(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"a": 1}\n{"a": "x"}\n')
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    with pytest.raises(Exception, match="doesn't fit"):
        files.strict_json(spark, str(p), schema).collect()
    assert [r["a"] for r in files.lenient_json(spark, str(p), schema).collect()] == [1]
    pages = spark.createDataFrame([(1, "<table><tr><td>a<td> b </tr><tr><td>c &amp; d</td></tr>"), (2, None), (3, "no table")], "page_id int, html string")
    assert [(r["page"], r["cells"]) for r in files.table_rows(pages).collect()] == [(1, ["a", "b"]), (1, ["c & d"])]
    spark.dataSource.register(files.RecordedPages)
    import json

    page = tmp_path / "p.json"
    page.write_text(json.dumps({"rows": [{"b": 1}, {"b": 2}]}))
    assert spark.read.format("recorded_pages").option("pages", json.dumps([str(page)])).load().count() == 2
    small, large = files.bounded_files(spark, str(tmp_path), 30)
    assert small.count() + large.count() == 2
    store = files.VersionedTable(spark, f"file://{tmp_path}/store")
    store.save(spark.range(3))
    store.save(spark.range(5))
    assert store.version() == 1 and store.load().count() == 5


def test_validation(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (None, 3)], "a int, b int")
    rules = {"a": F.col("a").isNotNull(), "b": F.col("b") > 0}
    ok, bad = validate.quarantined(df, rules)
    assert ok.count() == 1 and {tuple(r["errors"]) for r in bad.collect()} == {("b",), ("a",)}
    with pytest.raises(Exception, match="row breaks"):
        validate.refused(df, rules).collect()
    assert validate.refused(df.where("a = 1"), rules).count() == 1
    assert validate.canonical('{"b": 1, "a": [1, {"d": 2, "c": null}]}') == '{"a":[1,{"c":null,"d":2}],"b":1}'
    assert validate.canonical("{") is None and validate.canonical(None) is None and validate.canonical("[" * 80 + "]" * 80) is None
    rows = spark.createDataFrame([(1, '{"b":1,"a":2}'), (2, None)], "k bigint, t string")
    assert {tuple(r) for r in validate.with_canonical(rows, "k", "t").collect()} == {(1, '{"a":2,"b":1}'), (2, None)}


def test_name_similarity(spark):
    names = ["market", "markets", "market99", "qxzvbn"]
    df = spark.createDataFrame([("market", n) for n in [*names, ""]], "a string, b string")
    got = {r["b"]: r["s"] for r in df.select("b", H.name_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got["market"] == 1.0 > got["markets"] > got["market99"] > got["qxzvbn"] >= 0 and got[""] == 0
    back = {r["b"]: r["s"] for r in df.select("b", H.name_similarity(F.col("b"), F.col("a")).alias("s")).collect()}
    assert all(math.isclose(got[n], back[n]) for n in names)


def test_similar_scores_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "_BLOCK", 7)
    rng = random.Random(9)
    names = {"".join(rng.choice("abc1_") for _ in range(rng.randrange(1, 12))) for _ in range(60)} | {"market", "qxzvbn", "q1_w2_e3_r4"}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("",), ("market",)], "n string")
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a < b], "a string, b string").withColumn("s", H.name_similarity(F.col("a"), F.col("b")))
    every = {(r["a"], r["b"]): r["s"] for r in pairs.collect()}
    for threshold in (0.05, 0.4):
        got = [tuple(r) for r in similarity.similar_scores(df, "n", threshold).collect()]
        want = {k: s for k, s in every.items() if s >= threshold}
        assert len(got) == len(want) and all(math.isclose(want[a, b], s) for a, b, s in got)
    grams = lambda s: {f"^{s}$"[i : i + 2] for i in range(len(s) + 1)}
    assert any(s >= 0.05 and 0 < len(grams(a) & grams(b)) / len(grams(a) | grams(b)) < 0.3 for (a, b), s in every.items())


def plain_banks(name):
    def hashed(text, seed):
        for c in text:
            seed = (seed ^ ord(c)) * 0x01000193 % 2**32
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            seed = (seed ^ seed >> shift) * factor % 2**32
        return seed ^ seed >> 16

    grams = [f"{n}:{p[i : i + n]}" for p in [f"^{name}$"] for n in (2, 3, 4) for i in range(len(p) - n + 1)] if name else []
    out = [0.0] * 64
    for bank, seed in enumerate((0x811C9DC5, 0x9E3779B9)):
        for h in (hashed(g, seed) for g in grams):
            out[32 * bank + h % 32] += 1 if h < 2**31 else -1
    return [x / math.sqrt(max(1, len(grams))) for x in out]


def plain_periodic(text):
    best = 0
    for period in range(1, len(text) // 2 + 1):
        for start in range(len(text) - 2 * period + 1):
            span = period
            while start + span < len(text) and text[start + span] == text[start + span % period]:
                span += 1
            best = max(best, span if span >= 2 * period else 0)
    return best / len(text) if text else 0


def test_whole_name_features(spark):
    rng = random.Random(4)
    names = ["", "a", "1", "aaaa", "abababa", "xabcabcab", "banana_7_7", *("".join(rng.choice("ab1_e") for _ in range(rng.randrange(1, 14))) for _ in range(40))]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, a string")
    made = {k: c.alias(k) for k, c in H.numeric_features(F.col("a")).items()}
    rows = df.select("a", H.hashed_banks(F.col("a")).alias("banks"), *made.values()).collect()
    assert len(rows) == len(names)
    for r in rows:
        assert all(map(math.isclose, r["banks"], plain_banks(r["a"]))) and len(r["banks"]) == 64
        assert math.isclose(r["periodic_ratio"], plain_periodic(r["a"]))
        for cls, mean, std in (("0123456789", "digit_position_mean", "digit_position_std"), ("_", "underscore_position_mean", None)):
            at = [i / (len(r["a"]) - 1) for i, c in enumerate(r["a"]) if c in cls] if len(r["a"]) > 1 else []
            m = sum(at) / len(at) if at else 0
            assert math.isclose(r[mean], m) and (std is None or math.isclose(r[std], math.sqrt(sum((x - m) ** 2 for x in at) / len(at)) if at else 0, abs_tol=1e-12))
        v = [c in "aeiou" for c in r["a"] if c.isalpha()]
        if not v:
            assert r["pronounceability"] == 0 == r["alternation"]
            continue
        longest = lambda kind: max((len(x) for x in "".join("v" if x else "c" for x in v).split("c" if kind == "v" else "v")), default=0)
        alternation = sum(x != y for x, y in zip(v, v[1:])) / (len(v) - 1) if len(v) > 1 else 0
        clip = lambda x: min(1, max(0, x))
        score = len(v) / len(r["a"]) * (0.32 * clip(1 - abs(sum(v) / len(v) - 0.42) / 0.42) + 0.28 * alternation + 0.25 * clip(1 - max(0, longest("c") - 2) / 4) + 0.15 * clip(1 - max(0, longest("v") - 2) / 3))
        assert math.isclose(r["alternation"], alternation) and math.isclose(r["pronounceability"], score)
    odd = spark.createDataFrame([("Ａlpha ﬁ-Ж_1",), (None,)], "a string")
    assert [r[0] for r in odd.select(H.canonical(F.col("a"))).collect()] == ["alpha?fi??_1", None]


def test_calibration_of_every_row(spark):
    rng = random.Random(2)
    rows = [(i, float(i % 40), int(rng.random() < (0.2 if 10 < i % 40 < 20 else 0.5))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, s double, hit int")
    bins = calibrate.confidence(df, "s", "hit")
    made = [r["probability"] for r in bins.orderBy("max_score").collect()]
    assert len(made) == 4 and made == sorted(made) and sum(r["n"] for r in bins.collect()) == 400
    assert math.isclose(sum(r["n"] * r["probability"] for r in bins.collect()), sum(h for _, _, h in rows))
    edges = sorted((r["max_score"], r["bin"]) for r in bins.collect())
    probe = spark.createDataFrame([(-1.0,), *((e,) for e, _ in edges), (99.0,)], "s double")
    assert [r["bin"] for r in calibrate.lookup_bin(probe, "s", bins).orderBy("s").collect()] == [edges[0][1], *(b for _, b in edges), edges[-1][1]]
    assert calibrate.confidence(df.limit(79), "s", "hit").count() == 0


def test_medians_and_first_results(spark):
    curve = spark.createDataFrame([("a", 1, 0.3), ("a", 5, 0.5), ("a", 9, 0.8), ("b", 4, 0.4)], "g string, d int, cumulative double")
    assert {tuple(r) for r in weighted.median_duration(curve, ["g"], "d").collect()} == {("a", 5), ("b", None)}
    rows = [(3, "n", "x", 9.0), (1, "n", "x", None), (2, "n", "x", 7.0), (4, "n", None, 5.0), (5, "n", "z", 6.0), (6, "m", "y", None), (7, None, "x", 1.0)]
    got = merge.first_by_source(spark.createDataFrame(rows, "i int, name string, source string, price double"), "name", "source", ["x", "y"], "i", ["price"]).collect()
    assert {tuple(r) for r in got} == {("n", 7.0, None, 5.0, 7.0), ("m", None, None, None, None)}


def test_tail_models_and_events_once(spark):
    df = spark.createDataFrame([(float(i), 10.0 * i) for i in range(200)] + [(1.0, None)], "x double, p double")
    made = models.tail_scores(df, ["x"], "p")
    assert list(made) == [100.0, 1000.0, 10000.0] and made[1000.0][1] > 0 and abs(made[10000.0]).max() < 1e-9
    sf = "/root/testdata/sf0.001"
    assert reference_queries.QUERIES["stream_events_once"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").select("event_id").distinct().count()


def test_running_totals_and_quantiles(spark):
    rng = random.Random(12)
    rows = [(rng.choice("ab"), float(rng.choice([1, 1, 1, 2, rng.randrange(500)]))) for _ in range(700)] + [("one", 4.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("before", F.lit("clash")).select("g", "v")
    counts = df.where("v is not null").groupBy("g", "v").agg(F.count("*").alias("n"))
    for r in weighted.running(counts, ["g"], "v", "n").collect():
        assert r["before"] == sum(g == r["g"] and v is not None and v < r["v"] for g, v in rows) and r["total"] == sum(g == r["g"] and v is not None for g, v in rows)
    import numpy as np

    for r in weighted.linear_quantiles(df, ["g"], "v", [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
        values = [v for g, v in rows if g == r["g"] and v is not None]
        for q in (0, 25, 50, 99, 100):
            assert math.isclose(r[f"q_{q}"], float(np.quantile(values, q / 100)), rel_tol=1e-12)
    assert weighted.linear_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0
    assert {r["g"]: r["q_50"] for r in weighted.linear_quantiles(spark.createDataFrame([(4.0,), (1.0,), (3.0,), (2.0,)], "v double").withColumn("g", F.lit("x")), ["g"], "v", [0.5]).collect()} == {"x": 2.5}


def packed(scores, bins):
    """Equal scores stay together; a bin is full when it holds its share of the rows from its last score on."""
    groups = [[s] * scores.count(s) for s in sorted(set(scores))]
    bins, out, now, used = min(max(1, bins), len(groups)), [], [], 0
    for i, g in enumerate(groups):
        now, share = now + g, -(-(len(scores) - used) // (bins - len(out)))
        used += len(g)
        if len(out) < bins - 1 and len(now) >= share and len(groups) - i - 1 >= bins - len(out) - 1:
            out.append(now)
            now = []
    return [*out, now] if now else out


def test_bins_are_packed(spark):
    rng = random.Random(2)
    for scores, bins in (([1, 1, 1, 1, 2, 3], 3), ([5] * 9, 4), ([1, 2], 5), ([rng.choice([0, 0, 0, rng.randrange(30)]) for _ in range(90)], 6), ([rng.randrange(8) for _ in range(60)], 8)):
        want = {s: i for i, b in enumerate(packed(scores, bins)) for s in b}
        df = spark.createDataFrame([(float(s),) for s in scores], "s double")
        assert {r["s"]: r["bin"] for r in weighted.tie_aware_bins(df, "s", bins).collect()} == want
    assert weighted.tie_aware_bins(spark.createDataFrame([], "s double"), "s", 3).count() == 0


def test_tolerant_match_at_any_size(spark):
    left = [(1, "a", 1e-7), (2, "a", 5e-13), (3, "a", 1.0), (4, "a", 123456.789), (5, "a", 2.0), (6, None, 1.0), (7, "a", None), (8, "a", -3.0)]
    right = [("a", 1e-7 + 9e-13), ("a", 1 + 9e-13), ("a", 123456.789 * (1 + 5e-13)), ("a", 2 + 4e-12), (None, 1.0), ("a", None), ("a", -3.0 - 1e-12)]
    l, r = spark.createDataFrame(left, "i int, k string, n double"), spark.createDataFrame(right, "k string, n double")
    assert sorted(x["i"] for x in merge.tolerant_match(l, r, "k", "n").collect()) == [1, 3, 4, 8]
