import base64
import binascii
import hashlib
import json
import math
import random

from pyspark.sql import functions as F

from namequarry.functions import numbers as N
from namequarry.functions.name_vector import named_features
from namequarry.operators import actions, calibrate, generate, lexicon, market
from namequarry.sources import sold_pages as pages
from namequarry.sources import statuses

DAY = 86_400_000
EVENT = (
    "row_id bigint, schemaVersion int, eventId string, identityKind string, eventType string, username string, eventAt string, event_ms bigint, observedAt string, observed_ms bigint, priceTon double, askTon double, reserveTon double, bidTon double, feesTon double, "
    "saleFormat string, marketPhase string, txHash string, nftItemAddress string, nftCollectionAddress string, counterparties struct<seller:string,buyer:string,bidder:string,from:string,to:string,owner:string>, "
    "provenance struct<source:string,parser:string,sourceUrl:string,requestedUrl:string,assetUrl:string,page:int,rowIndex:int,marketView:string,sourceEventId:string,snapshotHash:string>, confidence string"
)


def events(spark, *rows):
    names = [p.split()[0] for p in EVENT.split(", ")]
    base = {"eventType": "sale", "username": " @Alpha ", "observedAt": "t", "observed_ms": 9 * DAY, "priceTon": 5.0, "confidence": "medium", "provenance": {"source": "Market"}}
    made = [tuple((base | {"row_id": i} | r).get(n) for n in names) for i, r in enumerate(rows)]
    return market.canonical_events(spark.createDataFrame(made, EVENT).withColumn("place", F.lit("clash")))


def test_events_collect_all_errors(spark):
    digest = "sha256:" + "a" * 64
    rows = [
        {}, {"eventType": "gone", "username": "1x", "observed_ms": None, "priceTon": -1.0}, {"confidence": "high"}, {"confidence": "high", "event_ms": DAY, "eventAt": "t", "txHash": "x" * 20},
        {"eventType": "listed", "priceTon": None}, {"eventType": "bid"}, {"eventType": "mint", "priceTon": None, "bidTon": 1.0}, {"saleFormat": "fixed-price", "reserveTon": 1.0}, {"event_ms": 10 * DAY, "eventAt": "t"},
        {"counterparties": {"seller": "bob"}}, {"counterparties": {"seller": digest}, "nftItemAddress": "0:" + "AB" * 32, "provenance": {"source": "m", "sourceUrl": "HTTPS://Host.COM:443?a=1", "page": 0, "sourceEventId": " e1 "}}, {"eventId": "market:v1:other"}, {"provenance": None}, {"identityKind": "event"}, {"eventAt": "soon"},
    ]
    got = {r["row_id"]: r for r in events(spark, *rows).collect()}
    bad = {i: set(r["errors"]) for i, r in got.items()}
    assert bad[0] == set() and bad[1] == {"eventType", "username", "observedAt", "priceTon"} and bad[2] == {"saleTime", "saleEvidence"} and bad[3] == set()
    assert bad[4] == {"listedAsk"} and bad[5] == {"bid", "onlySalesPriced"} and bad[6] == {"moveAmounts"} and bad[7] == {"fixedPrice"} and bad[8] == {"order"}
    assert bad[9] == {"counterparties.seller"} and bad[10] == {"provenance.page"} and bad[11] == {"eventId"} and bad[12] == {"provenance.source"} and bad[13] == {"identityKind"} and bad[14] == {"eventAt"}
    assert got[0]["username"] == "alpha" and got[0]["identityKind"] == "observation-cluster" and got[0]["provenance"]["source"] == "market" and got[0]["effective_ms"] == 9 * DAY
    plain = "\0".join(["market-observation-cluster-v1", "market", "sale", "alpha"])
    assert got[0]["event_id"] == "market:v1:" + hashlib.sha256(plain.encode()).hexdigest()[:40]
    assert got[10]["provenance"]["sourceUrl"] == "https://host.com/?a=1" and got[10]["nftItemAddress"] == "0:" + "ab" * 32 and got[10]["identityKind"] == "event"
    for i, occurrence in ((3, "tx:" + "x" * 20), (10, "source-event:e1"), (8, "event:1970-01-11T00:00:00.000Z")):
        parts = "\0".join(["market-event-v1", "m" if i == 10 else "market", "sale", "alpha", occurrence])
        assert got[i]["event_id"] == "market:v1:" + hashlib.sha256(parts.encode()).hexdigest()[:40]


def test_migrated_sales(spark):
    schema = "row_id bigint, eventId string, username string, priceTon double, saleAt string, scrapedAt timestamp_ntz, source string, view string, confidence string, provenance struct<parser:string,sourceUrl:string,requestedUrl:string,assetUrl:string,page:int,rowIndex:int>, event_ms bigint, observed_ms bigint"
    rows = [(1, None, "Alpha", 5.0, "a", None, "S", None, "high", None, DAY, 9 * DAY), (2, None, "alpha", 5.0, "b", None, "S", None, "high", None, 2 * DAY, 9 * DAY), (3, "x", "alpha", 6.0, "b", None, None, None, "high", None, 2 * DAY, 9 * DAY), (4, None, "beta", 6.0, None, None, "S", "sold", "high", None, None, 9 * DAY), (5, None, "alpha", 5.0, "a", None, "s", None, None, None, DAY, 8 * DAY), (6, None, "no", 1.0, None, None, None, None, None, None, None, 1)]
    made = market.canonical_events(market.sales_as_events(spark.createDataFrame(rows, schema)))
    assert {r["row_id"]: r["confidence"] for r in made.collect()} == {1: "medium", 2: "medium", 3: "medium", 4: "low", 5: "medium", 6: "low"} | {3: "high"}
    got = market.merged(made).collect()  # one name at two times stays two events; copies are one, seen first on day 8
    assert sorted((r["username"], r["n"], r["observed_ms"]) for r in got) == [("alpha", 1, 9 * DAY), ("alpha", 1, 9 * DAY), ("alpha", 2, 8 * DAY), ("beta", 1, 9 * DAY)]


def lives(spark, *moves):
    schema = "event_id string, username string, eventType string, event_ms bigint, observed_ms bigint, askTon double, reserveTon double, priceTon double, txHash string, nftItemAddress string, source string, source_event string"
    rows = [(f"e{i:02d}", m.get("u", "alpha"), m["k"], m.get("d") if m.get("d") is None else m["d"] * DAY, 0, m.get("ask"), None, m.get("price"), None, m.get("nft"), m.get("m", "fixture"), m.get("id")) for i, m in enumerate(moves)]
    rng = random.Random(1)
    rng.shuffle(rows)
    out = market.lifecycles(market.asset_events(spark.createDataFrame(rows, schema))).collect()
    return sorted((r["outcome"], r["id"], r["status"], r["ask"], None if r["ended_ms"] is None else r["ended_ms"] // DAY, r["last_ms"] and r["last_ms"] // DAY, r["sale_price"]) for r in out)


def test_lifecycles(spark):
    listed, sale = {"k": "listed", "ask": 100.0}, {"k": "sale", "price": 90.0}
    assert lives(spark, listed | {"d": 1}, sale | {"d": 5}) == [("listing", "e00", "sold", 100.0, 5, 5, 90.0)]
    assert lives(spark, listed | {"d": 1}, listed | {"d": 3, "ask": 80.0}, sale | {"d": 5}) == [("listing", "e00", "cancelled", 100.0, 3, 3, None), ("listing", "e01", "sold", 80.0, 5, 5, 90.0)]
    # the same listing seen again at the same price goes on; at another price it is a new one
    assert lives(spark, listed | {"d": 1, "id": "L"}, listed | {"d": 4, "id": "L"}) == [("listing", "e00", "active", 100.0, None, 4, None)]
    # two markets: an end of a third fits neither, an end of one fits its own, by identity before that
    both = [listed | {"d": 1, "m": "a"}, listed | {"d": 2, "m": "b", "id": "B"}]
    assert [x[:3] for x in lives(spark, *both, sale | {"d": 5, "m": "c"})] == [("ambiguous", "e02", "sale"), ("listing", "e00", "active"), ("listing", "e01", "active")]
    assert [x[:3] for x in lives(spark, *both, sale | {"d": 5, "m": "b"})] == [("listing", "e00", "active"), ("listing", "e01", "sold")]
    # a name with one address ever is that asset, so a transfer of the item ends its listing; a sale at the same time comes first
    assert lives(spark, listed | {"d": 1}, {"k": "bid", "d": 2, "nft": "N"}, {"k": "transfer", "d": 3, "nft": "N"}) == [("listing", "e00", "cancelled", 100.0, 3, 3, None)]
    assert [x[:3] for x in lives(spark, listed | {"d": 1}, {"k": "transfer", "d": 3}, sale | {"d": 3})] == [("listing", "e00", "sold"), ("unmatched", "e01", "transfer")]
    assert [x[0] for x in lives(spark, {"k": "listed", "d": 1}, {"k": "listed", "ask": 5.0}, sale | {"d": 2})] == ["invalid", "unmatched"]
    assert market.as_listings(market.lifecycles(market.asset_events(spark.createDataFrame([], "event_id string, username string, eventType string, event_ms bigint, observed_ms bigint, askTon double, reserveTon double, priceTon double, txHash string, nftItemAddress string, source string, source_event string")))).count() == 0


def test_revisions(spark):
    key = lambda i: bytes([i] * 32).hex()
    rows = [
        (1, key(1), 0, json.dumps({"a": 1, "deep": {"x": 1, "l": [1, 2]}}), ["p", None, "q"]), (2, "0x" + key(1).upper(), 1, json.dumps({"b": 2, "deep": {"x": 3, "l": [1]}}), ["r", "q"]), (3, key(1), 0, json.dumps({"a": 9, "deep": {"y": 5}}), None),
        (4, key(2), None, "{", None), (5, key(2), 2, '{"z":true}', []), (6, "pending", 0, "{}", None), (7, None, 0, "{}", None),
    ]
    df = spark.createDataFrame(rows, "delivery_id bigint, action_id string, finality int, details string, accounts array<string>").withColumn("action_key", F.lit("clash"))
    got = {r["first_delivery"]: r for r in actions.merged_revisions(df).collect()}
    assert set(got) == {1, 4}
    assert json.loads(got[1]["details"]) == {"a": 1, "b": 2, "deep": {"x": 3, "y": 5, "l": [1]}} and got[1]["accounts"] == ["p", "q", "r"]
    assert (got[1]["revisions"], got[1]["last_delivery"], got[1]["finality"], got[1]["conflicts"]) == (3, 3, 1, ["details.a", "details.deep.x"])
    assert got[4]["details"] == '{"z":true}' and got[4]["finality"] == 2 and got[4]["conflicts"] == []
    assert actions.merged_revisions(df.limit(0)).count() == 0


def test_addresses(spark):
    body = bytes([0x11, 0xFF]) + bytes(range(32))
    friendly = base64.urlsafe_b64encode(body + binascii.crc_hqx(body, 0).to_bytes(2, "big")).decode()
    wrong = friendly[:-1] + ("A" if friendly[-1] != "A" else "B")
    given = [friendly, "-1:" + bytes(range(32)).hex().upper(), wrong, "-01:" + "0" * 64, "x", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, a) for i, a in enumerate(given)], "i int, a string").orderBy("i").select(actions.address_identity(F.col("a"))).collect()]
    assert got == ["-1:" + bytes(range(32)).hex()] * 2 + ["wire:" + wrong, "-1:" + "0" * 64, "wire:x", "wire:", None]


def test_lexicon(spark):
    words = spark.createDataFrame([(w,) for w in ("gold", "rush", "old", "crush", "bar", "bars", "and", "sand")], "word string")
    tokens = spark.createDataFrame([("gold",), ("bar",)], "token string")
    names = spark.createDataFrame([(n,) for n in ("gold", "goldrush", "gold_rush", "xgoldy", "barsand", "go1d", "12", "", None, "goldrush")], "name string")
    got = {r["name"]: r for r in lexicon.lexical_content(names, words, tokens).collect()}
    assert set(got) == {"gold", "goldrush", "gold_rush", "xgoldy", "barsand", "go1d", "12"}
    assert (got["gold"]["is_word"], got["gold"]["token_quality"]) == (1, 1.0)
    assert got["goldrush"]["words"] == ["gold", "rush"] and got["goldrush"]["two_words"] == 1 and got["goldrush"]["token_quality"] == 0.85 and got["goldrush"]["coverage"] == 1.0
    assert got["gold_rush"]["two_words"] == 1 and got["gold_rush"]["words"] == ["gold", "rush"]
    assert got["xgoldy"]["words"] == ["gold"] and abs(got["xgoldy"]["coverage"] - 4 / 6) < 1e-12 and got["xgoldy"]["token_quality"] == 0.0
    assert got["barsand"]["words"] == ["bar", "sand"] and got["go1d"]["contains_word"] == 0  # the first found of two ways with the same shortest part
    assert lexicon.segmented("barsandold", {"bars", "and", "bar", "sand", "old", "barsand"}) == ["barsand", "old"]
    assert lexicon.match_quality("rushgoldbar", "gold", {"rush", "bar"}) == 0.72


def test_sold_pages(spark):
    row = lambda name, price, status, when="", more="": f"<tr><td><div class='table-cell-value-row'><span class='tm-value'>{name}</span></div></td><td>{more} <span class='icon-ton'>{price}</span></td><td class='table-cell-status-thin'>{status}</td><td>{when}</td></tr>"
    at = "<time datetime='2024-01-02T03:04:05+00:00'></time>"
    table = "<form><input name='sort' value='Ended'></form><table class='tm-table'><tbody>" + row("@Alpha", "1,583,948", "Sold", at, "Sale price") + row("beta_1", "12,345.75", "Sold") + row("gamma", "5", "On auction", "", "Minimum bid") + row("delta", "x", "Sold") + row("epsilon", "7", "Sold", "<time datetime='soon'>") + row("zeta1", "3", "", at, "Sale price") + "</tbody></table>"
    script = "<script>window.x = " + json.dumps({"list": [{"username": "@Kappa", "salePriceTon": "10", "soldAt": "2024-05-05T00:00:00Z"}, {"handle": "lambda", "priceTon": 3, "status": "listed", "date": "2024-05-05T00:00:00Z"}, {"handle": "lambda", "priceTon": 3}]}) + ";</script>"
    text = f"<body>@omega was Sold for a Sale price of 15 TON {at}</body>"
    df = spark.createDataFrame([(1, table), (2, script), (3, text), (4, text + " @other 5 TON"), (5, None), (6, ""), (7, "<tr><td")], "page_id bigint, html string").withColumn("reason", F.lit("clash"))
    got = [(r["page_id"], r["username"], r["price"], r["sale_at"], r["confidence"], r["reason"]) for r in pages.sold_pages(df).collect()]
    t = "2024-01-02T03:04:05.000Z"
    assert got == [
        (1, "alpha", 1583948.0, t, "high", None), (1, "beta_1", 12345.75, None, "medium", None), (1, "delta", None, None, None, "no sale price"), (1, "epsilon", None, None, None, "invalid sale time"), (1, "zeta1", 3.0, t, "high", None),
        (2, "kappa", 10.0, "2024-05-05T00:00:00.000Z", "medium", None), (2, "lambda", None, None, None, "no evidence of a sale"), (2, "lambda", None, None, None, "no exact sale time"),
        (3, "omega", 15.0, t, "low", None), (4, "omega", None, None, None, "no single sale and time"), (4, "other", None, None, None, "no evidence of a sale"),
    ]
    assert [r[0] for r in df.orderBy("page_id").select(pages.listing_view(F.col("html"), F.lit("http://x/?sort=price"))).collect()][:2] == ["ended", "price"]
    more = pages.sold_pages(df).unionByName(pages.sold_pages(df.where("page_id = 1")).withColumn("price", F.when(F.col("username") == "zeta1", 4.0).otherwise(F.col("price"))))
    kept, conflicting = pages.unique_sales(more)
    assert sorted((r["username"], r["copies"]) for r in kept.collect()) == [("alpha", 2), ("beta_1", 2), ("kappa", 1), ("omega", 1)]
    assert [(r["username"], r["lowest"], r["highest"]) for r in conflicting.collect()] == [("zeta1", 3.0, 4.0)]


def test_generated(spark):
    words = spark.createDataFrame([(w,) for w in ("gold", "goldbar", "x", "It's", None)], "w string")
    assert {r[0] for r in generate.dictionary_names(words, "w", "none", 4, 6, 1).collect()} == {"gold", "goldba"}
    for policy in ("optional", "required"):
        names = [r[0] for r in generate.dictionary_names(words, "w", policy, 6, 8, 1).collect()]
        assert len(names) == 3 and all(6 <= len(n) <= 8 for n in names)
        assert policy == "optional" or all(n[-1].isdigit() for n in names)
    for position, ok in (("start", lambda n: n.startswith("gold")), ("end", lambda n: n.endswith("gold")), ("middle", lambda n: "gold" in n), ("any", lambda n: "gold" in n)):
        names = [r[0] for r in generate.with_word(spark, 50, "gold", position, 6, 10, 3).collect()]
        assert len(names) > 10 and all(ok(n) and 6 <= len(n) <= 10 for n in names)
    assert generate.with_word(spark, 5, "golden", "any", 4, 5, 3).count() == 0
    left, right = spark.createDataFrame([("a",), ("b",)], "w string"), spark.createDataFrame([(f"w{i}",) for i in range(40)], "w string")
    got = [r[0] for r in generate.compounds(left, right, "w", 5, 7).collect()]
    assert sum(n.startswith("a") for n in got) == 7 and sum(n.startswith("b") for n in got) == 7


def test_numbers(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(N.price_from_log(F.lit(float("nan")))) == 0 and one(N.price_from_log(F.lit(None).cast("double"))) == 0 and one(N.price_from_log(F.lit(-1.0))) == 0 and abs(one(N.price_from_log(F.lit(99.0))) - 1e12) < 1
    assert one(N.blended(F.lit(10.0), F.lit(0.0), F.lit(1.0), 0.5)) == 10.0 and abs(one(N.blended(F.lit(9.0), F.lit(99.0), F.lit(2.0), 0.5)) - (1000**0.5 - 1)) < 1e-9
    assert one(N.softmax(F.array(F.lit(1.0), F.lit(1.0)), 1.0)) == [0.5, 0.5] and one(N.softmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)), 0)) == [0.0, 1.0, 0.0] and one(N.softmax(F.array().cast("array<double>"))) == []
    assert one(N.standardized(F.array(F.lit(3.0), F.lit(5.0)), [1.0, 5.0], [2.0, 0.0])) == [1.0, 0.0]
    assert [one(N.confidence_label(F.lit(x))) for x in (0.72, 0.42, 0.1)] == ["high", "medium", "low"] and one(N.safe_ratio(F.lit(1.0), F.lit(0.0))) == 0
    assert abs(one(N.evidence_weight(F.lit("low"), F.lit("fragment-text"), F.lit(False))) - 0.4 * 0.7 * 0.9) < 1e-12


def test_collected_pages(spark):
    schema = "page_no int, place int, action_key string, end_utime bigint"
    pages_ = [(0, 0, "a", 1), (0, 1, "b", 1), (1, 0, "b", 1), (1, 1, "c", 1), (2, 0, "d", 9), (3, 0, "e", 1), (3, 1, "f", 1)]
    once, summary = actions.collected(spark.createDataFrame(pages_, schema), 2, most_pages=2)
    assert sorted(tuple(r) for r in once.collect()) == [("a", 1, 0, 0), ("b", 2, 0, 1), ("c", 1, 1, 1)]
    assert tuple(summary.first()) == (2, 4, 3, 1, False, 4)
    once, summary = actions.collected(spark.createDataFrame(pages_, schema), 2, snapshot=5)  # page 2 isn't full: the last; what ended later isn't taken
    assert {r["action_key"] for r in once.collect()} == {"a", "b", "c"} and tuple(summary.first()) == (3, 4, 3, 1, True, 6)
    assert tuple(actions.collected(spark.createDataFrame(pages_, schema), 2, most_rows=3)[1].first())[:2] == (1, 2)
    assert tuple(actions.collected(spark.createDataFrame([], schema), 2)[1].first())[1:4] == (0, 0, 0)


def test_sold_history(spark):
    schema = "row_id bigint, username string, priceTon double, saleAt string, event_ms bigint, observed_ms bigint, source string, confidence string"
    rows = [
        (1, "Alpha", 5.0, None, None, 10, "s", "high"), (2, "alpha", 5.0, "t", 3, 20, "s", "high"), (3, "alpha", 5.0, "t", 3, 30, "s", "medium"), (4, "alpha", 7.0, "t", 4, 20, "s", "low"), (5, "alpha", 8.0, "t", 4, 21, "s", "low"),
        (6, "beta", 1.0, None, None, 5, "s", None), (7, "beta", 2.0, None, None, 6, "s", "medium"), (8, "no", 1.0, None, None, 5, "s", None), (9, "gamma", -1.0, "soon", None, None, "s", None), (10, "gamma", 1.0, "t", 9, 8, "s", None),
    ]
    valid = market.valid_sales(spark.createDataFrame(rows, schema))
    assert {r["row_id"]: set(r["errors"]) for r in valid.where(F.size("errors") > 0).collect()} == {8: {"username"}, 9: {"priceTon", "scrapedAt", "saleAt"}, 10: {"order"}}
    got = sorted((r["username"], r["event_ms"] or 0, r["price"], r["confidence"], r["n"], r["conflict"], r["event_id"] is None) for r in market.sold_history(valid).collect())
    assert got == [("alpha", 3, 5.0, "medium", 2, False, False), ("alpha", 4, 8.0, "low", 2, True, False), ("beta", 0, 2.0, "low", 2, False, True)]


def test_thresholds_and_seeded_numbers(spark):
    def plain(values, bins):
        ordered, out = sorted(values), []
        for b in range(1, bins):
            at = b * len(ordered) // bins
            if 0 < at < len(ordered) and ordered[at - 1] < ordered[at] and ordered[at - 1] not in out:
                out.append(ordered[at - 1])
        return out

    rng = random.Random(4)
    for values, bins in (([1, 1, 2, 3], 4), ([5] * 6, 3), ([rng.randrange(9) for _ in range(50)], 8), ([rng.random() for _ in range(70)], 16)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        assert calibrate.quantile_thresholds(df, "v", bins) == [float(v) for v in plain(values, bins)]
    assert calibrate.quantile_thresholds(spark.createDataFrame([], "v double"), "v", 4) == []

    def numbers(seed, n):
        state, out, m = seed, [], 0xFFFFFFFF
        for _ in range(n):
            state = (state + 0x6D2B79F5) & m
            v = ((state ^ state >> 15) * (state | 1)) & m
            v = ((v + (((v ^ v >> 7) * (v | 61)) & m)) & m) ^ v
            out.append((v ^ v >> 14) / 2**32)
        return out

    for seed in (0, 7, 2**32 - 1, -5):
        got = [r[0] for r in spark.range(1, 40).select(N.uniform(seed, F.col("id"))).collect()]
        assert got == numbers(seed & 0xFFFFFFFF, 39)


def test_named_features(spark):
    rng = random.Random(6)
    names = {"", "a", "aa", "abc", "cba1", "1234", "qwerty", "asdfgh9", "a_b__c_", "_x_", "aabbcc", "abab", "level", "x?z", "aeiou", "bcdfg", "n0n0n0", "zyx_987"} | {"".join(rng.choice("abcdexyz019_?") for _ in range(rng.randrange(1, 12))) for _ in range(60)}
    empty = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("token_quality", "is_word", "contains_word", "two_words", "word_count", "coverage", "longest_ratio", "quality", "token_count", "token_coverage", "separated_tokens")))
    made = named_features(F.col("name"), empty)
    assert len(made) == 65
    got = {r["name"]: r.asDict() for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", *(c.cast("double").alias(f"f_{k}") for k, c in made.items())).collect()}
    over = lambda a, b: a / b if b > 0 else 0.0
    near = {x for row in ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm") for a, b in zip(row, row[1:]) for x in (a + b, b + a)}

    def entropy(items, alphabet):
        n = len(items)
        return 0.0 if n <= 1 else min(1.0, -sum(items.count(x) / n * math.log2(items.count(x) / n) for x in set(items)) / math.log2(min(n, alphabet)))

    def longest(marks):
        best = now = 0
        before = None
        for m in marks:
            now = now + 1 if m and m == before else 1 if m else 0
            before, best = m, max(best, now)
        return best

    for n in names:
        pairs = [n[i : i + 2] for i in range(len(n) - 1)]
        same_kind = lambda p: all("a" <= c <= "z" for c in p) or all(c.isdigit() for c in p)
        steps = [ord(p[1]) - ord(p[0]) if same_kind(p) else 0 for p in pairs]
        steps = [s if abs(s) == 1 else 0 for s in steps]
        want = {
            "repeat_run": longest(list(n)), "syllable_regularity": over(sum((p[0] in "aeiou") != (p[1] in "aeiou") for p in pairs), len(pairs)), "vowel_ratio": over(sum(c in "aeiou" for c in n), len(n)),
            "unique_ratio": over(len(set(n)), len(n)), "same_ends": float(bool(n) and n[0] == n[-1]), "palindrome": float(bool(n) and n == n[::-1]), "repeats": sum(p[0] == p[1] for p in pairs), "repeated_kinds_ratio": over(sum(n.count(c) > 1 for c in set(n)), len(set(n))),
            "duplicate_bigram_ratio": over(len(pairs) - len(set(pairs)), len(pairs)), "ascending_ratio": over(steps.count(1), len(pairs)), "descending_ratio": over(steps.count(-1), len(pairs)), "ordinal_run_ratio": (longest(steps) + 1) / len(n) if pairs else 0.0,
            "keyboard_ratio": over(sum(p in near for p in pairs), len(pairs)), "keyboard_run_ratio": (longest([p in near for p in pairs]) + 1) / len(n) if pairs else 0.0, "char_entropy": entropy(list(n), 38), "bigram_entropy": entropy(pairs, 1444), "invalid": n.count("?"), "double_underscore": float("__" in n),
        }
        for k, v in want.items():
            assert abs(got[n][f"f_{k}"] - v) < 1e-9, (n, k, got[n][f"f_{k}"], v)


def test_statuses(spark):
    answers = [(True, None, None, "yes"), (False, None, None, "no"), (None, "USERNAME_INVALID", 400, "invalid"), (None, "x: username_occupied", 400, "no"), (None, "USERNAME_PURCHASE_AVAILABLE", 400, "no"), (None, "a wait of 30 seconds", 420, "unknown"), (None, "reset", None, "unknown"), (None, None, None, "unknown")]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(answers)], "i int, result boolean, error string, code int, want string").orderBy("i")
    got = df.select(statuses.answer_status(F.col("result"), F.col("error"), F.col("code")).alias("s"), "want", statuses.wait_seconds(F.col("error")).alias("w")).collect()
    assert [r["s"]["available"] for r in got] == [r["want"] for r in got] and [r["w"] for r in got] == [None] * 5 + [30, None, None]
    row = lambda name, status, more: f"<a class='tm-row-selectable'><span class='tm-value'>{name}</span><i class='table-cell-status-thin'>{status}</i>{more}</a>"
    pages_ = [
        (None, "unknown", "low"), ("<body>Verify you are human</body>", "unknown", "low"), ("<body>Page not found</body>", "unknown", "high"), ("<body>Someone already claimed this username on telegram.</body>", "no", "high"),
        ("<div class='tm-section-header-status tm-x'> On auction </div>", "no", "high"), (row("@other", "Sold", "") + row("@Alpha", "Unavailable", "Not for sale"), "yes", "low"), (row("alpha", "Taken", ""), "no", "high"), ("<body>Highest bid: 1,200 TON</body>", "no", "low"), ("<body>nothing sold</body>", "yes", "low"), ("", "yes", "low"),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages_)], "i int, html string, a string, c string").orderBy("i")
    assert [(r["s"]["available"], r["s"]["confidence"]) for r in df.select(statuses.listing_status(F.col("html"), F.lit("alpha")).alias("s")).collect()] == [p[1:] for p in pages_]
    profiles = [("<title> Telegram: Contact  @Alpha</title>", "yes"), ("<title>Telegram: Contact @alpha</title><p class=tgme_page_extra>", "no"), ("<title>Al</title>", "no"), (None, "unknown")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(profiles)], "i int, html string, want string").orderBy("i")
    assert [r["s"]["available"] for r in df.select(statuses.profile_status(F.col("html"), F.lit("alpha")).alias("s")).collect()] == [p[1] for p in profiles]
    checked = spark.createDataFrame([("a", "no"), ("b", "invalid"), ("c", "yes"), ("d", "unknown"), (None, "no")], "name string, available string")
    assert sorted(r[0] for r in statuses.still_open(spark.createDataFrame([(x,) for x in ("a", "b", "c", "d", "e", None)], "name string"), checked).collect()) == ["c", "d", "e"]
