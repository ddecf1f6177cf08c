import random

import pytest
from pyspark.sql import functions as F

from namequarry.llm.components import component_labels
from namequarry.llm.incremental_dedup import SaleIndex
from namequarry.llm.mixing import Mix, pfair_schedule
from namequarry.llm.queries import p9_sequence, p9_shares, p9_shares_met
from namequarry.llm.residue import residue_documents, validation, weak_labels
from namequarry.llm.survivors import survivor_rows, survivors
from namequarry.llm.tokenize import VOCABULARY, Encoder, encoded, token_counts

SALE = "row_id bigint, batch_no int, event_id string, name string, price double, ms bigint"


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def plain_roots(rows):
    s = Sets()
    for i, a in enumerate(rows):
        s.find(a[0])
        for b in rows[:i]:
            same = a[2] is not None and a[2] == b[2]
            near = None not in (a[3], b[3], a[4], b[4], a[5], b[5]) and a[3] == b[3] and a[4] > 0 and b[4] > 0 and abs(a[5] - b[5]) <= 600_000 and abs(a[4] - b[4]) <= 0.01 * max(a[4], b[4]) + 1e-9
            if same or near:
                s.join(a[0], b[0])
    return {r[0]: s.find(r[0]) for r in rows}


def test_sales_against_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for i in range(220):
        dense = i % 2
        ms = rng.randrange(0, 3_000_000) if dense else rng.randrange(0, 80_000_000)
        price = round(rng.uniform(100, 104), 2) if dense else round(rng.uniform(1, 500), 2)
        rows.append((i, i * 3 // 220, rng.choice([None, f"id{rng.randrange(150)}"]), rng.choice(["a", "b", None]), rng.choice([price, price, None, -1.0, 0.0]), rng.choice([ms, ms, None])))
    rows += [(300 + i, 2, None, "copy", 10.0, 5) for i in range(40)] + [(400, 2, None, "exact", 100.0, 0), (401, 2, None, "exact", 99.0, 600_000), (402, 2, None, "exact", 98.0, 600_000), (403, 2, "id1", None, None, None)]
    df = spark.createDataFrame(rows, SALE).withColumn("token", F.lit("clash")).cache()
    index = SaleIndex(spark)
    for no in range(3):
        index.ingest(df.where(F.col("batch_no") == no))
    assert {r["row_id"]: r["root"] for r in index.assigned().collect()} == plain_roots(rows)
    posted = index._read(index._state(), "post").where("kind <> 'e'")
    assert {r["kind"] for r in posted.select("kind").distinct().collect()} == {"t", "p"}


def test_sales_in_many_small_batches(spark):
    rng = random.Random(9)
    rows = [(i, i // 12, rng.choice([None, f"id{rng.randrange(40)}"]), rng.choice("ab"), round(rng.uniform(100, 103), 2), rng.randrange(0, 4_000_000)) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SALE).cache()
    index = SaleIndex(spark, buckets=512, fanout=2)  # fewer tokens than buckets: reads are pruned; every batch compacts
    for no in range(5):
        given = index.ingest(df.where(F.col("batch_no") == no), label=f"batch {no}").count()
        assert given == 12
    assert len(index._state()["generations"]) < 4
    index.ingest(df.where("batch_no = 4"), label="batch 4")  # delivered again
    index.files.put(f"{index.path}/gen=left/part=post/broken", "by a failed run")
    index.vacuum()
    assert {r["row_id"]: r["root"] for r in index.assigned().collect()} == plain_roots(sorted(rows))
    assert index.assigned().count() == 60 and "gen=left" not in index.files.names(index.path)


def test_sales_of_nothing(spark):
    index = SaleIndex(spark)
    assert index.ingest(spark.createDataFrame([], SALE)).count() == 0
    index.ingest(spark.createDataFrame([(1, 1, None, None, None, None)], SALE))
    assert [tuple(r) for r in index.assigned().collect()] == [(1, 1, 1)]


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 500 + i) for i in range(50)] + [(rng.randrange(700, 800), rng.randrange(700, 800)) for _ in range(60)] + [(3, 3), (None, 1)]
    s = Sets()
    for a, b in edges:
        if a is not None:
            s.join(a, b)
    got = {r["node"]: r["label"] for r in component_labels(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: s.find(x) for x in list(s.up)}
    assert component_labels(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_survivors_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        prov = rng.choice([None, {"source": rng.choice([None, " ", "s"]), "page": rng.choice([None, 1])}])
        rows.append((i, rng.choice([None, "a", "b", "c", f"x{i}"]), rng.choice(["high", " High", "medium", "LOW", "?", None, ""]), rng.choice(["event", "", " ", None]), prov, "t", rng.choice([None, 7]), rng.choice([None, 1, 2, 3])))
    schema = "row_id bigint, event_id string, confidence string, identityKind string, provenance struct<source:string,page:int>, eventAt string, event_ms bigint, observed_ms bigint"
    df = spark.createDataFrame(rows, schema).withColumns({"trust": F.lit("clash"), "n": F.lit(0)})
    got = {tuple(r) for r in survivor_rows(survivors(df, ["source", "page"])).collect()}
    grade = {"high": 0, "medium": 1, "low": 2}
    want = set()
    for e in "abc":
        group = [r for r in rows if r[1] == e]
        full = lambda p: sum(v is not None and str(v).strip() != "" for v in (p or {}).values())
        group.sort(key=lambda r: (grade.get((r[2] or "").strip().lower(), 3), -full(r[4]), -(r[7] if r[7] is not None else -99), r[0]))
        for field, ok in (("confidence", lambda r: (r[2] or "").strip().lower() in grade), ("eventAt", lambda r: r[6] is not None), ("identityKind", lambda r: (r[3] or "").strip() != ""), ("provenance", lambda r: r[4] is not None)):
            first = next((r for r in group if ok(r)), None)
            if first:
                want.add((e, field, first[0]))
    assert got == want
    assert survivors(df.limit(0), ["source", "page"]).count() == 0


def test_tokens_match_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    rng = random.Random(6)
    texts = ["", " ", "a" * 5000, "Hello, world's 123\n\n  x", "日本の名前 ﬁ é 👩‍💻", "<|endoftext|>", "\t|\t", "".join(rng.choice("abcdef ,.\n") for _ in range(20_000))]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in encoded(df).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids for i, x in enumerate(texts)} | {99: []}
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(df, "doc_id").collect()} == {k: len(v) for k, v in got.items()}
    assert encoded(df.limit(0)).count() == 0
    with open(VOCABULARY, "rb") as f:
        e = Encoder(f.read(), remembered=2)
    assert e("one two three four one") == t.encode("one two three four one").ids


def test_pfair_stays_within_one_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    done = dict.fromkeys(weights, 0)
    order = pfair_schedule(weights, 400)
    assert len(order) == 400
    for slot, source, block in order:
        assert block == done[source]
        done[source] += 1
        assert all(abs(done[s] - w * (slot + 1)) < 1 for s, w in weights.items())
    assert pfair_schedule({}, 10) == []


def test_mix(spark):
    rows = [(i, "big", 10) for i in range(300)] + [(1000 + i, "small", 10) for i in range(10)] + [(2000, "other", 10), (2001, None, 10), (2002, "big", 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint").withColumn("slot", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.8, 1), ("small", 0.15, 3), ("none", 0.05, 2)], "source string, target_weight double, max_repeats int")
    mix = Mix(sized, targets, slots=100)
    shares = {r["source"]: r for r in mix.shares().collect()}
    assert mix.total == 2000 and shares["none"]["actual_share"] == 0 and shares["small"]["most_repeats"] == 3
    assert abs(shares["big"]["actual_share"] - 0.8 / 0.95) < 0.01
    uses = mix.sequence().collect()
    assert {r["source"] for r in uses} == {"big", "small"} and max(r["copy"] for r in uses if r["source"] == "big") == 0
    short = {r["source"]: r for r in Mix(sized, targets, "corpus", slots=100).shares().collect()}
    assert short["small"]["mixed_tokens"] == 300
    assert Mix(sized.limit(0), targets).sequence().count() == 0


def test_mix_queries_use_the_corpus(spark, tmp_path):
    rows = [(i, "a name was sold again at a price", "big") for i in range(200)] + [(900, "a name", "tiny")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("big", 0.8, 1), ("tiny", 0.2, 1)], "source string, target_weight double, max_repeats int").write.parquet(f"{tmp_path}/mix_targets.parquet")
    got = {r["source"]: r for r in p9_shares(spark, str(tmp_path)).collect()}
    assert got["big"]["uses"] == 160 and got["big"]["short_tokens"] == 0
    assert got["tiny"]["uses"] == 1 and got["tiny"]["short_tokens"] > 0
    assert p9_sequence(spark, str(tmp_path)).count() == 161
    met = {r["source"]: r for r in p9_shares_met(spark, str(tmp_path)).collect()}
    assert met["big"]["uses"] < 5 and met["tiny"]["short_tokens"] == 0


def test_residue(spark):
    sound = [f"The auction for name{i} closed at {i + 10} TON after {i % 9} bids, and the seller moved it to another wallet the same evening." for i in range(120)]
    sound += [f"In the alert editor you write `{{{{username}}}}` where name{i} should appear in every mail of the auction seller." for i in range(12)]
    sound += [f"A wallet called undefined_{i} outbid me by {i} TON and I moved the name to another wallet." for i in range(12)]
    bad = ["Please enable JavaScript to view this page.", "404 Not Found\nThe page does not exist or was moved.", "Lorem ipsum dolor sit amet, consectetur elit.", "Too many requests. Slow down and try again in 9 seconds."] * 12
    marked = ["Dear {{seller_name}}, your listing of ${item.price} has ended.", "Ask: [object Object] TON, listed [insert name here]"] * 6
    tricky = ["In the editor you write `{{username}}` where the name of the auction should appear in every mail of the seller.", "They asked me to enable JavaScript, I did, and the bid of 14 TON went through after the auction closed.", "A wallet called undefined_4 outbid me by 20 TON and the seller moved the name to another wallet.", "", "  ", " ", None]
    texts = sound + bad + marked + tricky
    df = spark.createDataFrame([(i, t, "abcd"[i % 4]) for i, t in enumerate(texts)], "doc_id bigint, text string, source string").withColumn("label", F.lit("clash"))
    got = {r["doc_id"] for r in residue_documents(df).collect()}
    first = len(sound)
    assert got == set(range(first, first + len(bad) + len(marked)))
    assert residue_documents(df.limit(0)).count() == 0
    assert residue_documents(df.where("doc_id < 50")).count() == 0
    assert {r["source"] for r in validation(df).collect()} <= set("abcd")


def test_residue_beside_the_rules(spark):
    """Wordings, marks and headings that no rule names are found by the classifier, texts of any length alike."""
    sound = [f"The auction for name{i} closed at {i + 10} TON after {i % 9} bids, and the seller moved it to another wallet the same evening." for i in range(150)]
    bad = ["# 404 Not Found", "# Page not found", "Something went wrong while loading the page. Reload it in a minute.", "Something went wrong on our side. Reload it in a minute.", "Please enable JavaScript to load the page."] * 8
    marked = [f"Dear {{{{seller_{w}}}}}, your listing has ended." for w in ("name", "mail", "link", "item")] * 4
    texts = sound + bad + marked + ["# 404 Not Found", "Dear {{bidder}}, your listing has ended.", ("Something went wrong on our side. " * 300).strip()]
    df = spark.createDataFrame([(i, t, "abcd"[i % 4]) for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = {r["doc_id"] for r in residue_documents(df).collect()}
    assert got == set(range(len(sound), len(texts)))


def test_placeholders_like_tags_are_no_markup(spark):
    texts = ["The seller asks <PRICE> TON for the name today.", "<NAME>", "<p>The seller asks 5 TON for the <b>name</b> today.</p>"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    assert {r["doc_id"] for r in weak_labels(df).where("label = 2").collect()} == {0, 1}


def test_residue_counts_all_documents(spark):
    # more documents than one fit was once given: all are counted, on hosts that weren't trained on
    text = F.when(F.col("id") % 10 == 0, "404 Not Found. The requested page could not be found.").when(F.col("id") % 10 == 1, "Dear {{ buyer_name }}, welcome.").otherwise("A quiet name sold in spring for a fair price.")
    df = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), F.col("id") % 8).alias("source"), text.alias("text"))
    want = {r["source"]: r["count"] for r in weak_labels(df).where("label is not null").groupBy("source").count().collect()}
    got = {r["source"]: r["segments"] for r in validation(df).collect()}
    assert got and got.keys() < want.keys() and all(got[s] == want[s] for s in got)
