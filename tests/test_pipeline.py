import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namequarry.operators.delivery import id_bytes, split_deliveries
from namequarry.operators.intervals import IntervalMap, gaps, merged_periods, stream_gaps
from namequarry.operators.late import CorrectedCounts
from namequarry.operators.nested import nested_children
from namequarry.operators.timestamps import InstantDictionary, denormal_times, normalised
from namequarry.session import Files, work_dir
from namequarry.skew import join_counted

DAY = 86_400_000


def plain(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20)), max_size=30))
def test_interval_map(rows):
    m = IntervalMap()
    for s, n in rows:
        m.insert(s, s + n)
    want = plain([(s, s + n) for s, n in rows])
    assert m.periods() == want
    assert m.gaps() == [(a[1], b[0]) for a, b in zip(want, want[1:])]


def test_gaps_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for name in "abcd":
        for _ in range(rng.choice([1, 3, 60])):
            s = rng.randrange(0, 40 * DAY)
            rows.append((name, s, s + rng.choice([0, -5, 1, DAY // 3, DAY, 9 * DAY])))
    rows += [("a", 5, 6)] * 50 + [(None, 1, 2), ("b", None, 3), ("b", 3, None)]
    df = spark.createDataFrame(rows, "entity string, start bigint, stop bigint").withColumn("block", F.lit("clash"))
    want, periods = set(), set()
    for name in "abcd":
        p = plain([(s, e) for n, s, e in rows if n == name and s is not None and e is not None and s < e])
        periods |= {(name, *x) for x in p}
        want |= {(name, a[1], b[0]) for a, b in zip(p, p[1:])}
    assert {tuple(r) for r in gaps(df).collect()} == want
    assert {tuple(r) for r in merged_periods(df).collect()} == periods
    assert gaps(df.limit(0)).count() == 0


def test_gaps_of_a_stream(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice("abc"), s, s + rng.choice([0, 1, DAY // 3, DAY, 9 * DAY])) for s in (rng.randrange(0, 60 * DAY) for _ in range(120))] + [(None, 1, 2), ("a", None, 3)]
    schema = "entity string, start bigint, stop bigint"
    for i in range(4):  # four batches, whose intervals overlap and fill gaps of earlier ones
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in gaps(spark.createDataFrame(rows, schema)).collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert {tuple(r) for r in stream_gaps(stream).collect()} == want and want


def test_deliveries(spark):
    key = bytes(range(32))
    import base64

    b64 = base64.b64encode(key).decode()
    texts = [b64, key.hex(), "0x" + key.hex().upper(), b64.rstrip("="), b64.replace("+", "-").replace("/", "_"), f"  {b64}\n", b64.replace("=", "%3D").replace("+", "%2B"), "pending", "", None, "0x", b64[:-4]]
    df = spark.createDataFrame(list(enumerate(texts)), "d bigint, a string").withColumn("n", F.lit(1))
    assert [r[0] is not None for r in df.orderBy("d").select(id_bytes(F.col("a"))).collect()] == [True] * 7 + [False] * 5
    kept, repeats = split_deliveries(df, "a", "d")
    assert sorted(r["d"] for r in kept.collect()) == [0, 7, 8, 9, 10, 11]
    assert sorted(r["d"] for r in repeats.collect()) == [1, 2, 3, 4, 5, 6]
    kept, repeats = split_deliveries(df.where("d > 2"), "a", "d", stored=df.where("d <= 2"))
    assert kept.count() == 6 and repeats.count() == 6
    assert split_deliveries(df.limit(0), "a", "d")[0].count() == 0


def test_nested(spark):
    legs = [{"leg_id": "a", "fees": {"0": {"fee_id": "f0"}, "1": None, "2": {"fee_id": "f2"}}}, None, json.dumps({"legId": "b", "Fees": json.dumps([{"feeId": "x"}])}), 7, {"asset": 1}]
    details = [json.dumps({"legs": legs}), json.dumps(json.dumps({"legs": {"leg_id": "solo"}})), '{"legs": [', None, "null", "", json.dumps({"legs": {}})]
    tx = [json.dumps({"in_msg": {"hash": "i"}, "outMsgs": [{"hash": "o0"}, None, {"hash": "o2"}]}), None, "{bad", json.dumps({"in_msg": json.dumps({"hash": "j"}), "out_msgs": {"hash": "k"}})]
    rows = [(i, d, tx if i == 0 else [] if i == 1 else None, ["p", None, "q"] if i == 0 else None) for i, d in enumerate(details)]
    df = spark.createDataFrame(rows, "delivery_id bigint, details string, transactions_full array<string>, accounts array<string>").withColumn("row_key", F.lit("clash"))
    got = {tuple(r) for r in nested_children(df).collect()}
    assert got == {
        (0, "leg", 0, 0, "a"), (0, "leg", 0, 2, "b"), (0, "leg", 0, 4, None), (0, "fee", 0, 0, "f0"), (0, "fee", 0, 2, "f2"), (0, "fee", 2, 0, "x"), (1, "leg", 0, 0, "solo"),
        (0, "in_msg", 0, 0, "i"), (0, "out_msg", 0, 0, "o0"), (0, "out_msg", 0, 2, "o2"), (0, "in_msg", 3, 0, "j"), (0, "out_msg", 3, 0, "k"), (0, "account", 0, 0, "p"), (0, "account", 0, 2, "q"),
    }
    assert nested_children(df.limit(0)).count() == 0


def test_dictionary_is_incremental(spark):
    rows = spark.createDataFrame([(1, "1714557600", None, None), (2, "soon", None, None), (3, None, None, None), (4, "1714557600", None, None)], "row_key bigint, raw string, zone string, day_order string")
    d = InstantDictionary(spark)
    assert {r["row_key"] for r in normalised(rows, d).collect()} == {1, 4}
    assert d.entries().count() == 2
    more = spark.createDataFrame([(9, "1714557601", None, None), (8, "1714557600", None, None)], rows.schema)
    assert {r["row_key"] for r in normalised(more, d).collect()} == {8, 9}
    assert len(d.generations()) == 2 and spark.read.parquet(d.generations()[1]).count() == 1


def test_denormal(spark):
    feeds = spark.createDataFrame([("s", "Europe/Berlin", "DMY"), (None, "UTC", "YMD")], "source string, clock_zone string, day_order string")
    text = spark.createDataFrame([(1, "2024-05-01T10:00:00.000Z", "s"), (2, "2024-05-01 10:00:00", "s"), (3, "2024-05-01 10:00:00", None), (4, "", "s"), (5, None, "s")], "row_key bigint, raw string, source string")
    num = spark.createDataFrame([(1, "1714557600", None), (2, "1714557600123", None), (3, "-1", None)], "row_key bigint, raw string, source string")
    got = denormal_times({("t", "at"): text, ("t", "start_utime"): num}, feeds, InstantDictionary(spark)).collect()
    assert {tuple(r) for r in got} == {("t", "at", 2, 1714550400000), ("t", "start_utime", 2, 1714557600123)}


def test_late_corrections(spark):
    schema = "row_id bigint, entity string, event_ms bigint, observed_ms bigint"
    s = CorrectedCounts(spark)
    assert s.raw().count() == 0 and s.counts().count() == 0
    s.ingest(spark.createDataFrame([(1, "a", 5, 6), (2, "a", 5, DAY), (3, None, 40 * DAY, 40 * DAY), (4, "a", None, 3)], schema))
    assert {tuple(r) for r in s.counts().collect()} == {("a", 0, 2, 1), (None, 40, 1, 0)}
    more = spark.createDataFrame([(5, "a", 9, 4 * DAY - 1), (6, "a", 9, 4 * DAY), (7, "b", 10, 2), (8, "z", 50 * DAY, 90 * DAY)], schema)
    assert s.ingest(more, label="two") == [0]  # a row beyond the cut-off touches no period
    assert {tuple(r) for r in s.counts().collect()} == {("a", 0, 3, 2), ("b", 0, 1, 0), (None, 40, 1, 0)}
    fates = {(2, "late"), (5, "late"), (6, "too_late"), (8, "too_late")}
    assert {(r["row_id"], r["fate"]) for r in s.late_rows().collect()} == fates
    assert s.ingest(spark.createDataFrame([], schema)) == []
    assert s.ingest(more, label="two") == []  # delivered again
    s.files.put(f"{s.path}/raw/batch=left/month=23640/broken", "by a failed run")
    assert s.ingest(spark.createDataFrame([(9, "b", 11, 3)], schema)) == [0]
    assert {tuple(r) for r in s.counts().collect()} == {("a", 0, 3, 2), ("b", 0, 2, 0), (None, 40, 1, 0)}
    assert {(r["row_id"], r["fate"]) for r in s.late_rows().collect()} == fates


def test_manifests_are_replaced_whole(spark):
    path = work_dir(spark, "manifest")
    files = Files(spark, path)
    files.put(f"{path}/m.json", "one")
    files.put(f"{path}/m.json", "two")
    assert files.read(f"{path}/m.json") == "two" and files.names(path) == ["m.json"]


def test_json_however_deep(spark):
    text = json.dumps({"legs": [{"leg_id": "a"}]})
    for _ in range(9):
        text = json.dumps(text)
    df = spark.createDataFrame([(1, text, None, None)], "delivery_id bigint, details string, transactions_full array<string>, accounts array<string>")
    assert [tuple(r) for r in nested_children(df).collect()] == [(1, "leg", 0, 0, "a")]


def test_hot_keys_join_whole(spark):
    big = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 300).cast("string"))).alias("k"), "id")
    keyed = big.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    a = join_counted(big, keyed, ["k"], "n", least=500)
    b = big.join(keyed.drop("n"), "k")
    assert a.count() == 3000 and a.exceptAll(b).count() == 0
