import pytest
from pyspark.sql import functions as F

from namequarry.functions.instants import iso_ms, with_instant
from namequarry.functions.names import shown_name

CASES = [
    ("2024-05-01T10:00:00.123Z", None, None, 1714557600123),
    ("2024-05-01 10:00:00.1239 +02:00", None, None, 1714550400123),
    ("2024-05-01T10:00", "UTC", "YMD", 1714557600000),
    ("1/5/2024 1:05 PM", "UTC", "MDY", 1704459900000),
    ("01.05.2024 10:00", "Europe/Berlin", "DMY", 1714550400000),
    ("01.05.2024 10:00", "Europe/Berlin", None, None),
    ("Wed, 01 May 2024 10:00:00 +0200", None, None, 1714550400000),
    ("1 May 2024 10:00:00 GMT", None, None, 1714557600000),
    ("20240501T100000Z", None, None, 1714557600000),
    ("1714557600", None, None, 1714557600000),
    ("1714557600.5", None, None, 1714557600500),
    ("1714557600123456", None, None, 1714557600123),
    ("2024-05-01 10:00:00 America/New_York", None, None, 1714572000000),
    ("2024-05-01T10:00:00[Asia/Tokyo]", "UTC", None, 1714525200000),
    ("2024-03-31 02:30:00", "Europe/Berlin", "DMY", None),  # skipped
    ("2024-10-27 02:30:00", "Europe/Berlin", "DMY", None),  # shown twice
    ("2024-10-27T02:30:00+01:00", "Europe/Berlin", "DMY", 1729992600000),
    ("2024-02-30T11:00:00Z", None, None, None),
    ("2024-05-01", "UTC", "YMD", None),
    ("2024-05-01T10:00:00", None, None, None),
    ("2024-05-01 10:00:00 Nowhere/City", None, None, None),
    ("12:00 AM 2024", "UTC", "DMY", None), ("-1", None, None, None), ("soon", "UTC", "DMY", None), ("", "UTC", "DMY", None), (None, "UTC", "DMY", None), ("x" * 100_000, "UTC", "DMY", None), ("1|2", "UTC", "DMY", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, raw string, zone string, ord string, want bigint")
    got = with_instant(df, "raw", "ms", "zone", "ord").where(~F.col("ms").eqNullSafe(F.col("want"))).collect()
    assert got == []


def test_instants_of_long_texts(spark):
    at = 1714557600123
    rows = [(" " * 90 + "2024-05-01T10:00:00.123Z" + " " * 90, at), ("2024-05-01T10:00:00.123" + "9" * 200 + "Z", at), ("1714557600.123" + "0" * 100, at), ("2024-05-01" + " " * 100 + "10:00:00.123 UTC", at)]
    rows += [("2024-05-01 10:00:00" + " " * 50_000 + "x", None), ("x" + " " * 50_000 + "x", None), ("2024-05-01 10:00:00 a" + "/b" * 50_000, None), ("9" * 50_000, None)]
    df = spark.createDataFrame(rows, "raw string, want bigint")
    assert [(r["raw"][:40], r["ms"]) for r in with_instant(df, "raw", "ms").where(~F.col("ms").eqNullSafe(F.col("want"))).collect()] == []


def test_filters_above_the_parse(spark):
    df = spark.createDataFrame([("2024-05-01T10:00:00Z",), (None,)], "raw string")
    assert with_instant(df, "raw", "ms").where("ms is not null and ms > 5").count() == 1


def test_iso(spark):
    assert spark.sql("select 1714557600123L m").select(iso_ms(F.col("m"))).first()[0] == "2024-05-01T10:00:00.123Z"


@pytest.mark.parametrize("raw,want", [("@Nebe_Fosox​", "nebe_fosox"), (" ＡＢＣ１_x ", "abc1_x"), ("@@", None), (None, None), ("é", None)])
def test_names(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "n string").select(shown_name(F.col("n"))).first()[0] == want
