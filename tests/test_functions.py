from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from meterlake.functions import calendar as C
from meterlake.functions import keys as K
from meterlake.functions.geo import to_wgs84


@pytest.mark.parametrize(
    "text, want",
    [
        ("00123", ("123", "123", "123", "123")),
        ("0000", (None, "0", "0", None)),
        (" 12-3 ", ("123", "123", "12-3", "12-3")),
        ("A0", (None, "0", "A0", "A0")),
        ("", (None, "", "", None)),
        (None, (None, "", "", None)),
        ("123.0", ("1230", "1230", "123.0", "123.0")),
    ],
)
def test_key_modes(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(*(K.normalize_key(F.col("t"), m).alias(m) for m in K.MODES)).first()
    assert tuple(row) == want
    again = spark.createDataFrame([(row["digits"],)], "t string").select(K.normalize_key(F.col("t")).alias("k")).first()
    assert again["k"] == row["digits"]


def test_keys_of_other_types(spark):
    df = spark.createDataFrame([(123.0, 12345678.0, True, 7)], "a double, b double, c boolean, d bigint")
    assert tuple(df.select(*(K.key_of(df, c).alias(c) for c in df.columns)).first()) == ("123", "12345678", None, "7")
    half = spark.createDataFrame([(123.5,)], "a double")
    assert half.select(K.key_of(half, "a").alias("k")).first()["k"] == "1235"


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], " nio long, `Data Time ` long")
    assert K.upper_names(df).columns == ["NIO", "DATA TIME"] and K.find_column(df, "data time") == "Data Time "
    with pytest.raises(ValueError, match="UC"):
        K.require_columns(df, ["NIO", "UC"])
    assert K.collision_names(["k", "a", "G_a"], ["k", "a", "b"], ["k"], "G_") == {"a": "G_a_2", "b": "b"}
    assert K.prefix_all(K.upper_names(df), ["NIO"], "GEO_").columns == ["NIO", "GEO_DATA TIME"]


def test_keep_first_has_a_fixed_order(spark):
    df = spark.createDataFrame([(1, None, "b"), (1, 2, "a"), (1, 2, None), (None, 1, "z"), (2, None, None)], "k int, x int, y string")
    assert sorted(map(tuple, K.keep_first(df, ["k"]).collect())) == [(1, 2, "a"), (2, None, None)]
    assert sorted(map(tuple, K.keep_first(df.repartition(3), ["k"], [F.col("y").isNull(), F.col("y")]).collect())) == [(1, 2, "a"), (2, None, None)]


def test_small_expressions(spark):
    rows = spark.createDataFrame([("sim ", b"\xc3\xa9", 1536, "a"), ("no", b"\xe9", 10, None), (None, None, 5 << 20, None)], "t string, b binary, n bigint, j string")
    got = [tuple(r) for r in rows.select(K.is_truthy(F.col("t")), K.decoded(F.col("b")), K.size_text(F.col("n")), K.joined_text(F.col("j"), F.lit(None).cast("string"))).collect()]
    assert got == [(True, "é", "1.5 KB", "a"), (False, "é", "10 B", None), (False, None, "5.0 MB", None)]


def test_calendar(spark):
    one = spark.range(1)
    row = one.select(C.report_day("2024-03-01", 1).alias("a"), C.earliest_day("2024-03-15").alias("b"), C.in_retention(C.day_literal("2024-03-15"), "2024-03-15").alias("c")).first()
    assert tuple(row) == (date(2024, 2, 29), date(2023, 11, 1), False)
    with pytest.raises(ValueError):
        C.report_day("2024-03-01", 0)
    grid = C.day_grid(one.select(C.day_literal("2024-01-02").alias("day"))).agg(F.count("tv"), F.min("tv"), F.max("tv")).first()
    assert tuple(grid) == (288, datetime(2024, 1, 2), datetime(2024, 1, 2, 23, 55))
    t = spark.createDataFrame([(datetime(2024, 1, 1, 0, 7, 3, 5),), (datetime(2024, 1, 1, 0, 5),)], "t timestamp")
    assert [tuple(r) for r in t.select(C.slot_start(F.col("t")), C.on_grid(F.col("t"))).collect()] == [(datetime(2024, 1, 1, 0, 5), False), (datetime(2024, 1, 1, 0, 5), True)]
    assert C.days(spark, C.day_literal("2024-01-03"), C.day_literal("2024-01-01")).count() == 0


@pytest.mark.parametrize(
    "name, want",
    [
        ("meter_cis_20260615.csv", date(2026, 6, 15)),
        ("meter_mdm_sample_200_20260615.parquet", date(2026, 6, 15)),
        ("meter_cis.csv", None),
        ("meter_cis_99999999.csv", None),
        ("meter_cis_20260615.txt", None),
        ("", None),
    ],
)
def test_file_day(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(C.file_day(F.col("n"))).first()[0] == want


def test_reading_hour(spark):
    got = spark.createDataFrame([("31/12/2024 23:55:00",), ("bad",), (None,)], "t string").select(C.reading_hour(F.col("t"))).collect()
    assert [r[0] for r in got] == [23, None, None]


def test_reprojection(spark):
    """The central meridian and equator are exact; a known point of zone 22S on WGS-like axes to a metre."""
    df = spark.createDataFrame([(500000.0, 10000000.0), (674000.0, 7180000.0)], "x double, y double")
    lat, lon = to_wgs84(F.col("x"), F.col("y"), 31982)
    first, second = df.select(lat.alias("lat"), lon.alias("lon")).collect()
    assert (round(first["lat"], 9), round(first["lon"], 9)) == (0, -51)
    assert abs(second["lat"] + 25.4818) < 0.01 and abs(second["lon"] + 49.2687) < 0.01
    lat, lon = to_wgs84(F.col("x"), F.col("y"), 29192)
    shifted = df.select(lat.alias("lat"), lon.alias("lon")).collect()[1]
    assert 0.0002 < abs(shifted["lat"] - second["lat"]) < 0.001 and 0.0002 < abs(shifted["lon"] - second["lon"]) < 0.001
