from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from meterlake.plans import report as P
from meterlake.sources import files as S
from meterlake.sources import runs as U
from meterlake.sources import versions as V
from meterlake.streaming.slots import slot_stream
from tests.test_operators import NETWORK, REGISTRY, channels, tables


def sources(spark):
    made, catalogue = channels(spark)
    registry = dict(REGISTRY)
    registry["rel_equip_uc"] = (registry["rel_equip_uc"][0], [(1, "0123", date(2020, 1, 1), None), (2, "77", date(2020, 1, 1), None)])
    return tables(spark, registry) | tables(spark, NETWORK) | made | {"a_data_catalogue": catalogue}


def test_daily_report_over_several_days(spark):
    got = P.daily_report(sources(spark), "2023-12-31", "2024-01-02", "2024-01-02", "riverton")
    rows = {(r["NIO"], r["REPORT_DAY"]): r for r in got.collect()}
    assert set(rows) == {(n, d) for n in ("123", "77") for d in (date(2023, 12, 31), date(2024, 1, 1))}  # the day itself is not over
    assert rows["123", date(2024, 1, 1)]["HAS_MDM_DATA"] and not rows["77", date(2024, 1, 1)]["HAS_MDM_DATA"]
    assert rows["123", date(2024, 1, 1)]["GEO_ALIMENTADOR"] == "F1" and rows["123", date(2024, 1, 1)]["fa_interval"] == '{"00:00":1.500}'


def test_run_period_is_repeatable(spark, tmp_path):
    for _ in range(2):
        run = P.run_period(sources(spark), str(tmp_path), "2023-12-31", "2024-01-01", "2024-01-02", "riverton")
    assert [s[2] for s in run.steps] == [4]
    assert V.read(spark, f"{tmp_path}/report").count() == 4 and spark.read.parquet(f"{tmp_path}/runs").count() == 2
    assert V.read(spark, f"{tmp_path}/report").filter("report_day = '2024-01-01'").count() == 2 and V.versions(spark, f"{tmp_path}/report") == [1, 2]
    snap = U.load_snapshot(spark, f"{tmp_path}/daily_keys", "2024-01-01")
    assert {r["count"] for r in snap.collect()} == {2}
    with pytest.raises(FileNotFoundError):
        U.load_snapshot(spark, f"{tmp_path}/daily_keys", "2024-01-05")


def test_run_period_notes_outcomes_and_goes_on(spark, tmp_path, monkeypatch):
    whole = P.daily_report

    def broken(sources, first, last, *rest):
        if str(first) != str(last) or str(first) == "2023-12-31":
            raise ValueError("no database")
        return whole(sources, first, last, *rest)

    P.run_period(sources(spark), str(tmp_path / "a"), "2023-12-31", "2024-01-02", "2024-01-02", "riverton")
    status = spark.read.parquet(str(tmp_path / "a/period_status"))
    assert {str(r["day"]): r["status"] for r in status.collect()} == {"2023-12-31": "ok", "2024-01-01": "ok", "2024-01-02": "skipped"}
    assert tuple(P.period_summary(status).first())[:4] == (3, 2, 0, 1) and P.period_summary(status).first()["duration_seconds"] > 0
    monkeypatch.setattr(P, "daily_report", broken)
    with pytest.raises(RuntimeError, match="no database"):
        P.run_period(sources(spark), str(tmp_path / "b"), "2023-12-31", "2024-01-01", "2024-01-02", "riverton")
    assert spark.read.parquet(str(tmp_path / "b/runs")).first()["error"] == "no database"
    P.run_period(sources(spark), str(tmp_path / "c"), "2023-12-31", "2024-01-01", "2024-01-02", "riverton", go_on=True)
    status = spark.read.parquet(str(tmp_path / "c/period_status"))
    assert {str(r["day"]): r["status"] for r in status.collect()} == {"2023-12-31": "failed", "2024-01-01": "ok"}


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from meterlake.sources import shared

    made = shared.materialize(spark.range(3), "x")
    assert made.count() == 3
    shared.clear_job(spark)
    assert not spark._jvm.java.io.File(shared.job_dir(spark)).exists()

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn", "spark.sql.warehouse.dir": "w"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared.shared_dir(Session())


def test_sample_report_keeps_right_rows(spark):
    left = spark.createDataFrame([("0012", "a"), ("", "x")], "NIO string, NAME string")
    right = spark.createDataFrame([("12", "s"), ("99", "t"), (None, "u")], "NIO string, NAME string")
    got = P.sample_report(left, right)
    assert got.columns == ["NIO", "NAME", "MDM_NAME"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("0012", "a", "s"), ("99", None, "t"), ("", None, "u")]))


def test_sample_flow_checks_its_result(spark):
    base = spark.createDataFrame([(str(n), str(1000 + n), "S" if n % 3 == 0 else "N") for n in range(60)], "NIO string, UC string, SMART string")
    geo = spark.createDataFrame([(str(1000 + n), "F") for n in range(60)], "UC string, FEEDER string")
    daily = spark.createDataFrame([(str(n), "{}") for n in range(60)], "NIO string, SERIES string")
    out, checks = P.sample_flow(base, geo, daily, 20)
    assert out.filter("UC IS NOT NULL").count() == 20 and out.filter("SMART = 'S'").count() == 20
    assert {r["check"]: r["passed"] for r in checks.collect()}["no_nulls_in_keys"] is False  # meters outside the sample have no unit


def test_period_status(spark):
    days = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 1),)], "day date")
    status = P.period_status(spark, days, "2023-12-31", "2024-01-03", "2024-01-03")
    assert {r["day"].day: (r["rows"], r["status"]) for r in status.collect()} == {31: (0, "failed"), 1: (2, "ok"), 2: (0, "failed"), 3: (0, "skipped")}
    assert tuple(P.period_summary(status).first()) == (4, 1, 2, 1)


def test_csv_lists_and_inventory(spark, tmp_path):
    (tmp_path / "in_20260615.csv").write_text('﻿UC;NIO\n001;"a;""b"\n;\n', encoding="utf-8")
    df = S.read_csv(spark, str(tmp_path / "in_20260615.csv"))
    assert df.columns == ["UC", "NIO"] and df.first()["NIO"] == 'a;"b' and dict(df.dtypes) == {"UC": "string", "NIO": "string"}
    S.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(str, S.read_csv(spark, str(tmp_path / "out"), ["UC", "NIO"]).collect())) == sorted(map(str, df.collect()))
    S.write_list(df, "UC", str(tmp_path / "list"))
    assert spark.read.text(str(tmp_path / "list")).count() == 2
    found = S.inventory(spark, str(tmp_path / "in_*.csv"))
    assert found.first()["name"] == "in_20260615.csv" and found.first()["size_bytes"] == (tmp_path / "in_20260615.csv").stat().st_size


def test_dated_writes_replace_only_their_days(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, d), d) for d in (1, 1, 2)], "report_day date, x int")
    S.write_dated(df, str(tmp_path / "t"), order=("x",), csv_path=str(tmp_path / "c"))
    S.write_dated(df.filter("x = 2").withColumn("x", F.lit(9)), str(tmp_path / "t"))
    S.write_dated(df.limit(0), str(tmp_path / "t"))
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 1, 9]
    plan = S.read_days(spark, str(tmp_path / "t"), "2024-01-02", "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(report_day" in plan


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    S.write_jdbc(spark.range(40).selectExpr("cast(id as int) as ID", "cast(id * 2 as int) as V"), url, "T", "overwrite", **driver)
    back = S.read_jdbc(spark, url, "T", "ID", 0, 40, 4, **driver)
    assert back.rdd.getNumPartitions() == 4 and back.filter("ID < 10").count() == 10
    assert "LessThan(ID,10)" in back.filter("ID < 10")._jdf.queryExecution().executedPlan().toString()


def test_publish_and_lookup(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, 2), 1)], "report_day date, x int")
    assert U.publish(df, str(tmp_path / "p"), str(tmp_path / "log")) == 1
    note = spark.read.parquet(str(tmp_path / "log")).first()
    assert not U.keep_version(df, str(tmp_path / "absent"))
    assert U.publish(df.withColumn("x", F.lit(7)), str(tmp_path / "p"), str(tmp_path / "log")) == 1
    assert spark.read.parquet(str(tmp_path / "p")).first()["x"] == 7 and spark.read.parquet(str(tmp_path / "p-versions")).first()["x"] == 1
    assert note["row_count"] == 1 and note["file_size_bytes"] > 0
    found = U.days_back_lookup(spark, df.withColumnRenamed("report_day", "day"), "2024-01-04", 3)
    assert {r["days_back"]: r["found"] for r in found.collect()} == {1: False, 2: True, 3: False}


def test_run_notes_errors(spark):
    run = U.Run(spark)
    run.record("a", 3, 0.1)
    run.error("b", "lost")
    assert [r["error"] for r in run.table().orderBy("name").collect()] == [None, "lost"]


def test_slot_stream(spark, tmp_path):
    rows = [("m", datetime(2024, 1, 1, 0, 1), 1.0), ("m", datetime(2024, 1, 1, 0, 4), 3.0), ("m", datetime(2024, 1, 1, 2, 0), 5.0)]
    spark.createDataFrame(rows, "nio string, tv timestamp, x double").write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([("m", datetime(2024, 1, 1, 0, 2), 99.0), ("m", datetime(2024, 1, 1, 4, 0), 1.0)], "nio string, tv timestamp, x double")
    stream = spark.readStream.schema("nio string, tv timestamp, x double").parquet(str(tmp_path / "in"))
    q = slot_stream(stream, ["nio"], ["x"]).writeStream.format("memory").queryName("slots").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        late.write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        got = {r["tv"]: r["x"] for r in spark.table("slots").collect()}
    finally:
        q.stop()
    assert got[datetime(2024, 1, 1)] == 3.0  # the late reading came after the watermark
