"""Versions, key lists in a database, restarts of streams, payloads, dated folders: what happens between the steps."""

import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from meterlake.functions.calendar import day_literal
from meterlake.operators import quality as Q
from meterlake.operators import weather as W
from meterlake.plans import flows
from meterlake.plans import report as P
from meterlake.plans.queries import QUERIES
from meterlake.sources import files as S
from meterlake.sources import runs as U
from meterlake.sources import versions as V
from meterlake.streaming.slots import compact_slots, current_slots, start_slots
from tests.test_jobs import sources

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dated(spark, rows):
    return spark.createDataFrame([(date(2024, 1, d), x) for d, x in rows], "report_day date, x int")


def said(df):
    return sorted((r["report_day"].day, r["x"]) for r in df.collect())


def test_a_version_replaces_its_days_and_old_ones_stay(spark, tmp_path):
    target = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        V.read(spark, target)
    assert V.publish(dated(spark, [(1, 1), (2, 2), (3, 3)]), target, order=("x",)) == 1
    assert V.publish(dated(spark, [(2, 20), (2, 21)]), target) == 2
    assert said(V.read(spark, target)) == [(1, 1), (2, 20), (2, 21), (3, 3)] and said(V.read(spark, target, 1)) == [(1, 1), (2, 2), (3, 3)]
    assert V.publish(dated(spark, [(4, 4)]), target, covers=("2024-01-02", "2024-01-31")) == 3
    assert said(V.read(spark, target)) == [(1, 1), (4, 4)]
    assert V.publish(dated(spark, []), target, covers=("2024-01-01", "2024-01-31")) == 4
    assert V.read(spark, target).columns == ["report_day", "x"] and V.read(spark, target).count() == 0
    log = {r["version"]: r for r in V.log(spark, target).collect()}
    assert [(log[n]["rows"], log[n]["written"], log[n]["dropped"], log[n]["days"], log[n]["previous"]) for n in (1, 2, 3, 4)] == [
        (3, 3, 0, 3, None), (2, 1, 0, 3, 1), (1, 1, 2, 2, 2), (0, 0, 2, 0, 3)]
    assert log[1]["bytes"] > 0
    assert V.sweep(spark, target, keep=2) == 2 and V.versions(spark, target) == [3, 4]
    assert said(V.read(spark, target, 3)) == [(1, 1), (4, 4)]
    assert "PartitionFilters: [isnotnull(report_day" in plan(V.read(spark, target, 3).filter(F.col("report_day") == day_literal("2024-01-04")))


@pytest.mark.parametrize("step", ["write", "size", "switch"])
def test_a_failure_at_any_step_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    target = str(tmp_path / "t")
    V.publish(dated(spark, [(1, 1)]), target)

    def fail(*_, **__):
        raise OSError("lost")

    new = dated(spark, [(1, 9), (2, 9)])
    if step == "write":
        new = new.withColumn("x", F.when(F.col("report_day") == day_literal("2024-01-02"), F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("x")))
    else:
        monkeypatch.setattr(V, "inventory" if step == "size" else "_switch", fail)
    with pytest.raises(Exception, match="lost"):
        V.publish(new, target)
    monkeypatch.undo()
    assert V.versions(spark, target) == [1] and said(V.read(spark, target)) == [(1, 1)]
    assert V.publish(dated(spark, [(2, 5)]), target) == 2 and said(V.read(spark, target)) == [(1, 1), (2, 5)]
    V.sweep(spark, target)
    assert len([n for n in os.listdir(f"{target}/data") if n.startswith("run=")]) == 2


def test_the_later_of_two_writers_fails(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "t")
    V.publish(dated(spark, [(1, 1)]), target)
    switch = V._switch

    def meanwhile(session, where, entry):
        monkeypatch.undo()
        V.publish(dated(spark, [(1, 2)]), target)
        switch(session, where, entry)

    monkeypatch.setattr(V, "_switch", meanwhile)
    with pytest.raises(RuntimeError, match="published meanwhile"):
        V.publish(dated(spark, [(1, 3)]), target)
    assert said(V.read(spark, target)) == [(1, 2)] and V.versions(spark, target) == [1, 2]


def test_a_rerun_clears_days_that_became_empty(spark, tmp_path):
    t, out = sources(spark), str(tmp_path)
    P.run_period(t, out, "2023-12-31", "2024-01-01", "2024-01-02", "riverton")
    assert U.load_snapshot(spark, f"{out}/daily_keys", "2023-12-31").count() == 2 == U.load_snapshot(spark, f"{out}/daily_keys", "2024-01-01").count()
    P.run_period(t, out, "2024-01-01", "2024-01-01", "2024-01-02", "no such town")
    assert {str(r["report_day"]) for r in V.read(spark, f"{out}/report").collect()} == {"2023-12-31"}
    with pytest.raises(FileNotFoundError):
        U.load_snapshot(spark, f"{out}/daily_keys", "2024-01-01")
    status = [r["status"] for r in spark.read.parquet(f"{out}/period_status").filter("day = '2024-01-01'").collect()]
    assert sorted(status) == ["failed", "ok"] and V.read(spark, f"{out}/report", 1).count() == 4


def test_wanted_days_prune_partitions_as_the_query_runs(spark, tmp_path):
    V.publish(dated(spark, [(d, d) for d in range(1, 9)]), str(tmp_path / "t"))
    wanted = dated(spark, [(d, d) for d in (2, 5, 20)]).filter("x > 2").select("report_day")
    found = S.on_days(V.read(spark, str(tmp_path / "t")), wanted)
    assert said(found) == [(5, 5)] and "dynamicpruning" in plan(found)
    assert "dynamicpruning" in plan(QUERIES["snapshot_range"](spark, D))


def test_only_listed_keys_leave_the_database(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = spark.range(5000).select((F.col("id") % 1000).alias("k"), F.format_string("%05d", F.col("id") % 1000).alias("name"), F.col("id").alias("v"))
    S.write_jdbc(rows, url, "facts", "overwrite", **driver, createTableColumnTypes="name VARCHAR(20)")
    keys = spark.createDataFrame([(7,), (7,), (12,), (None,), (99999,)], "key bigint")
    found = S.read_jdbc_keys(spark, url, "facts", "k", keys, "wanted", parts=3, **driver)
    assert sorted(r["v"] for r in found.collect()) == sorted([*range(7, 5000, 1000), *range(12, 5000, 1000)]) and found.rdd.getNumPartitions() == 3
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()  # with the counts of that one run
    assert leaf.metrics().apply("numOutputRows").value() == 10 and "JOIN wanted" in plan(found)
    texts = spark.createDataFrame([("7",), ("12",)], "key string")
    found = S.read_jdbc_keys(spark, url, "facts", "name", texts, "wanted_names", expression="TRIM(LEADING '0' FROM t.\"name\")", key_type="VARCHAR(20)", **driver)
    assert found.count() == 10 and found.columns == ["k", "name", "v"]


def test_the_guard_reads_its_side_once(spark):
    left = spark.createDataFrame([("1", "a"), ("02", "b"), (None, "c")], "NIO string, NAME string")
    right = spark.createDataFrame([("1", 5), ("9", 6)], "NIO string, V int")
    got = P.sample_report(left, right)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [("1", "a", 5), ("9", None, 6)]))
    with pytest.raises(Exception, match="repeated keys: 1 .2 rows"):
        P.sample_report(left.union(spark.createDataFrame([("01", "z")], left.schema)), right).collect()
    text = plan(QUERIES["report_right"](spark, D))
    assert text.count("customer.parquet") == 1 and text.count("orders.parquet") == 1
    one = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert sorted(map(tuple, Q.unique_rows(one, ["k"]).collect())) == [(1, "x"), (2, "y")]


def test_a_stream_goes_on_after_losing_its_last_commit(spark, tmp_path):
    schema, root = "nio string, tv timestamp, x double", str(tmp_path)
    at = lambda h, m: datetime(2024, 1, 1, h, m)

    def run(rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        start_slots(spark.readStream.schema(schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/cp", ["nio"], ["x"], late="1 hour").awaitTermination()
        return {(r["nio"], r["tv"]): r["x"] for r in current_slots(spark, f"{root}/out", ["nio"], ["x"]).collect()}

    assert run([("m", at(0, 1), 1.0), ("m", at(3, 0), 5.0)]) == {("m", at(0, 0)): 1.0, ("m", at(3, 0)): 5.0}
    want = {("m", at(0, 0)): 1.0, ("m", at(3, 0)): 7.0, ("m", at(2, 30)): 2.0}  # 0:02 is behind the watermark, 2:30 is not
    assert run([("m", at(0, 2), 99.0), ("m", at(2, 31), 2.0), ("m", at(3, 4), 7.0)]) == want
    commits = sorted((int(n) for n in os.listdir(f"{root}/cp/commits") if n.isdigit()))
    for name in (f"{root}/cp/commits/{commits[-1]}", f"{root}/cp/commits/.{commits[-1]}.crc"):
        if os.path.exists(name):
            os.remove(name)
    assert run([]) == want
    assert run([("n", at(4, 0), 1.0)]) == want | {("n", at(4, 0)): 1.0}
    compact_slots(spark, f"{root}/out", f"{root}/whole", ["nio"], ["x"])
    assert spark.read.parquet(f"{root}/whole").count() == 4


def test_payloads_that_cannot_be_read_are_kept_apart(spark, tmp_path):
    hours = [f"2024-01-0{{}}T{h:02d}:00" for h in range(24)]
    payload = lambda d, n=24, **more: json.dumps({"day": f"2024-01-0{d}", "lat": 1.0, "lon": 2.0, "hourly": {"time": [h.format(d) for h in hours[:n]], "temperature_2m": [float(h) for h in range(3)], **more}})
    lines = [payload(1), payload(2, cloud_cover=[None, 5.0]), payload(3)[:40], payload(4, 0), payload(5).replace("T05:00", "T99:00"), '{"lat": 1}', "[]"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(lines))
    W.land_payloads(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out/hourly"))
    got = {(r["day"].day, r["hour"]): (r["temperature_2m"], r["cloud_cover"]) for r in rows.collect()}
    assert len(got) == 48 and got[1, 2] == (2.0, None) and got[1, 3] == (None, None) and got[2, 1] == (1.0, 5.0)
    bad = spark.read.parquet(str(tmp_path / "out/quarantine")).collect()
    assert sorted(r["reason"] for r in bad)[:2] == ["an hour that is none", "no day"] and {r["reason"] for r in bad} == {"an hour that is none", "no day", "no hours", "not a payload"}
    assert all(r["file"].endswith("a.json") and r["record"] for r in bad)
    assert next(r["record"] for r in bad if r["reason"] == "not a payload" and r["record"].startswith("{")) == payload(3)[:40]


def test_facts_of_folders_open_no_data(spark):
    found = flows._folders(spark, D)
    text = plan(Q.integrity_report(Q.folder_files(found), found.select("day"), "2024-02-01"))
    assert all("content" not in part.split(">")[0] for part in text.split("ReadSchema: ")[1:])
    assert "FileScan text" not in text and "FileScan parquet" not in text
    other = spark.createDataFrame([("/x/cis/day=2024-01-31/part-0", 5, None), ("/x/cis/day=2024-13-31/p", 1, None), ("/x/loose.csv", 1, None)], "path string, size_bytes bigint, modified timestamp")
    got = {(r["dataset"], r["day"], r["size_bytes"], r["files"]) for r in S.dated_folders(other).collect()}
    assert got == {("cis", date(2024, 1, 31), 5, 1), ("cis", None, 1, 1)}


def test_reprojection_by_steps_equals_the_expressions(spark):
    from meterlake.functions.geo import reproject, to_wgs84

    df = spark.createDataFrame([(676000.0, 7180000.0), (500000.0, 9000000.0), (None, 1.0)], "x double, y double")
    for srid in (29192, 31982):
        lat, lon = to_wgs84(F.col("x"), F.col("y"), srid)
        both = reproject(df, "x", "y", "a", "b", srid).select("a", "b", lat.alias("lat"), lon.alias("lon")).collect()
        assert all((r["a"], r["b"]) == (r["lat"], r["lon"]) for r in both)


def test_a_run_computes_units_and_rows_of_the_report_once(spark, tmp_path, monkeypatch):
    sources = flows.registry_tables(spark, D) | flows.network(spark, D) | flows.channels(spark, D)
    found = plan(P.daily_report(sources, "2024-01-29", "2024-01-30", "2024-02-01"))
    assert "orders.parquet" not in found and "customer.parquet" not in found and "events.parquet" in found
    published = []
    monkeypatch.setattr(U.Run, "publish", lambda self, name, df, target, *more: published.append(plan(df)) or V.publish(df, target, *more))
    P.run_period(sources, str(tmp_path), "2024-01-29", "2024-01-30", "2024-02-01")
    assert len(published) == 1 and "events.parquet" not in published[0]
