"""Registered queries of whole flows: databases by key list, versions, streams, payloads, dated folders, all channels, runs.

Each makes its tables from the given ones with Spark, writes and reads them under the job's folder where the flow asks for files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.calendar import day_literal, reading_hour
from meterlake.functions.keys import decoded
from meterlake.operators import quality as Q
from meterlake.operators import readings as R
from meterlake.operators import weather as W
from meterlake.operators.topology import topology, with_pole_position
from meterlake.plans import report as P
from meterlake.plans.queries import AS_OF, NETWORK_SQL, ORACLE_SQL, QUERIES, TYPES, database, network, query
from meterlake.schemas import CHANNELS, MEASURE, MEASURES
from meterlake.sources import files as S
from meterlake.sources import runs as U
from meterlake.sources import versions as V
from meterlake.sources.shared import job_dir
from meterlake.sources.tables import table
from meterlake.streaming.slots import current_slots, start_slots

__all__ = ["ORACLE_SQL", "QUERIES"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{job_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jdbc_key_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a list of customers out of a database that holds all orders; only theirs leave it."""
    url, driver = database(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    S.write_jdbc(orders, url, "orders_copy", "overwrite", **driver)
    keys = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return S.read_jdbc_keys(spark, url, "orders_copy", "o_custkey", keys, "customer_keys", **driver)


_MONTHS = """
SELECT 1 AS version, o_orderkey, o_totalprice, date_trunc('month', o_orderdate)::DATE AS report_day FROM orders
UNION ALL SELECT 2, o_orderkey, o_totalprice * 2, date_trunc('month', o_orderdate)::DATE FROM orders WHERE month(o_orderdate) = 2 AND o_orderstatus = 'F'
UNION ALL SELECT 2, o_orderkey, o_totalprice, date_trunc('month', o_orderdate)::DATE FROM orders WHERE month(o_orderdate) <> 2
"""


def _published_months(spark: SparkSession, sf_dir: str) -> str:
    target = _folder(spark, "months")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.trunc("o_orderdate", "MM").alias("report_day"))
    V.publish(o.drop("o_orderstatus"), target, order=("o_orderkey",))
    again = o.filter((F.month("report_day") == 2) & (F.col("o_orderstatus") == "F")).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    V.publish(again.drop("o_orderstatus"), target)
    return target


@query(_MONTHS)
def published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month, published twice, the second time with other Februaries: the old version and the new one."""
    target = _published_months(spark, sf_dir)
    old, new = (V.read(spark, target, n).select(F.lit(n).alias("version"), "o_orderkey", "o_totalprice", "report_day") for n in (1, 2))
    return old.union(new)


@query(f"""
WITH m AS ({_MONTHS}), d AS (SELECT count(DISTINCT report_day)::INT AS n FROM m WHERE version = 1), f AS (SELECT count(DISTINCT report_day)::INT AS n FROM m WHERE version = 2 AND month(report_day) = 2)
SELECT 1 AS version, (SELECT count(*) FROM m WHERE version = 1) AS rows, n AS written, 0 AS dropped, n AS days, NULL::INT AS previous FROM d
UNION ALL SELECT 2, (SELECT count(*) FROM m WHERE version = 2 AND month(report_day) = 2), f.n, 0, d.n, 1 FROM d, f
""")
def publish_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.log(spark, _published_months(spark, sf_dir)).select("version", "rows", "written", "dropped", "days", "previous")


def _user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.col("user_id").alias("ucs"), F.col("ts").cast("date").alias("day"))


_USER_DAYS = "SELECT DISTINCT user_id::VARCHAR AS ucs, CAST(ts AS DATE) AS date FROM events WHERE user_id > 0"


@query(f"""
SELECT ucs, date, count(*) OVER (PARTITION BY date) AS count FROM ({_USER_DAYS})
WHERE date IN (SELECT CAST(ts AS DATE) FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'error') * 5 > count(*))
""")
def snapshot_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of all days in one write; then those of the days with many errors, by a join that prunes partitions as it runs."""
    path, days = _folder(spark, "snapshots"), _user_days(spark, sf_dir)
    U.save_snapshots(days, path, "2023-01-01", "2025-12-31")
    wanted = days.groupBy("day").agg((F.count_if(F.col("event_type") == "error") * 5).alias("errors"), F.count(F.lit(1)).alias("n")).filter("errors > n")
    return U.load_snapshots(spark, path, wanted.select("day")).select("ucs", "date", "count")


@query("""
WITH k AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE user_id > 0
  AND CASE WHEN CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-06' THEN event_type = 'signup' AND CAST(ts AS DATE) <> DATE '2024-01-04' ELSE TRUE END)
SELECT d.day, count(user_id) AS rows, CASE WHEN d.day >= DATE '2024-02-01' THEN 'skipped' WHEN count(user_id) > 0 THEN 'ok' ELSE 'failed' END AS status
FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS day) d LEFT JOIN k ON k.day = d.day GROUP BY d.day
""")
def snapshot_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of all days, then some days anew, one of which has no users any more: it goes, and its status says so."""
    path, days = _folder(spark, "snapshots"), _user_days(spark, sf_dir)
    U.save_snapshots(days, path, "2023-01-01", "2025-12-31")
    U.save_snapshots(days.filter("event_type = 'signup' AND day <> '2024-01-04'"), path, "2024-01-03", "2024-01-06")
    return P.period_status(spark, V.read(spark, path).select(F.col("date").alias("day")), "2024-01-01", "2024-02-03", AS_OF)


_LATE = "2 days"
_PIVOT = ", ".join(f"max(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES)


@query(f"""
WITH a AS (SELECT * FROM events WHERE ts < TIMESTAMP '2024-01-16' AND event_type <> 'error'), mark AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY AS t FROM a),
b AS (SELECT e.* FROM events e, mark WHERE NOT (ts < TIMESTAMP '2024-01-16' AND event_type <> 'error') AND (t IS NULL OR time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE > t))
SELECT user_id, CAST(ts AS DATE) AS day, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%H:%M') AS hhmi, {_PIVOT} FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3
""")
def stream_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot table as a stream that is started twice from one checkpoint: half of the events first, then the rest with all errors, of which those behind the watermark are too late."""
    root = _folder(spark, "stream")
    value = F.col("value").cast("decimal(18,2)")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("tv"), *(F.when(F.col("event_type") == t, value).alias(t) for t in TYPES), "event_type")
    first = (F.col("tv") < F.lit("2024-01-16").cast("timestamp_ntz")) & (F.col("event_type") != "error")
    for part in (rows.filter(first), rows.filter(~first)):
        part.drop("event_type").write.mode("append").parquet(f"{root}/in")
        source = spark.readStream.schema(rows.drop("event_type").schema).parquet(f"{root}/in")
        start_slots(source, f"{root}/out", f"{root}/checkpoint", ["user_id"], TYPES, late=_LATE).awaitTermination()
    found = current_slots(spark, f"{root}/out", ["user_id"], TYPES)
    return found.select("user_id", F.col("tv").cast("date").alias("day"), F.date_format("tv", "HH:mm").alias("hhmi"), *TYPES)


#: Which events stand for which variable of the weather.
_WEATHER = dict(zip(W.VARIABLES, [*TYPES, None]))


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload for each day of ``events`` as a line of JSON: some with a short series, some without hours, some broken off."""
    e = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour"))
    pick = lambda t: F.col("value") if t is None else F.when(F.col("event_type") == t, F.col("value"))
    hours = e.agg(*(F.max(pick(t)).alias(v) for v, t in _WEATHER.items()))
    by_day = hours.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("hour", F.struct(*_WEATHER)))).alias("h"))
    n, slots = F.day("day"), F.sequence(F.lit(0), F.lit(23))
    value = lambda v: F.transform(slots, lambda i: F.try_element_at(F.col("h"), i)[v])
    series = [(F.slice(value(v), 1, F.when(n % 7 == 3, 20).otherwise(24)) if k == 0 else value(v)).alias(v) for k, v in enumerate(_WEATHER)]
    times = F.transform(F.when(n % 13 == 7, F.slice(slots, 1, 0)).otherwise(slots), lambda i: F.format_string("%sT%02d:00", F.col("day").cast("string"), i))
    text = F.to_json(F.struct(F.col("day").cast("string").alias("day"), F.lit(-25.5).alias("lat"), F.lit(-49.4).alias("lon"), F.struct(times.alias("time"), *series).alias("hourly")))
    path = _folder(spark, "payloads")
    by_day.select(F.when(n % 11 == 5, F.left(text, F.lit(60))).otherwise(text).alias("value")).write.text(f"{path}/in")
    W.land_payloads(spark, f"{path}/in", path)
    return path


@query("""
WITH h AS (SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, """ + ", ".join(f"max(value) {f'''FILTER (WHERE event_type = '{t}')''' if t else ''} AS {v}" for v, t in _WEATHER.items()) + f"""
  FROM events GROUP BY 1, 2), d AS (SELECT DISTINCT day FROM h WHERE day(day) % 11 <> 5 AND day(day) % 13 <> 7)
SELECT d.day, r.i::BIGINT AS hour, CASE WHEN day(d.day) % 7 = 3 AND r.i >= 20 THEN NULL ELSE {W.VARIABLES[0]} END AS {W.VARIABLES[0]}, {', '.join(W.VARIABLES[1:])}
FROM d CROSS JOIN range(24) r(i) LEFT JOIN h ON h.day = d.day AND h.hour = r.i
""")
def weather_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the payloads that could be read."""
    return spark.read.parquet(f"{_landed(spark, sf_dir)}/hourly").select("day", "hour", *W.VARIABLES)


@query("""
SELECT CASE WHEN day(day) % 11 = 5 THEN 'not a payload' ELSE 'no hours' END AS reason, count(*) AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)
WHERE day(day) % 11 = 5 OR day(day) % 13 = 7 GROUP BY 1
""")
def payload_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that were refused, by reason."""
    return spark.read.parquet(f"{_landed(spark, sf_dir)}/quarantine").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_FOLDERS = "SELECT CAST(ts AS DATE) AS day, sum(strlen(event_type) + strlen(user_id::VARCHAR) + 2)::BIGINT AS size_bytes, count(*) AS n FROM events GROUP BY 1"


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one folder a day, a line for each; then only what the file system tells of them."""
    root = _folder(spark, "dated")
    e = table(spark, sf_dir, "events").select(F.concat_ws(";", "event_type", F.col("user_id").cast("string")).alias("line"), F.col("ts").cast("date").alias("day"))
    e.repartition("day").write.partitionBy("day").text(f"{root}/cis")
    return S.dated_folders(S.inventory(spark, root))


@query(f"SELECT 'cis' AS dataset, day, size_bytes, 'meter_cis_' || strftime(day, '%Y%m%d') || '.csv' AS name FROM ({_FOLDERS})")
def folder_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.folder_files(_folders(spark, sf_dir)).select("dataset", "day", "size_bytes", "name")


@query(f"""
WITH f AS ({_FOLDERS}), s AS (SELECT avg(size_bytes) AS a, stddev_samp(size_bytes) AS sd, count(*) AS n FROM f), e AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day),
o AS (SELECT count(*) AS k FROM f, s WHERE sd > 0 AND (size_bytes < greatest(0, a - 1.5 * sd) OR size_bytes > a + 1.5 * sd)), m AS (SELECT day, day IN (SELECT day FROM f) AS hit FROM e)
SELECT 'file_naming' AS check, TRUE AS passed, '0 of ' || n || ' names are invalid' AS detail FROM s
UNION ALL SELECT 'period_coverage', bool_and(hit), count(*) FILTER (WHERE hit) || ' of 31 days, missing: ' || coalesce(array_to_string(list_slice(list(day::VARCHAR ORDER BY day) FILTER (WHERE NOT hit), 1, 5), ','), '') FROM m
UNION ALL SELECT 'file_sizes', k = 0, k || ' outliers among ' || n || ' files, mean ' || CASE WHEN round(a) < 1024 THEN CAST(round(a) AS BIGINT) || ' B' WHEN round(a) < 1048576 THEN printf('%.1f KB', round(a) / 1024.0) ELSE printf('%.1f MB', round(a) / 1048576.0) END FROM o, s
UNION ALL SELECT 'ucs_file', date_diff('day', mx, DATE '2024-02-01') <= 3, 'newest ' || mx || ', ' || date_diff('day', mx, DATE '2024-02-01') || ' days old' FROM (SELECT max(day) AS mx FROM f)
""")
def folder_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The integrity report of real dated folders, from names and sizes alone."""
    found = _folders(spark, sf_dir)
    return Q.integrity_report(Q.folder_files(found), found.select("day"), AS_OF)


def _channel(k: int) -> tuple[str, int]:
    """Which events are the readings of the k-th channel table: type, and 1 for those of 50 or more."""
    return TYPES[k // 2], k % 2


def channels(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The ten channel tables and the catalogue, from ``events``: two channel ids a user, every event in one table, most of them off the grid."""
    e = table(spark, sf_dir, "events").withColumn("v", F.col("value").cast(MEASURE))
    out = {}
    for k, (name, measures) in enumerate(CHANNELS.items()):
        kind, high = _channel(k)
        rows = e.filter((F.col("event_type") == kind) & ((F.col("value") >= 50) == F.lit(bool(high))))
        made = [F.when((F.col("event_id") + j) % 4 != 0, (F.col("v") * (j + 1)).cast(MEASURE)).alias(c) for j, (c, _) in enumerate(measures)]
        out[name] = rows.select((F.col("user_id") * 2 + F.col("event_id") % 2).alias("data_id"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("tv"), *made)
    ids = e.select("user_id").distinct().select("user_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    return out | {"a_data_catalogue": ids.select((F.col("user_id") * 2 + F.col("i")).alias("data_id"), F.concat(F.lit(" 00"), "user_id").alias("meter_asset_no"))}


_WIDE = [(name, k, j) for k, measures in enumerate(CHANNELS.values()) for j, (_, name) in enumerate(measures)]
_CHANNELS_SQL = """
SELECT user_id * 2 + event_id % 2 AS data_id, nullif(user_id, 0)::VARCHAR AS nio, date_trunc('minute', ts)::TIMESTAMP AS tv,
""" + ",\n".join(
    f"  CASE WHEN event_type = '{_channel(k)[0]}' AND value {'>=' if _channel(k)[1] else '<'} 50 AND (event_id + {j}) % 4 <> 0 THEN CAST(CAST(value AS DECIMAL(18,3)) * {j + 1} AS DECIMAL(18,3)) END AS {name}"
    for name, k, j in _WIDE
) + "\nFROM events WHERE minute(ts) % 5 = 0 AND user_id <> 0"
_MAXES = ", ".join(f"max({m}) AS {m}" for m in MEASURES)
_ANY = f"coalesce({', '.join(MEASURES)}) IS NOT NULL"
TIME_GRID_SQL = f"SELECT nio, tv, {', '.join(MEASURES)} FROM (SELECT data_id, nio, tv, {_MAXES} FROM ({_CHANNELS_SQL}) GROUP BY data_id, nio, tv) WHERE {_ANY}"
_WIDE_JSON = ",\n  ".join(
    f"""'{{' || coalesce(string_agg('"' || hhmi || '":' || CAST({m} AS VARCHAR), ',' ORDER BY hhmi) FILTER (WHERE {m} IS NOT NULL), '') || '}}' AS {m}""" for m in MEASURES
)
DAILY_SQL = f"""SELECT nio, day, {_WIDE_JSON} FROM (
  SELECT nio, CAST(tv AS DATE) AS day, strftime(tv, '%H:%M') AS hhmi, {_MAXES} FROM ({_CHANNELS_SQL}) GROUP BY 1, 2, 3) WHERE {_ANY} GROUP BY nio, day"""


@query(TIME_GRID_SQL)
def time_grid_33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten channels in one slot table of 33 measures; readings off the grid fall out."""
    t = channels(spark, sf_dir)
    return R.time_grid(t, t["a_data_catalogue"])


@query(DAILY_SQL)
def daily_table_33(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per meter and day with 33 JSON series."""
    t = channels(spark, sf_dir)
    return R.daily_table(t, t["a_data_catalogue"])


_POLES = "SELECT c_custkey, 350000.0 + (c_custkey * 7919) % 300000 AS x, 6900000.0 + (c_custkey * 104729) % 500000 AS y FROM customer"


@query(f"""
WITH k AS (SELECT 6378160.0::DOUBLE AS a, 1 / 298.25::DOUBLE AS f, 6378137.0::DOUBLE AS wa, 1 / 298.257223563::DOUBLE AS wf),
e AS (SELECT *, f * (2 - f) AS e2, f / (2 - f) AS n, wf * (2 - wf) AS we2 FROM k),
p AS (SELECT c_custkey, (x - 500000)::DOUBLE AS x, (y - 10000000)::DOUBLE AS y, e.*, e2 / (1 - e2) AS ep FROM ({_POLES}), e),
m AS (SELECT *, y / (0.9996 * a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64)) AS mu FROM p),
t AS (SELECT *, mu + (3 * n / 2 - 27 * n ** 3 / 32) * sin(2 * mu) + (21 * n ** 2 / 16 - 55 * n ** 4 / 32) * sin(4 * mu) + (151 * n ** 3 / 96) * sin(6 * mu) + (1097 * n ** 4 / 512) * sin(8 * mu) AS ft FROM m),
u AS (SELECT *, ep * cos(ft) ** 2 AS c, tan(ft) ** 2 AS tt, 1 - e2 * sin(ft) ** 2 AS w FROM t),
v AS (SELECT *, a / sqrt(w) AS r, a * (1 - e2) / (w * sqrt(w)) AS mer FROM u), d AS (SELECT *, x / (r * 0.9996) AS d FROM v),
g AS (SELECT *, ft - (r * tan(ft) / mer) * (d ** 2 / 2 - (5 + 3 * tt + 10 * c - 4 * c ** 2 - 9 * ep) * d ** 4 / 24 + (61 + 90 * tt + 298 * c + 45 * tt ** 2 - 252 * ep - 3 * c ** 2) * d ** 6 / 720) AS la,
  radians(-51::DOUBLE) + (d - (1 + 2 * tt + c) * d ** 3 / 6 + (5 - 2 * c + 28 * tt - 3 * c ** 2 + 8 * ep + 24 * tt ** 2) * d ** 5 / 120) / cos(ft) AS lo FROM d),
s AS (SELECT *, a / sqrt(1 - e2 * sin(la) ** 2) AS rr FROM g),
z AS (SELECT *, rr * cos(la) * cos(lo) - 67.35 AS gx, rr * cos(la) * sin(lo) + 3.88 AS gy, rr * (1 - e2) * sin(la) - 38.22 AS gz FROM s),
q AS (SELECT *, sqrt(gx ** 2 + gy ** 2) AS flat, wa * sqrt(1 - we2) AS wb FROM z), b AS (SELECT *, atan2(gz * wa, flat * wb) AS ang FROM q)
SELECT c_custkey, round(degrees(atan2(gz + we2 / (1 - we2) * wb * sin(ang) ** 3, flat - we2 * wa * cos(ang) ** 3)), 6) AS lat, round(degrees(atan2(gy, gx)), 6) AS lon FROM b
""")
def pole_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plane coordinates, made of customers' numbers, as latitude and longitude."""
    k = F.col("c_custkey")
    poles = table(spark, sf_dir, "customer").select("c_custkey", (350000 + k * 7919 % 300000).alias("x"), (6900000 + k * 104729 % 500000).alias("y"))
    return with_pole_position(poles, "x", "y").select("c_custkey", F.round("LAT_POSTE_WGS84", 6).alias("lat"), F.round("LONG_POSTE_WGS84", 6).alias("lon"))


@query(f"""SELECT * FROM ({NETWORK_SQL}) WHERE "GEDIS_ALIMENTADOR" IN ('NATION_1', 'NATION_4', 'NATION_7', 'NATION_12')""")
def feeder_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network of a few feeders."""
    return topology(network(spark, sf_dir), feeders=["NATION_1", "NATION_4", "NATION_7", "NATION_12"])


def registry_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The registry's twelve tables: customers as units and meters, nations as localities, regions as towns, orders as generators, classes and benefits."""
    c, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    k, day = F.col("c_custkey"), F.col("o_orderdate").cast("date")
    text = lambda v: F.lit(v).cast("string")
    meter = F.lpad(k.cast("string"), 9, "0")
    return {
        "rel_equip_uc": c.select(k.alias("cod_un_cons_reu"), meter.alias("num_eqip_reu"), day_literal("2020-01-01").alias("dta_ins_reu"), F.when(F.col("c_acctbal") < 0, day_literal("2024-01-01")).alias("dta_reti_reu")),
        "cad_uc_ee": c.select(
            k.alias("cod_un_cons_uee"), F.col("c_nationkey").alias("cod_loc_uee"), text("LG").alias("cod_situ_uee"), day_literal("2021-01-01").alias("dta_situ_uee"), text("3").alias("cod_tipo_fase_uee"),
            text("B").alias("cod_gru_tens_fat_uee"), F.when(k % 2 == 0, "1").alias("cod_sub_gru_fat_uee"), F.when(k % 5 == 0, "9109").otherwise("1").alias("cod_clas_cons_uee"), text("a").alias("cod_tipo_entg_uee"),
            F.when(k % 3 == 0, "05").otherwise("01").alias("cod_tipo_tar_fat_uee"), k.alias("num_cli_uee"), F.lit(127).alias("qtd_tens_lig_uee"), text("d").alias("cod_tipo_disj_uee"), k.alias("num_pste_uee")),
        "tab_localidade": n.select(F.col("n_nationkey").alias("cod_loc_loc"), F.col("n_regionkey").alias("cod_mun_loc")),
        "tab_municipio": r.select(F.col("r_regionkey").alias("cod_mun_mun"), F.col("r_name").alias("nom_mun_mun")),
        "cad_equip_med": c.select(meter.alias("num_eqip_emd"), F.col("c_mktsegment").alias("cod_sub_tipo_eqip_emd")),
        "tab_sub_tipo_equip": c.select("c_mktsegment").distinct().select(F.col("c_mktsegment").alias("cod_sub_tipo_eqip_ste"), F.concat(F.lower("c_mktsegment"), F.when(F.col("c_mktsegment") == "BUILDING", " intel").otherwise("")).alias("des_sub_tipo_eqip_ste")),
        "cad_coordenada_uc_ee": c.select(k.alias("cod_un_cons_xxx"), (-k / 1000).alias("num_coory_xxx"), (-k / 500).alias("num_coorx_xxx")),
        "cad_uc_ger_energia": o.select(
            F.col("o_custkey").alias("cod_un_cons_utg"), F.col("o_orderpriority").alias("cod_modl_dis_utg"), F.when(F.col("o_orderpriority") == "5-LOW", day).alias("dta_fim_vign_utg"),
            F.when(F.col("o_orderstatus") == "F", "AT").when(F.col("o_orderstatus") != "P", "IN").alias("cod_situ_utg"), (F.col("o_totalprice") / 10).alias("qtd_pot_ger_utg")),
        "rel_classif_mmgd": o.select(F.col("o_custkey").alias("cod_un_cons_kcg"), F.col("o_orderkey").alias("num_seq_kcg"), day.alias("dta_inic_vign_kcg"), F.when(F.col("o_orderstatus") != "O", F.date_add(day, 30)).alias("dta_fim_vign_kcg")),
        "rel_det_classif_mmgd": o.select(F.col("o_orderkey").alias("num_seq_kcd"), F.col("o_orderpriority").alias("cod_tipo_css_ger_kcd")),
        "rel_micro_ger_benef": o.select(
            F.col("o_custkey").alias("cod_un_cons_ben_xbg"), F.col("o_custkey").alias("num_cli_ben_xbg"), F.when(F.col("o_orderstatus") == "P", "AT").otherwise("IN").alias("con_val_xbg"), day.alias("dta_inic_vign_xbg"), F.lit(None).cast("date").alias("dta_fim_vign_xbg")),
    }


_RUN_COLUMNS = ("UC", "NIO", "report_day", "SMART", "MUNICIPIO", "SUB_GRUPO", "TARIFA_BRANCA", "BAIXA_RENDA", "MODALIDADE_GERACAO", "GERACAO_PROPRIA", "TIPO_GD", "DATA_INICIO_GD", "BENEFICIARIA_GD", "INICIO_BENEFICIARIA", "GEO_ALIMENTADOR", "GEO_SUBESTACAO", "HAS_MDM_DATA", "fa_interval", "u_l1", "fa_md_t4")


@query(f"""
WITH net AS ({NETWORK_SQL}), mdm AS ({DAILY_SQL}), days AS (SELECT unnest([DATE '2024-01-29', DATE '2024-01-30', DATE '2024-01-31']) AS day),
own AS (SELECT o_custkey AS uc, max(o_orderpriority) AS mode FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderstatus IN ('F', 'P') AND o_totalprice / 10 <= 25000 GROUP BY 1),
cls AS (SELECT o_custkey AS uc, o_orderpriority AS kind, CAST(o_orderdate AS DATE) AS since FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 30 END DESC NULLS FIRST, o_orderdate DESC, o_orderpriority) = 1),
ben AS (SELECT o_custkey AS uc, max(CAST(o_orderdate AS DATE)) AS since FROM orders WHERE o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) <= DATE '2024-02-01' GROUP BY 1)
SELECT c_custkey::VARCHAR AS "UC", c_custkey::VARCHAR AS "NIO", days.day AS report_day, CASE WHEN c_mktsegment = 'BUILDING' OR c_custkey BETWEEN 41000000 AND 46000000 THEN 1 ELSE 0 END AS "SMART", r_name AS "MUNICIPIO",
  CASE WHEN c_custkey % 2 = 0 THEN 'B1' ELSE 'B' END AS "SUB_GRUPO", CASE WHEN c_custkey % 3 = 0 THEN 'S' ELSE 'N' END AS "TARIFA_BRANCA", CASE WHEN c_custkey % 5 = 0 THEN 'S' ELSE 'N' END AS "BAIXA_RENDA",
  own.mode AS "MODALIDADE_GERACAO", CASE WHEN own.uc IS NULL THEN 'N' ELSE 'S' END AS "GERACAO_PROPRIA", cls.kind AS "TIPO_GD", cls.since::VARCHAR AS "DATA_INICIO_GD", CASE WHEN ben.uc IS NULL THEN 'N' ELSE 'S' END AS "BENEFICIARIA_GD",
  ben.since::VARCHAR AS "INICIO_BENEFICIARIA", net."ALIMENTADOR" AS "GEO_ALIMENTADOR", net."SUBESTACAO" AS "GEO_SUBESTACAO", mdm.nio IS NOT NULL AS "HAS_MDM_DATA", fa_interval, u_l1, fa_md_t4
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN net ON net."UC" = c_custkey CROSS JOIN days
LEFT JOIN own ON own.uc = c_custkey LEFT JOIN cls ON cls.uc = c_custkey LEFT JOIN ben ON ben.uc = c_custkey LEFT JOIN mdm ON mdm.nio = c_custkey::VARCHAR AND mdm.day = days.day
WHERE c_acctbal >= 0 AND c_custkey <> 0
""")
def daily_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over a period, from all source tables to the published report; the day that is not over is left out."""
    out = _folder(spark, "run")
    P.run_period(registry_tables(spark, sf_dir) | network(spark, sf_dir) | channels(spark, sf_dir), out, "2024-01-29", "2024-02-01", AS_OF)
    return V.read(spark, f"{out}/report").select(*_RUN_COLUMNS)


@query("""
WITH c AS (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS nio, c_custkey::VARCHAR AS uc, c_custkey, c_nationkey, c_mktsegment = 'BUILDING' AS p FROM customer),
i AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY c_custkey::VARCHAR) - 1 AS i, count(*) OVER (PARTITION BY p) AS n FROM c),
k AS (SELECT p, any_value(n) AS n, CASE WHEN p THEN least(any_value(n), 200) ELSE 200 - coalesce((SELECT least(count(*), 200) FROM c WHERE p), 0) END AS k FROM i GROUP BY p),
pos AS (SELECT p, CASE WHEN k >= n THEN j WHEN k = 1 THEN n // 2 ELSE CAST(round_even(j * (n - 1) / (k - 1)::DOUBLE, 0) AS BIGINT) END AS i FROM k, range(200) r(j) WHERE j < least(k, n)),
taken AS (SELECT i.*, n_name FROM i JOIN nation ON n_nationkey = c_nationkey WHERE (p, i) IN (SELECT (p, i) FROM pos)),
d AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT coalesce(nio, o_custkey::VARCHAR) AS "NIO", uc AS "UC", CASE WHEN uc IS NULL THEN NULL WHEN p THEN 'S' ELSE 'N' END AS "SMART", n_name AS "FEEDER", n_orders FROM d LEFT JOIN taken ON o_custkey = c_custkey
""")
def sample_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample flow (its size is the feature): 200 meters, smart ones first, with feeder and series; meters outside the sample keep their key."""
    return _sample(spark, sf_dir)[0]


def _sample(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    uc = F.col("c_custkey").cast("string")
    base = c.select(F.lpad(uc, 9, "0").alias("NIO"), uc.alias("UC"), F.when(F.col("c_mktsegment") == "BUILDING", "S").otherwise("N").alias("SMART"))
    geo = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(uc.alias("UC"), F.col("n_name").alias("FEEDER"))
    daily = o.groupBy(F.col("o_custkey").cast("string").alias("NIO")).agg(F.count(F.lit(1)).alias("n_orders"))
    return P.sample_flow(base, geo, daily)


@query("SELECT doc_id::VARCHAR AS doc_id, md5(text) AS digest, lang FROM documents WHERE text <> ''")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with their line breaks, quotes and semicolons, as delimited text and back, all columns text."""
    path = _folder(spark, "csv")
    S.write_csv(table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", "text", "lang"), path)
    return S.read_csv(spark, path, ["doc_id", "text", "lang"]).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("SELECT DISTINCT c_name AS value FROM customer")
def list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of keys, one a line, and back."""
    path = _folder(spark, "list")
    S.write_list(table(spark, sf_dir, "customer").select("c_name").distinct(), "c_name", path)
    return spark.read.text(path)


@query("""
SELECT 'customers' AS name, count(*) AS rows, NULL::VARCHAR AS error FROM customer UNION ALL SELECT 'orders', count(*), NULL FROM orders
UNION ALL SELECT 'paid orders', count(*) FILTER (WHERE o_orderstatus = 'F'), NULL FROM orders UNION ALL SELECT 'checks', NULL, 'no header'
""")
def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a run: rows as its writes counted them, and an error."""
    out, run = _folder(spark, "steps"), U.Run(spark)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.trunc("o_orderdate", "MM").alias("report_day"))
    run.write("customers", table(spark, sf_dir, "customer").select("c_custkey", day_literal(AS_OF).alias("report_day")), f"{out}/customers")
    run.publish("orders", o, f"{out}/orders")
    run.publish("paid orders", o.filter("o_orderstatus = 'F'"), f"{out}/orders")
    run.error("checks", "no header")
    run.save(f"{out}/runs")
    return spark.read.parquet(f"{out}/runs").select("name", "rows", "error")


def _bytes(text: Column) -> Column:
    """Texts as Latin-1 where that holds them (every other one), else as UTF-8."""
    return F.when(text.rlike(r"\A[\x00-\xFF]*\z") & (F.col("doc_id") % 2 == 0), F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that came as bytes in two encodings."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(decoded(_bytes(F.col("text")))).alias("digest"))


@query("""
SELECT event_id, hour(TRY_STRPTIME(CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN '31/02/2024 10:00:00' ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END, '%d/%m/%Y %H:%M:%S'))::INT AS hour FROM events
""")
def reading_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of times written as text, null where the text is no time."""
    n = F.col("event_id") % 4
    said = F.when(n == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(n == 1, "31/02/2024 10:00:00").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", reading_hour(said).alias("hour"))
