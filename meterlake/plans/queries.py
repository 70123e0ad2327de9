"""Registered queries: the operators over the given tables, each with its SQL.

``events`` stands for readings: the user is the meter, the type the channel, the value the measure.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions.calendar import day_literal, slot_start
from meterlake.functions.keys import (
    MODES, distinct_keys, is_truthy, joined_text, keep_first, key_of, normalize_key, size_text,
)
from meterlake.operators import quality as Q
from meterlake.operators import readings as R
from meterlake.operators import weather as W
from meterlake.operators.latest import latest_by_end, latest_open_first, valid_in_month
from meterlake.operators.registry import active_meters, own_generation, smart_flag, yes_no
from meterlake.operators.sampling import spread_sample
from meterlake.operators.topology import join_colliding, join_prefixed, topology
from meterlake.plans import report as P
from meterlake.sources.files import inventory, read_days, read_jdbc, write_dated, write_jdbc
from meterlake.sources.runs import days_back_lookup, key_snapshot
from meterlake.sources.shared import job_dir
from meterlake.sources.tables import table

TYPES = ("click", "error", "purchase", "signup", "view")
AS_OF = "2024-02-01"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value").cast("decimal(18,2)")
    return table(spark, sf_dir, "events").select(
        "user_id", slot_start(F.col("ts")).alias("tv"), *(F.when(F.col("event_type") == t, value).alias(t) for t in TYPES)
    )


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.slot_values(_readings(spark, sf_dir), ["user_id"], TYPES)


_SLOTS = """
SELECT user_id, CAST(ts AS DATE) AS day, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%H:%M') AS hhmi,
  """ + ",\n  ".join(f"max(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES) + """
FROM events GROUP BY 1, 2, 3
HAVING count(CASE WHEN event_type IN ('click', 'error', 'purchase', 'signup', 'view') THEN value END) > 0
"""
_SERIES = ",\n  ".join(
    f"""'{{' || coalesce(string_agg('"' || hhmi || '":' || CAST({t} AS VARCHAR), ',' ORDER BY hhmi) FILTER (WHERE {t} IS NOT NULL), '') || '}}' AS {t}""" for t in TYPES
)
_DAILY = f"SELECT user_id, day, {_SERIES} FROM ({_SLOTS}) GROUP BY 1, 2"


@query(_DAILY)
def daily_series_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day, a JSON series for each type."""
    slots = R.slot_values(_readings(spark, sf_dir), ["user_id"], TYPES, by_day=True)
    return R.daily_series(slots, ["user_id"], TYPES)


@query(_SLOTS)
def slot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slots(spark, sf_dir)


@query(f"""
WITH s AS ({_SLOTS}), g AS (
  SELECT user_id, DATE '2024-01-02' AS day, strftime(TIMESTAMP '2024-01-02' + INTERVAL 5 MINUTE * i, '%H:%M') AS hhmi
  FROM (SELECT DISTINCT user_id FROM events), range(288) r(i)
)
SELECT user_id, day, hhmi, click, error, purchase, signup, view FROM g LEFT JOIN s USING (user_id, day, hhmi)
""")
def dense_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 288 slots of a day for every user."""
    return R.dense(_slots(spark, sf_dir), table(spark, sf_dir, "events"), ["user_id"], day_literal("2024-01-02"))


@query(f"""
WITH s AS ({_SLOTS})
""" + " UNION ALL ".join(f"SELECT user_id, day, '{t}' AS measure, hhmi, {t} AS value FROM s WHERE {t} IS NOT NULL" for t in TYPES))
def series_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON series read back to rows."""
    return R.series_rows(daily_series_json(spark, sf_dir), ["user_id"], TYPES, "decimal(18,2)")


@query(r"""
SELECT c_custkey, nullif(ltrim(d, '0'), '') AS digits,
  CASE WHEN ltrim(d, '0') <> '' THEN ltrim(d, '0') WHEN d <> '' THEN '0' ELSE '' END AS digits_keep_zero,
  CASE WHEN trim(t) <> '' AND ltrim(trim(t), '0') = '' THEN '0' ELSE ltrim(trim(t), '0') END AS zeros_only,
  nullif(ltrim(trim(t), '0'), '') AS zeros_only_null, nullif(regexp_replace(c_custkey::VARCHAR, '^0+', ''), '') AS number_key
FROM (SELECT c_custkey, regexp_replace(trim(t), '[^0-9]', '', 'g') AS d, t
  FROM (SELECT c_custkey, ' ' || CASE WHEN c_custkey % 3 = 0 THEN substr(c_name, 10) WHEN c_custkey % 3 = 1 THEN c_name ELSE repeat('0', (c_custkey % 5)::INT) END || ' ' AS t FROM customer))
""")
def key_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names and parts of them as keys, in all modes."""
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.expr("substr(c_name, 10)")).when(k % 3 == 1, F.col("c_name")).otherwise(F.repeat(F.lit("0"), (k % 5).cast("int")))
    c = table(spark, sf_dir, "customer").withColumn("t", F.concat(F.lit(" "), text, F.lit(" ")))
    c = c.withColumn("d", k.cast("double"))
    return c.select("c_custkey", *(normalize_key(F.col("t"), m).alias(m) for m in MODES), key_of(c, "d").alias("number_key"))


@query("""
SELECT DISTINCT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE upper(r_name) = 'EUROPE'
""")
def active_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    met = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return met.filter(F.upper("r_name") == "EUROPE").select("n_name", "c_mktsegment").distinct()


@query("""
SELECT p_partkey,
  CASE WHEN (coalesce(TRY_CAST(CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE (p_partkey * 230000)::VARCHAR END AS BIGINT) BETWEEN 41000000 AND 46000000, FALSE)
    OR upper(coalesce(p_type, ' ')) LIKE '%INTEL%') AND upper(coalesce(p_type, ' ')) NOT LIKE '%QUALI%' THEN 1 ELSE 0 END AS smart,
  CASE WHEN p_size = 5 THEN 'S' ELSE 'N' END AS five, nullif(concat(nullif(p_brand, 'Brand#1'), p_type), '') AS label
FROM part
""")
def class_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("p_partkey") % 7 == 0, F.lit("x")).otherwise((F.col("p_partkey") * 230000).cast("string"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        smart_flag(number, F.col("p_type")).alias("smart"),
        yes_no(F.col("p_size") == 5).alias("five"),
        joined_text(F.nullif("p_brand", F.lit("Brand#1")), F.col("p_type")).alias("label"),
    )


@query("""
SELECT o_custkey, o_orderkey, o_start, o_end FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_end IS NULL THEN 1 ELSE 2 END, o_end DESC NULLS FIRST, o_start DESC NULLS FIRST, o_orderkey) AS rn
  FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_start,
    CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 30 END AS o_end FROM orders)) WHERE rn = 1
""")
def latest_by_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    o = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", day.alias("o_start"), F.when(F.col("o_orderstatus") != "O", F.date_add(day, 30)).alias("o_end")
    )
    return latest_open_first(o, ["o_custkey"], "o_start", "o_end", [F.col("o_orderkey")])


@query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, s, e FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY coalesce(e, DATE '2999-12-31') DESC NULLS FIRST, s DESC NULLS FIRST, l_orderkey, l_linenumber) AS rn
  FROM (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS s,
      CASE WHEN l_quantity < 40 THEN CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) END AS e FROM lineitem)
  WHERE coalesce(e >= DATE '1998-01-01', TRUE) AND s <= DATE '1998-01-01') WHERE rn = 1
""")
def latest_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate").cast("date")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", day.alias("s"),
        F.when(F.col("l_quantity") < 40, F.date_add(day, F.col("l_quantity").cast("int"))).alias("e"),
    ).filter(valid_in_month(F.col("s"), F.col("e"), day_literal("1998-01-01")))
    return latest_by_end(rows, ["l_partkey", "l_suppkey"], "s", "e", [F.col("l_orderkey"), F.col("l_linenumber")])


@query("""
SELECT o_custkey, max(o_orderpriority) AS top_priority FROM orders
WHERE (o_orderstatus = 'F' OR nullif(o_orderstatus, 'P') IS NULL) AND o_totalprice <= 250000 GROUP BY 1
""")
def max_with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.nullif("o_orderstatus", F.lit("P"))
    o = table(spark, sf_dir, "orders").filter(((F.col("o_orderstatus") == "F") | status.isNull()) & (F.col("o_totalprice") <= 250000))
    return o.groupBy("o_custkey").agg(F.max("o_orderpriority").alias("top_priority"))


@query("""
SELECT DISTINCT l_suppkey, s_name, n_name, r_name, h.s_suppkey AS rich FROM lineitem
JOIN supplier s ON l_suppkey = s.s_suppkey LEFT JOIN nation ON s.s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'
LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) h ON h.s_suppkey = l_suppkey
WHERE s_name NOT LIKE '%7' AND l_returnflag IN ('R', 'N')
""")
def topology_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, s, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    rich = s.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("rich"))
    met = (
        l.filter(F.col("l_returnflag").isin("R", "N")).select("l_suppkey").distinct()  # each supplier once before the chain
        .join(s.filter(~F.col("s_name").like("%7")), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(r.filter("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(rich, F.col("l_suppkey") == F.col("rich"), "left")
    )
    return met.select("l_suppkey", "s_name", "n_name", "r_name", "rich").distinct()


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""")
def key_list_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a list of customers; both sides' keys are normalised in one way, which keeps zero and signs."""
    keys = distinct_keys(table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'"), "c_custkey", "zeros_only")
    o = table(spark, sf_dir, "orders")
    return o.join(keys, key_of(o, "o_custkey", "zeros_only") == keys["key"], "left_semi").select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
SELECT k, c_custkey, n_name AS "GEO_n_name", n_regionkey AS "GEO_n_regionkey" FROM (SELECT c_custkey, c_nationkey AS k FROM customer)
JOIN (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 3) ON k = n_nationkey
""")
def prefixed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey")
    return join_prefixed(c, n, "k")


@query("""
SELECT c_custkey, k, name, n_name AS "GEO_name", n_regionkey FROM (SELECT c_custkey, c_nationkey AS k, c_name AS name FROM customer)
LEFT JOIN (SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 3) ON k = n_nationkey
""")
def collision_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"))
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    return join_colliding(c, n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), "n_regionkey"), "k", "GEO_")


@query("""
SELECT user_id, event_id, ts, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1
""")
def keep_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return keep_first(e, ["user_id"], [F.col("ts"), F.col("event_id")])


_REPORT_DAYS = "DATE '2024-01-02', DATE '2024-01-03'"


@query(f"""
WITH d AS ({_DAILY}), c AS (SELECT c_custkey AS "NIO", c_name, unnest([{_REPORT_DAYS}]) AS "REPORT_DAY" FROM customer)
SELECT c.*, d.day AS "DIA", click, error, purchase, signup, view, d.day IS NOT NULL AS "HAS_MDM_DATA"
FROM c LEFT JOIN d ON d.user_id = c."NIO" AND d.day = c."REPORT_DAY"
""")
def report_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers on two days, with their series where there are any."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("NIO"), "c_name")
    days = spark.range(1).select(F.explode(F.array(day_literal("2024-01-02"), day_literal("2024-01-03"))).alias("day"))
    return P.report(c, daily_series_json(spark, sf_dir).withColumnRenamed("user_id", "NIO"), days)


@query("""
SELECT coalesce(c.nio, o.nio) AS "NIO", c_acctbal, n_orders, o.spent FROM
  (SELECT c_custkey::VARCHAR AS nio, c_acctbal FROM customer WHERE c_acctbal > 0) c
RIGHT JOIN (SELECT o_custkey::VARCHAR AS nio, count(*) AS n_orders, sum(o_totalprice::DECIMAL(18,2)) AS spent FROM orders GROUP BY 1) o USING (nio)
""")
def report_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer, with the balance of those in credit."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("NIO"), "c_acctbal")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("NIO")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spent")
    )
    return P.sample_report(c, o)


@query("""
SELECT c."NIO", c_acctbal, n_orders FROM (SELECT lpad(c_custkey::VARCHAR, 9, '0') AS "NIO", c_custkey, c_acctbal FROM customer) c
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def export_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("NIO"), "c_acctbal")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("NIO")).agg(F.count(F.lit(1)).alias("n_orders"))
    return P.export_join(c, o)


@query("SELECT median(c_acctbal) AS lat, median(CASE WHEN c_custkey % 2 = 0 THEN c_custkey END)::DOUBLE AS lon FROM customer")
def median_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("LAT"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("LONG"))
    return W.median_point(c)


_HOURS = "SELECT CAST(ts AS DATE) AS day, hour(ts) AS hour, max(CASE WHEN event_type = 'signup' THEN CAST(value AS DECIMAL(18,2)) END) AS top FROM events GROUP BY 1, 2"


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hour's highest signup; null where an hour has none."""
    e = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour"))
    return e.agg(F.max(F.when(F.col("event_type") == "signup", F.col("value").cast("decimal(18,2)"))).alias("top"))


@query(f"""
WITH h AS ({_HOURS}), d AS (SELECT DISTINCT day FROM h), j AS (
  SELECT d.day, '{{' || string_agg('"' || lpad(r.i::VARCHAR, 2, '0') || ':00":' || coalesce(h.top::VARCHAR, 'null'), ',' ORDER BY r.i) || '}}' AS "TOP"
  FROM d CROSS JOIN range(24) r(i) LEFT JOIN h ON h.day = d.day AND h.hour = r.i GROUP BY 1)
SELECT user_id, day, "TOP" FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN j
""")
def hourly_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user with each day's hourly maxima as JSON of 24 keys."""
    return W.for_meters(table(spark, sf_dir, "events").select("user_id").distinct(), W.daily_weather(_hourly(spark, sf_dir), ["top"]))


@query(f"""
WITH s AS ({_SLOTS}), h AS ({_HOURS})
SELECT user_id, s.day, hhmi, click, view, h.top AS weather_top, CAST(substr(hhmi, 1, 2) AS INT) AS hour FROM s LEFT JOIN h ON h.day = s.day AND h.hour = CAST(substr(hhmi, 1, 2) AS INT)
""")
def hour_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _slots(spark, sf_dir).select("user_id", "day", "hhmi", "click", "view", F.substring("hhmi", 1, 2).cast("int").alias("hour"))
    return W.onto_slots(s, _hourly(spark, sf_dir))


@query("""
WITH c AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment = 'BUILDING' ORDER BY c_custkey) - 1 AS i,
  count(*) OVER (PARTITION BY c_mktsegment = 'BUILDING') AS n, c_mktsegment = 'BUILDING' AS p FROM customer),
k AS (SELECT p, any_value(n) AS n, CASE WHEN p THEN least(any_value(n), 50) ELSE 50 - coalesce((SELECT least(count(*), 50) FROM customer WHERE c_mktsegment = 'BUILDING'), 0) END AS k FROM c GROUP BY p),
pos AS (SELECT p, CASE WHEN k >= n THEN j WHEN k = 1 THEN n // 2 ELSE CAST(round_even(j * (n - 1) / (k - 1)::DOUBLE, 0) AS BIGINT) END AS i
  FROM k, range(50) r(j) WHERE j < least(k, n))
SELECT c_custkey, c_mktsegment FROM c WHERE (p, i) IN (SELECT (p, i) FROM pos)
""")
def spread_sample_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spread sample of 50 customers, one segment first (a sampling operator: the size is the feature)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return spread_sample(c, 50, [F.col("c_custkey")], F.col("c_mktsegment") == "BUILDING")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10")
def dup_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most repeated keys (a top-k report)."""
    return Q.top_duplicates(table(spark, sf_dir, "orders"), ["o_custkey"])


@query("""
WITH k AS (SELECT upper(trim(coalesce(o_custkey::VARCHAR, ''))) AS a, upper(trim(coalesce(nullif(o_orderpriority, '1-URGENT'), ''))) AS b FROM orders),
t AS (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT a, b FROM k)) AS rep, count(*) FILTER (WHERE a = '') AS ba, count(*) FILTER (WHERE b = '') AS bb FROM k)
SELECT 'has_header' AS check, TRUE AS passed, '2 columns' AS detail UNION ALL SELECT 'key_columns_present', TRUE, '2 key columns'
UNION ALL SELECT 'no_nulls_in_keys', ba = 0 AND bb = 0, CASE WHEN ba = 0 AND bb = 0 THEN 'no blank keys' ELSE concat_ws(', ', CASE WHEN ba > 0 THEN 'O_CUSTKEY: ' || ba END, CASE WHEN bb > 0 THEN 'PRIO: ' || bb END) END FROM t
UNION ALL SELECT 'row_count_coherent', n BETWEEN e - e // 10 AND e + e // 10, n || ' rows, expected ' || (e - e // 10) || ' to ' || (e + e // 10) FROM (SELECT count(*) AS n FROM k), (SELECT 10 * count(*) AS e FROM customer)
UNION ALL SELECT 'no_duplicates', rep = 0, rep || ' repeated rows' FROM t
""")
def verify_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("prio"))
    return Q.verify_output(o, ["O_CUSTKEY", "PRIO"], 10 * table(spark, sf_dir, "customer").count())


@query("""
SELECT count(*) FILTER (WHERE k IS NOT NULL)::BIGINT AS matched, count(*) FILTER (WHERE k IS NULL)::BIGINT AS unmatched
FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) ON c_custkey = k
""")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return Q.match_counts(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""
WITH e AS (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day),
h AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events),
m AS (SELECT g.user_id, e.day, h.day IS NOT NULL AS hit FROM (SELECT DISTINCT user_id FROM h) g CROSS JOIN e LEFT JOIN h ON h.user_id = g.user_id AND h.day = e.day)
SELECT user_id, count(*) AS total_days, count(*) FILTER (WHERE hit) AS covered_days, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 1)::DOUBLE AS coverage_percent,
  bool_and(hit) AS complete, coalesce(string_agg(day::VARCHAR, ',' ORDER BY day) FILTER (WHERE NOT hit), '') AS missing FROM m GROUP BY user_id
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days with and without an event of each user."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("day"))
    return Q.coverage(e, day_literal("2023-12-30"), day_literal("2024-01-31"), by=["user_id"])


_SIZES = "SELECT CAST(o_orderdate AS DATE) AS file_date, count(*) * 1000 + sum(o_orderkey % 7)::BIGINT AS size_bytes FROM orders GROUP BY 1"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("file_date"))
    return o.agg((F.count(F.lit(1)) * 1000 + F.sum(F.col("o_orderkey") % 7)).alias("size_bytes"))


@query(f"""
WITH f AS ({_SIZES})
SELECT count(*) AS count, round(avg(size_bytes), 4) AS mean_bytes, round(coalesce(stddev_samp(size_bytes), 0), 4) AS std_bytes, min(size_bytes)::BIGINT AS min_bytes, max(size_bytes)::BIGINT AS max_bytes,
  median(size_bytes)::DOUBLE AS median_bytes, (SELECT file_date FROM f ORDER BY size_bytes, file_date LIMIT 1) AS min_date, (SELECT file_date FROM f ORDER BY size_bytes DESC, file_date LIMIT 1) AS max_date FROM f
""")
def size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Q.size_stats(_sizes(spark, sf_dir))
    return s.withColumns({c: F.round(c, 4) for c in ("mean_bytes", "std_bytes")})


@query(f"""
WITH f AS ({_SIZES}), s AS (SELECT avg(size_bytes) AS m, stddev_samp(size_bytes) AS d FROM f)
SELECT file_date, size_bytes::BIGINT AS size_bytes FROM f, s WHERE d > 0 AND (size_bytes < greatest(0, m - 1.5 * d) OR size_bytes > m + 1.5 * d)
""")
def size_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.size_outliers(_sizes(spark, sf_dir))


@query(r"""
SELECT file_date, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%.1f MB', b / 1048576.0) END AS size
FROM (SELECT file_date, (size_bytes * (1 + (day(file_date) % 3) * 300) // 40)::BIGINT AS b FROM (""" + _SIZES + """))
""")
def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sizes(spark, sf_dir)
    return s.select("file_date", size_text(F.expr("size_bytes * (1 + (day(file_date) % 3) * 300) div 40")).alias("size"))


@query("""
SELECT event_type, max(CAST(ts AS DATE)) AS newest, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-01')::INT AS age_days, date_diff('day', max(CAST(ts AS DATE)), DATE '2024-02-01') <= 3 AS fresh FROM events GROUP BY 1
""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.freshness(table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date")), AS_OF, ["event_type"])


def _daily_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("ucs"), F.col("ts").cast("date").alias("date")).filter("ucs IS NOT NULL").distinct()
    return d.join(d.groupBy("date").agg(F.count(F.lit(1)).alias("count")), "date")


_KEYS = "SELECT DISTINCT user_id::VARCHAR AS ucs, CAST(ts AS DATE) AS date FROM events WHERE user_id IS NOT NULL"


@query(f"SELECT ucs, date, count(*) OVER (PARTITION BY date) AS count FROM ({_KEYS})")
def daily_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's users, with their number on every row; all days in one job."""
    return _daily_keys(spark, sf_dir)


@query(f"SELECT ucs, date, count(*) OVER (PARTITION BY date) AS count FROM ({_KEYS}) WHERE date BETWEEN DATE '2023-12-28' AND DATE '2024-01-05'")
def daily_keys_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily_keys(spark, sf_dir).filter(F.col("date").between(day_literal("2023-12-28"), day_literal("2024-01-05")))


@query(f"""
SELECT ucs, (SELECT count(*) FROM ({_KEYS}) WHERE date = DATE '2024-01-05') AS count, date, '2024-01-06' AS created_at FROM ({_KEYS}) WHERE date = DATE '2024-01-05'
""")
def key_snapshot_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("ts").cast("date") == day_literal("2024-01-05"))
    return key_snapshot(e.select("user_id"), "2024-01-05", "2024-01-06")


@query("""
SELECT i::INT AS days_back, (DATE '2024-02-01' - i::INT) AS day, (DATE '2024-02-01' - i::INT) IN (SELECT CAST(ts AS DATE) FROM events) AS found FROM range(1, 41) r(i)
""")
def days_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return days_back_lookup(spark, e.select(F.col("ts").alias("day")), AS_OF, 40)


_NAMES = """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'meter_cis_' WHEN 1 THEN 'meter_mdm_sample_200_' WHEN 2 THEN '_meter_geo_' WHEN 3 THEN 'other_' ELSE 'meter_daily_report_' END
  || (20240100 + page_id % 40)::VARCHAR || CASE page_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.parquet' ELSE '.txt' END AS name, (1000 + page_id % 13)::BIGINT AS size_bytes FROM pages
"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "element_at(array('meter_cis_', 'meter_mdm_sample_200_', '_meter_geo_', 'other_', 'meter_daily_report_'), cast(page_id % 5 as int) + 1)"
    end = "element_at(array('.csv', '.parquet', '.txt'), cast(page_id % 3 as int) + 1)"
    name = F.expr(f"concat({kind}, cast(20240100 + page_id % 40 as string), {end})")
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), (F.lit(1000) + F.col("page_id") % 13).alias("size_bytes"))


_DATED = f"""
SELECT page_id, name, size_bytes, TRY_CAST(TRY_STRPTIME(regexp_extract(name, '_([0-9]{{8}})\\.(csv|parquet)$', 1), '%Y%m%d') AS DATE) AS file_date,
  regexp_matches(name, '^meter_(cis|geo|mdm|timegrid|model_input|daily_report|weather)(_sample_[0-9]+)?_[0-9]{{8}}\\.(csv|parquet)$') AS shaped FROM ({_NAMES})
WHERE regexp_matches(name, '\\.(csv|parquet)$') AND name NOT LIKE '.%' AND substr(name, 1, 1) <> '_'
"""


@query(f"SELECT page_id, name, size_bytes, file_date, shaped AND file_date IS NOT NULL AS valid FROM ({_DATED})")
def file_name_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.named_files(_names(spark, sf_dir))


@query(f"""
SELECT page_id, file_date, DATE '2024-01-31' AS expected_date, coalesce(file_date = DATE '2024-01-31', FALSE) AS valid,
  CASE WHEN file_date IS NULL THEN 'no day in the name' WHEN file_date = DATE '2024-01-31' THEN 'as expected' ELSE 'another day' END AS message FROM ({_DATED})
""")
def file_days_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Q.named_files(_names(spark, sf_dir)).drop("valid", "file_date")
    return Q.days_back_consistent(files, F.date_sub(day_literal(AS_OF), 1)).select("page_id", "file_date", "expected_date", "valid", "message")


@query("""
SELECT o_orderkey AS k, o_totalprice::DECIMAL(18,3) AS v FROM orders UNION ALL SELECT l_orderkey, l_quantity::DECIMAL(18,3) FROM lineitem UNION ALL SELECT c_custkey, c_acctbal::DECIMAL(18,3) FROM customer
""")
def relaxed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of different types, cast to the declared type before they are united."""
    o, l, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    parts = [
        o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("decimal(20,2)").alias("v")),
        l.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("decimal(38,0)").alias("v")),
        c.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("string").alias("v")),
    ]
    return reduce(DataFrame.unionByName, (p.select("k", F.col("v").cast("decimal(18,3)").alias("v")) for p in parts))


_STATUS = """
SELECT d.day, coalesce(n, 0)::BIGINT AS rows, CASE WHEN d.day < DATE '2023-10-01' OR d.day >= DATE '2024-02-01' THEN 'skipped' WHEN n > 0 THEN 'ok' ELSE 'failed' END AS status
FROM (SELECT unnest(generate_series(DATE '2023-09-25', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS day) d
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) e ON e.day = d.day
"""


@query(_STATUS)
def period_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").alias("day"))
    return P.period_status(spark, e, "2023-09-25", "2024-02-03", AS_OF)


@query(f"SELECT count(*) AS total_days, count(*) FILTER (WHERE status = 'ok') AS ok_days, count(*) FILTER (WHERE status = 'failed') AS failed_days, count(*) FILTER (WHERE status = 'skipped') AS skipped_days FROM ({_STATUS})")
def period_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.period_summary(period_status(spark, sf_dir))


@query(f"""
WITH d AS ({_DATED}), e AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day),
n AS (SELECT * FROM ({_NAMES}) WHERE name LIKE 'meter_cis%' AND name LIKE '%.csv'),
m AS (SELECT day, day IN (SELECT file_date FROM d WHERE file_date IS NOT NULL AND page_id IN (SELECT page_id FROM n)) AS hit FROM e), s AS (SELECT avg(size_bytes) AS a, stddev_samp(size_bytes) AS sd, count(*) AS n FROM n),
o AS (SELECT count(*) AS k FROM n, s WHERE sd > 0 AND (size_bytes < greatest(0, a - 1.5 * sd) OR size_bytes > a + 1.5 * sd)),
x AS (SELECT count(*) AS t, count(*) FILTER (WHERE NOT (shaped AND file_date IS NOT NULL)) AS b FROM d)
SELECT 'file_naming' AS check, b = 0 AS passed, b || ' of ' || t || ' names are invalid' AS detail FROM x
UNION ALL SELECT 'period_coverage', bool_and(hit) OR NOT bool_or(hit), count(*) FILTER (WHERE hit) || ' of 31 days, missing: ' ||
  coalesce(array_to_string(list_slice(list(day::VARCHAR ORDER BY day) FILTER (WHERE NOT hit), 1, 5), ','), '') FROM m
UNION ALL SELECT 'file_sizes', k = 0, k || ' outliers among ' || n || ' files, mean ' || CASE WHEN round(a) < 1024 THEN CAST(round(a) AS BIGINT) || ' B' ELSE printf('%.1f KB', round(a) / 1024.0) END FROM o, s
UNION ALL SELECT 'ucs_file', date_diff('day', mx, DATE '2024-02-01') <= 3, 'newest ' || mx || ', ' || date_diff('day', mx, DATE '2024-02-01') || ' days old' FROM (SELECT max(CAST(ts AS DATE)) AS mx FROM events)
""")
def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"))
    return Q.integrity_report(_names(spark, sf_dir), e, AS_OF)


@query("SELECT c_custkey, upper(trim(c_mktsegment)) IN ('1', 'S', 'SIM', 'Y', 'YES', 'TRUE', 'T') OR c_custkey % 2 = 1 AS truthy FROM customer")
def truthy_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("c_custkey") % 2 == 1, F.lit(" sim ")).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", is_truthy(said).alias("truthy"))


@query("""
SELECT c_custkey, c_nationkey, n_regionkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_acctbal >= 0 AND upper(r_name) = 'EUROPE'
""")
def registry_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a balance as meters in place, nations as localities, regions as towns."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    removed = F.when(F.col("c_acctbal") < 0, day_literal("2024-01-01"))
    links = c.select(F.col("c_custkey").alias("cod_un_cons_reu"), removed.alias("dta_reti_reu"))
    units = c.select(F.col("c_custkey").alias("cod_un_cons_uee"), F.col("c_nationkey").alias("cod_loc_uee"))
    places = n.select(F.col("n_nationkey").alias("cod_loc_loc"), F.col("n_regionkey").alias("cod_mun_loc"))
    towns = r.select(F.col("r_regionkey").alias("cod_mun_mun"), F.col("r_name").alias("nom_mun_mun"))
    met = active_meters(links, units, places, towns, "europe")
    names = {"cod_un_cons_reu": "c_custkey", "cod_loc_uee": "c_nationkey", "cod_mun_loc": "n_regionkey", "nom_mun_mun": "r_name"}
    return met.withColumnsRenamed(names).select(*names.values())


@query("""
SELECT o_custkey AS uc, max(o_orderpriority) AS modalidade_geracao FROM orders
WHERE o_orderpriority <> '5-LOW' AND (o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice / 10 <= 25000
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1
""")
def registry_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as generators: priority as mode, status as situation, price as power."""
    g = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cod_un_cons_utg"),
        F.col("o_orderpriority").alias("cod_modl_dis_utg"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate")).alias("dta_fim_vign_utg"),
        F.when(F.col("o_orderstatus") == "F", "AT").when(F.col("o_orderstatus") != "P", "IN").alias("cod_situ_utg"),
        (F.col("o_totalprice") / 10).alias("qtd_pot_ger_utg"),
    )
    return own_generation(g, table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("uc")))


NETWORK_SQL = """
SELECT DISTINCT c_custkey AS "UC", CASE c_mktsegment WHEN 'BUILDING' THEN 'LG' ELSE 'CR' END AS "SITUACAO", 'P' || c_custkey % 9 AS "POSTO_OPERACIONAL",
  s_acctbal AS "POT_INST_KVA", n_name AS "GEDIS_ALIMENTADOR", CASE WHEN n_nationkey % 4 <> 1 THEN lower(n_name) END AS "ALIMENTADOR",
  CASE WHEN n_nationkey % 4 <> 1 THEN n_nationkey END AS "TENSAO_ALIMENTADOR", r_name AS "SUBESTACAO", left(r_name, 2) AS "SIGLA_SE", r_regionkey * 10 AS "TENSAO_SE",
  r_regionkey AS "CAR_SE", CASE WHEN r_name <> 'ASIA' THEN r_name END AS "MUNICIPIO_SE", CASE WHEN r_name <> 'ASIA' THEN r_regionkey END AS "COD_MUN_SE"
FROM customer JOIN supplier ON c_custkey % 9 = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey AND n_nationkey % 4 <> 1 WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 9 <> 3
"""


@query(NETWORK_SQL)
def network_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology(network(spark, sf_dir))


def network(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Customers as units, suppliers as transformers and their lines, nations as feeders, regions as substations and towns."""
    c, s, n, r = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region"))
    k, nk, rk = F.col("c_custkey"), F.col("n_nationkey"), F.col("r_regionkey")
    state = F.when(F.col("c_mktsegment") == "BUILDING", "LG").when(F.col("c_mktsegment") == "MACHINERY", "CR").otherwise("XX")
    post = F.concat(F.lit("P"), k % 9, F.when(k % 9 == 3, "PTMUN").otherwise(""))
    return {
        "UC_ENERGIA": c.select(k.alias("ISN_UC"), state.alias("TIPO_SIT_UC"), post.alias("NUMERO_POSTO_UC")),
        "POSTO_TRANSFORMADOR": s.select(F.concat(F.lit("P"), "s_suppkey").alias("NUM_OPER_POSTO"), F.col("s_acctbal").alias("POT_INST_POSTO"), F.col("s_suppkey").alias("NUM_GEO_TRECHO_PRIM_POSTO")),
        "TRECHO_PRIMARIO": s.select(F.col("s_suppkey").alias("NUM_SEQ_GEO"), F.col("s_nationkey").alias("NUM_GEO_ALIM_TRPRIM")),
        "ALIMENTADOR_GEO": n.select(nk.alias("NUM_SEQ_GEO"), F.col("n_name").alias("NUM_GEDIS_ALIMG"), nk.alias("NUM_ALIM_ALIMG")),
        "ALIMENTADOR": n.filter(nk % 4 != 1).select(F.col("n_name").alias("NUM_GEDIS_ALIM"), nk.alias("NUM_SEQ_ALIM"), F.lower("n_name").alias("NOME_ALIM"), nk.alias("TENSAO_OPER_ALIM"), F.col("n_regionkey").alias("NUM_SEQ_SE_ALIM")),
        "SUBESTACAO": r.select(rk.alias("NUM_SEQ_SE"), F.col("r_name").alias("NOME_SE"), F.substring("r_name", 1, 2).alias("SIGLA_SE"), (rk * 10).alias("TENSAO_NOM_SE"), rk.alias("CAR_SE"), rk.alias("COD_MUN_SE")),
        "MUNICIPIO": r.filter("r_name <> 'ASIA'").select(rk.alias("COD_MUN"), F.col("r_name").alias("NOME_MUN")),
    }


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and bytes of the given tables' files, from the file system alone; no SQL sees those."""
    return inventory(spark, f"{sf_dir}/*.parquet").select("name", "size_bytes")


QUERIES["file_inventory"] = file_inventory


def database(spark: SparkSession) -> tuple[str, dict[str, str]]:
    """Address and options of ``spark.meterlake.jdbc.url``; without it an in-memory database on a local master, on a cluster an error, as there each process would have one of its own."""
    url = spark.conf.get("spark.meterlake.jdbc.url", None)
    if not url and spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise RuntimeError("set spark.meterlake.jdbc.url to a database that driver and executors can reach")
    url = url or "jdbc:derby:memory:roundtrip;create=true"
    return url, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"} if ":derby:" in url else {}


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def jdbc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers into a database and back in ranges of the key.

    ``spark.meterlake.jdbc.url`` names the database; without it an in-memory one is used, which only a local master can share.
    """
    url, driver = database(spark)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    write_jdbc(c, url, "customer_copy", "overwrite", **driver)
    ends = c.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    return read_jdbc(spark, url, "customer_copy", "c_custkey", ends[0], ends[1] + 1, 4, **driver)


@query("""
SELECT o_orderkey, CASE WHEN month(o_orderdate) = 2 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, date_trunc('month', o_orderdate)::DATE AS report_day FROM orders
WHERE date_trunc('month', o_orderdate) BETWEEN DATE '1996-01-01' AND DATE '1996-12-01' AND (month(o_orderdate) <> 2 OR o_orderstatus = 'F')
""")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by month; the Februaries are written anew, then one year's partitions are read."""
    path = f"{job_dir(spark)}/orders-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.trunc("o_orderdate", "MM").alias("report_day"))
    write_dated(o, path, order=("o_orderkey",))
    again = o.filter((F.month("report_day") == 2) & (F.col("o_orderstatus") == "F")).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    write_dated(again, path)
    return read_days(spark, path, "1996-01-01", "1996-12-01").select("o_orderkey", "o_totalprice", "report_day")
