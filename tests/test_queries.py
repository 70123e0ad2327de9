"""Every registered reporting query against its SQL, at the smallest scale."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from meterlake.plans.flows import ORACLE_SQL, QUERIES
from meterlake.plans.queries import database

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{D}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    said = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return [names[i] for i in order], sorted(tuple(said(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, D)
    got = plain(df.collect(), df.columns)
    cursor = db.execute(ORACLE_SQL[name])
    assert got == plain(cursor.fetchall(), [c[0] for c in cursor.description])


def test_file_inventory_equals_the_file_system(spark):
    found = {r["name"]: r["size_bytes"] for r in QUERIES["file_inventory"](spark, D).collect()}
    files = [os.path.join(d, n) for d, _, names in os.walk(D) for n in names if n.endswith(".parquet")]
    assert found == {os.path.basename(f): os.path.getsize(f) for f in files}


def test_daily_series_needs_one_exchange(spark):
    plan = QUERIES["daily_series_json"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "event_id" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_key_list_goes_by_keys_whatever_the_names(spark, db, tmp_path):
    """Names that say nothing of the key, and keys that are zero, negative or null."""
    for t, key in (("customer", "c_custkey"), ("orders", "o_custkey")):
        found = spark.read.parquet(f"{D}/{t}.parquet").limit(150)
        found = found.withColumn(key, F.when(F.col(key) % 11 == 0, None).otherwise(F.col(key) % 40 - 9))
        found.write.parquet(str(tmp_path / f"{t}.parquet"))
    got = QUERIES["key_list_semi"](spark, str(tmp_path))
    sql = ORACLE_SQL["key_list_semi"].replace("orders", f"'{tmp_path}/orders.parquet/*.parquet'").replace("customer", f"'{tmp_path}/customer.parquet/*.parquet'")
    cursor = db.execute(sql)
    want = plain(cursor.fetchall(), [c[0] for c in cursor.description])
    assert plain(got.collect(), got.columns) == want and {r[0][:1] for r in want[1]} >= {"-", "0"}


def test_a_cluster_needs_a_database_that_all_can_reach():
    class Session:
        def __init__(self, **conf):
            self.conf = {f"spark.{k}": v for k, v in conf.items()}

    assert database(Session(master="local[4]"))[0].startswith("jdbc:derby:memory")
    with pytest.raises(RuntimeError, match="spark.meterlake.jdbc.url"):
        database(Session(master="local-cluster[3,2,3000]"))
    assert database(Session(master="yarn", **{"meterlake.jdbc.url": "jdbc:x://host/db"})) == ("jdbc:x://host/db", {})
