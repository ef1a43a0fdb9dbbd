"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from strophe.plans import catalogue

SMALL = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float) or hasattr(v, "quantize"):
        return None if math.isnan(v) else round(float(v), 8)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, database, name):
    found = catalogue.QUERIES[name](spark, str(SMALL))
    columns = sorted(found.columns)
    rows = [tuple(plain(x) for x in r) for r in found.select(*columns).collect()]
    result = database.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    wanted = [tuple(plain(r[i]) for i in at) for r in result.fetchall()]
    key = lambda r: tuple((x is None, str(x) if not isinstance(x, (int, float)) else "", x if isinstance(x, (int, float)) else 0) for x in r)
    assert sorted(rows, key=key) == sorted(wanted, key=key)


def test_queries_without_sql_give_rows(spark):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)):
        assert catalogue.QUERIES[name](spark, str(SMALL)).columns


def test_pairs_of_repeated_keys_come_once_and_are_not_kept(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE supplier AS SELECT CASE WHEN i % 11 <> 0 THEN i % 120 END AS s_suppkey, CAST(CASE WHEN i % 7 <> 0 THEN i % 3 END AS INTEGER) AS s_nationkey FROM range(300) r(i)")
    con.execute("CREATE TABLE customer AS SELECT CASE WHEN i % 13 <> 0 THEN i % 160 END AS c_custkey, CAST(CASE WHEN i % 5 <> 0 THEN i % 4 END AS INTEGER) AS c_nationkey FROM range(500) r(i)")
    for t in ("supplier", "customer"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    found = catalogue.QUERIES["matches_by_any_key"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(catalogue.ORACLE_SQL["matches_by_any_key"]).fetchall())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and plan.index("Union") < plan.index("Aggregate")  # aggregates are of keys, below the joins


def same_as_sql(spark, con, folder, name, *tables):
    for t in tables:
        con.execute(f"COPY {t} TO '{folder}/{t}.parquet'")
    found, wanted = catalogue.QUERIES[name](spark, str(folder)), con.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    return sorted(map(str, map(tuple, found.select(*names).collect()))) == sorted(map(str, wanted.fetchall())), found


def test_spans_without_a_user_have_no_tiles(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 41) MINUTE AS ts, CASE WHEN i % 9 <> 0 THEN i % 5 END AS user_id FROM range(400) r(i)")
    same, found = same_as_sql(spark, con, tmp_path, "interval_tiling", "events")
    assert same and found._jdf.queryExecution().executedPlan().toString().count("Join") == 0  # one window in place of the joins


def test_parts_and_orders_without_keys_equal_none(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE lineitem AS SELECT CASE WHEN i % 7 <> 0 THEN i % 20 END AS l_orderkey, CASE WHEN i % 5 <> 0 THEN i % 11 END AS l_partkey, CASE WHEN i % 13 <> 0 THEN TIMESTAMP '1996-06-01' + INTERVAL (i * 5) DAY END AS l_shipdate FROM range(300) r(i)")
    same, found = same_as_sql(spark, con, tmp_path, "release_diff", "lineitem")
    assert same and found._jdf.queryExecution().executedPlan().toString().count("Join") == 0
