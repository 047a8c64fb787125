"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import datetime
import os
import re

import duckdb
import pytest

from tapeweave.jobs import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return names, sorted(repr(tuple(tidy(v) for v in row)) for row in zip(*cols, strict=True))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    ours = rows(registry.queries()[name](spark, SF).toArrow())
    theirs = rows(duck.sql(registry.oracle_sql()[name]).to_arrow_table())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).columns


def test_portfolio_summary_without_trades(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    ticks = [(i, start + datetime.timedelta(minutes=20 * i), 1, "view", 5.0 + i % 2, "{}") for i in range(600)]
    spark.createDataFrame(ticks, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    ours = rows(registry.queries()["a13_portfolio_summary"](spark, str(tmp_path)).toArrow())
    assert ours == rows(con.sql(registry.oracle_sql()["a13_portfolio_summary"]).to_arrow_table())
    assert len(ours[1]) == 1


def test_leg_pairing_numbers_within_days(spark, tmp_path):
    start = datetime.datetime(1995, 1, 2)
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    items = [(i * 7 % 400, i, i % 9, i % 4, 1.0 + i % 5, 1000.0 + i, i % 11 / 100, (None, "A", "N", "R", "")[i % 5], "FO"[i // 3 % 2], None if i % 13 == 0 else start + datetime.timedelta(days=i * i % 17)) for i in range(400)]
    spark.createDataFrame(items, kinds).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = registry.queries()["j10_leg_pairing"](spark, str(tmp_path))
    assert rows(found.toArrow()) == rows(con.sql(registry.oracle_sql()["j10_leg_pairing"]).to_arrow_table())
    # no task numbers a whole leg
    cuts = re.findall(r"Window \[row_number\(\).*?\], \[(.*?)\],", found._jdf.queryExecution().optimizedPlan().toString())
    assert cuts and all("_day" in c for c in cuts)
