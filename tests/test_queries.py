"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pandas as pd
import pytest

from lamina import container_queries, queries

ORACLE_SQL, QUERIES = queries.ORACLE_SQL | container_queries.ORACLE_SQL, queries.QUERIES | container_queries.QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    a, b = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: [tuple(None if pd.isna(v) else float(v) if not isinstance(v, str) else v for v in r) for r in d[sorted(d.columns)].itertuples(index=False)]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(rows(a), key=key) == sorted(rows(b), key=key)


def most_rows(spark, df):
    """The largest number of rows that a step of the plan made."""
    store = spark._jsparkSession.sharedState().statusStore()
    df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    at = store.executionsList().last().executionId()
    values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
    found = [m for i in range(nodes.size()) for j in range(nodes.apply(i).metrics().size()) if (m := nodes.apply(i).metrics().apply(j)).name() == "number of output rows"]
    return max(int(values.apply(m.accumulatorId()).replace(",", "")) for m in found if values.contains(m.accumulatorId()))


@pytest.mark.parametrize("name, rows", [("nearest_quadrant", 12_000), ("gain_merge", 18_000)])
def test_places_meet_once(spark, tmp_path, name, rows):
    """3,000 customers and 2,000 suppliers of a nation lie at 100 places each: 10,000 pairs, not 6,000,000."""
    spark.range(3000).selectExpr("id as c_custkey", "3 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(2000).selectExpr("id as s_suppkey", "3 as s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    assert most_rows(spark, QUERIES[name](spark, str(tmp_path))) <= rows


def test_lut_rounds_as_sql(spark, tmp_path):
    """Prices whose value lies less than a millionth under a half: rounded to six places first, and then up."""
    prices = [7922.37, 11685.83, 13671.17, 21031.73, 22589.41, 33083.29, 45229.23, 45827.60]
    spark.createDataFrame([(i, 1, 1, 1, p) for i, p in enumerate(prices)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["l_orderkey"]: r["out"] for r in QUERIES["srgb_lut"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = {k: v for k, v in con.execute(f"select l_orderkey, out from ({ORACLE_SQL['srgb_lut']})").fetchall()}
    assert got == want and [got[i] for i in range(8)] == [298, 360, 388, 475, 491, 585, 674, 678]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
