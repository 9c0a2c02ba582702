"""Every query runs on the smallest tables; those with an oracle must give DuckDB's rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from silvaspark.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    plain = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([plain(v) for v in r]) for r in df.where(df.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    """The flagship joins on cells, not by nested loops, and reads only the columns it needs."""
    plan = catalogue.queries()["zonal_stats"](spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan.split("Physical Plan")[1].split("Subqueries")[0] and "CartesianProduct" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_whole_tables(spark, duck):
    """Loads give every row of their tables."""
    got = {n: catalogue.queries()[n](spark, SF).count() for n in ("vector_layer", "point_cloud", "register_all_bands")}
    want = {n: duck.execute(f"select {k} * count(*) from {t}").fetchone()[0] for n, t, k in (("vector_layer", "part", 1), ("point_cloud", "lineitem", 1), ("register_all_bands", "events", 3))}
    assert got == want


def test_all_candidates_are_ranked(spark, duck):
    """Every pixel of the production height has a rank, from 0 without a gap."""
    ranks = sorted(r["rank"] for r in catalogue.queries()["candidates_ranked"](spark, SF).collect())
    assert ranks == list(range(duck.execute("select count(*) from orders where o_totalprice >= 2").fetchone()[0]))


def test_every_tree_is_projected(spark, tmp_path):
    """Keys beyond those of the given tables are kept too, at a finite place."""
    spark.range(0, 1500000, 100000).selectExpr("id + 49 as c_custkey", "'A' as c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalogue.queries()["to_crs_3857_all"](spark, str(tmp_path)).collect()
    assert len(got) == 15 and all(math.isfinite(r.y) and abs(r.y) < 2.0037e7 for r in got)
