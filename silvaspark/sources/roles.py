"""The driver's tables in the roles of rasters, crowns, tree points and point clouds (FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEIGHT_COLUMNS, SPECTRAL_COLUMNS = 100, 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-band raster ``row, col, v`` of 100 columns."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.expr("cast(o_orderkey div 100 as int)").alias("row"), (k % HEIGHT_COLUMNS).cast("int").alias("col"), F.col("o_totalprice").alias("v"))


def spectral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-band raster ``row, col, bands`` of 25 columns."""
    bands = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id div 25 as int)").alias("row"), (F.col("vec_id") % SPECTRAL_COLUMNS).cast("int").alias("col"), bands.alias("bands"), "label")


def crowns(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """Crown boxes ``crown_id, species, minx, miny, maxx, maxy``; ``second`` gives another delineation of the same trees."""
    shift = (F.col("p_partkey") % 3) / F.lit(10.0) if second else F.lit(0.0)
    half = (F.col("p_size") + (1 if second else 0)) / F.lit(10.0)
    cx, cy = (F.col("p_partkey") % 50) * F.lit(2.0) + shift, F.expr("p_partkey div 50") * F.lit(3.0) + shift
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("crown_id"), F.col("p_brand").alias("species"), (cx - half).alias("minx"), (cy - half).alias("miny"), (cx + half).alias("maxx"), (cy + half).alias("maxy"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree points ``tree_id, species, x, y``."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("tree_id"), F.col("c_mktsegment").alias("species"), ((F.col("c_custkey") % 50) * F.lit(2.0)).alias("x"), (F.expr("c_custkey div 50") * F.lit(3.0)).alias("y"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point cloud ``x, y, z, classification, return_number``; class 2 is ground."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("double").alias("x"), F.col("l_suppkey").cast("double").alias("y"), F.col("l_extendedprice").alias("z"), F.when(F.col("l_returnflag") == "A", 2).otherwise(5).cast("short").alias("classification"), F.col("l_linenumber").cast("short").alias("return_number"))


#: The same roles in DuckDB, to stand in front of an oracle query.
HEIGHTS = "h as (select cast(o_orderkey // 100 as int) as r, cast(o_orderkey % 100 as int) as c, o_totalprice as v from orders)"
SPECTRAL = "e as (select cast(vec_id // 25 as int) as r, cast(vec_id % 25 as int) as c, [cast(x as double) for x in embedding] as b, label from embeddings)"
CROWNS = """k as (select p_partkey as id, p_brand as species, cx - h as minx, cy - h as miny, cx + h as maxx, cy + h as maxy from (select *,
    cast(p_partkey % 50 as double) * 2 as cx, cast(p_partkey // 50 as double) * 3 as cy, cast(p_size as double) / 10 as h from part))"""
CROWNS2 = """k2 as (select p_partkey as id, p_brand as species, cx - h as minx, cy - h as miny, cx + h as maxx, cy + h as maxy from (select *,
    cast(p_partkey % 50 as double) * 2 + cast(p_partkey % 3 as double) / 10 as cx,
    cast(p_partkey // 50 as double) * 3 + cast(p_partkey % 3 as double) / 10 as cy, cast(p_size + 1 as double) / 10 as h from part))"""
TREES = "t as (select cast(c_custkey as varchar) as tree_id, c_mktsegment as species, cast(c_custkey % 50 as double) * 2 as x, cast(c_custkey // 50 as double) * 3 as y from customer)"
POINTS = """p as (select cast(l_partkey as double) as x, cast(l_suppkey as double) as y, l_extendedprice as z,
    case when l_returnflag = 'A' then 2 else 5 end as cls, l_linenumber as rn from lineitem)"""
