"""Queries of point clouds on the driver's tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from silvaspark.operators import points as pc
from silvaspark.operators import surface, tiles
from silvaspark.operators.raster import Affine
from silvaspark.plans.catalogue import query
from silvaspark.sources.roles import CROWNS, HEIGHTS, POINTS, crowns, heights, points

SIZE = 5.0
_CELL = """b as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from p),
    g as (select p.*, cast(trunc((x - x0) / 5.0) as int) as c, cast(trunc((y1 - y) / 5.0) as int) as r, cast(trunc((x1 - x0) / 5.0) as int) as w, cast(trunc((y1 - y0) / 5.0) as int) as h from p, b),
    q as (select * from g where r >= 0 and r < h and c >= 0 and c < w)"""


def _grid(agg: str) -> str:
    return f"with {POINTS}, {_CELL} select r as row, c as col, {agg} as v from q group by r, c"


@query(_grid("max(z)"))
def points_grid_max(spark, d):
    p = points(spark, d)
    return pc.points_to_grid(p, pc.extent(p), SIZE, "max")


@query(_grid("min(z)"))
def points_grid_min(spark, d):
    p = points(spark, d)
    return pc.points_to_grid(p, pc.extent(p), SIZE, "min")


@query(_grid("count(*)"))
def points_grid_count(spark, d):
    p = points(spark, d)
    return pc.points_to_grid(p, pc.extent(p), SIZE, "count")


@query(f"""with {POINTS}, {_CELL}, n as (select max(w) as w, max(h) as h from g), e as (select cast(i as int) as row, cast(j as int) as col from n, range(0, 100000) a(i), range(0, 100000) b2(j) where i < n.h and j < n.w),
    m as (select r, c, max(z) as v from q group by r, c) select row, col, coalesce(v, -9999.0) as v from e left join m on r = row and c = col""")
def points_grid_dense(spark, d):
    p = points(spark, d)
    box = pc.extent(p)
    w, h = int((box["max_x"] - box["min_x"]) / SIZE), int((box["max_y"] - box["min_y"]) / SIZE)
    return pc.dense(pc.points_to_grid(p, box, SIZE), w, h, pc.NODATA)


_SURFACE = f"with {POINTS}, {_CELL}, s as (select r, c, max(z) as dsm, min(z) filter (where cls = 2) as dtm from q group by r, c)"


@query(f"{_SURFACE} select r as row, c as col, dsm, dtm from s")
def dsm_dtm(spark, d):
    p = points(spark, d)
    return pc.surfaces(p, pc.extent(p), SIZE)


@query(f"{_SURFACE} select r as row, c as col, dsm as v from s")
def dsm(spark, d):
    p = points(spark, d)
    return pc.surfaces(p, pc.extent(p), SIZE).select("row", "col", F.col("dsm").alias("v"))


@query(f"{_SURFACE} select r as row, c as col, dtm as v from s where dtm is not null")
def dtm(spark, d):
    p = points(spark, d)
    return pc.surfaces(p, pc.extent(p), SIZE).where("dtm is not null").select("row", "col", F.col("dtm").alias("v"))


@query(f"{_SURFACE} select r as row, c as col, greatest(dsm - dtm, 0.0) as v from s where dtm is not null")
def chm(spark, d):
    p = points(spark, d)
    return pc.chm(pc.surfaces(p, pc.extent(p), SIZE))


@query(f"with {POINTS} select bool_or(cls = 2) as classified from p")
def is_classified(spark, d):
    return pc.is_classified(points(spark, d))


@query(f"with {POINTS}, b as (select min(x) as x0, min(y) as y0 from p) select cast(trunc((y - y0) / 1.5) as int) as row, cast(trunc((x - x0) / 1.5) as int) as col, max(-z) as v from p, b group by 1, 2")
def csf_grid(spark, d):
    p = points(spark, d)
    return pc.cloth_grid(p, pc.extent(p), 1.5)


@query()
def csf_ground(spark, d):
    """Ground points of the cloud by the cloth filter, heights scaled to metres."""
    return pc.ground_points(points(spark, d).withColumn("z", F.col("z") / 1000.0), pc.TerrainType.FLAT.value).select("x", "y", "z", "is_ground")


@query(f"with {POINTS} select x, y, z, cls as classification, rn as return_number from p where z > 50000 and rn = 1")
def point_scan(spark, d):
    return points(spark, d).where("z > 50000 and return_number = 1")


@query(f"with {POINTS} select x, y, z, cls as classification, rn as return_number from p")
def point_cloud(spark, d):
    """The whole cloud, as a load gives it."""
    return points(spark, d)


@query(f"with {HEIGHTS} select r as row, c as col, (c + 0.5) * 0.5 + 1000.0 as x, (r + 0.5) * -0.5 + 2000.0 as y from h")
def pixel_to_xy(spark, d):
    x, y = Affine(0.5, 1000.0, -0.5, 2000.0).center(F.col("row"), F.col("col"))
    return heights(spark, d).select("row", "col", x.alias("x"), y.alias("y"))


@query(f"""with {CROWNS} select id as tree_id, cast(floor((miny + maxy) / 2) as int) as row, cast(floor((minx + maxx) / 2) as int) as col from k
    where floor((minx + maxx) / 2) between 8 and 71 and floor((miny + maxy) / 2) between 4 and 35""")
def seed_pixels(spark, d):
    c = crowns(spark, d)
    row, col = Affine(1.0, 0.0, 1.0, 0.0).cell((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2)
    return c.select(F.col("crown_id").alias("tree_id"), row.alias("row"), col.alias("col")).where("col between 8 and 71 and row between 4 and 35")


@query(f"""with {CROWNS}, {HEIGHTS}, t as (select distinct r // 32 as tile_r, c // 32 as tile_c from h), n as (select max(r) as mr, max(c) as mc from h),
    s as (select id, cast(floor((miny + maxy) / 2) as int) as r, cast(floor((minx + maxx) / 2) as int) as c from k)
    select id as tree_id, tile_r, tile_c, r as row, c as col, r - greatest(tile_r * 32 - 8, 0) as local_row, c - greatest(tile_c * 32 - 8, 0) as local_col, r // 32 = tile_r and c // 32 = tile_c as is_core
    from s, t, n where r between 0 and mr and c between 0 and mc and r >= tile_r * 32 - 8 and r < tile_r * 32 + 40 and c >= tile_c * 32 - 8 and c < tile_c * 32 + 40""")
def seed_pixels_tiles(spark, d):
    """All crowns' seeds, in every tile of the height raster whose halo box holds them."""
    c = crowns(spark, d)
    tops = c.select(F.col("crown_id").alias("tree_id"), ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    return tiles.seed_tiles(tops, heights(spark, d), Affine(1.0, 0.0, 1.0, 0.0), 32, 8)


@query(f"with {POINTS} select cast(rn as int) as return_number, count(*) as n, max(z) as top from p group by 1")
def sink_roundtrip(spark, d):
    """Points written as Parquet by return number and read back."""
    import uuid

    from silvaspark.sources.io import write_pixels

    tiles.kept(spark.range(0))  # makes the shared folder where the session names none
    path = f"{spark.sparkContext.getCheckpointDir()}/points-{uuid.uuid4().hex}"
    write_pixels(points(spark, d), path, "return_number")
    back = spark.read.parquet(path)
    return back.groupBy(F.col("return_number").cast("int").alias("return_number")).agg(F.count(F.lit(1)).alias("n"), F.max("z").alias("top"))


def _cloud(spark, d):
    """The cloud five times as long in y: its smallest is only nine units wide, and a footprint's frame takes four cells."""
    return points(spark, d).withColumn("y", F.col("y") * 5)


@query()
def generate_dtm(spark, d):
    """Terrain model of the cloud, gaps filled."""
    return surface.generate_dtm(_cloud(spark, d), SIZE)


@query()
def generate_dsm(spark, d):
    """Surface model of the cloud within its closed footprint, gaps filled."""
    return surface.generate_dsm(_cloud(spark, d), SIZE)


@query()
def generate_chm(spark, d):
    """Canopy height model of the cloud: filled, smoothed, within the footprint."""
    return surface.generate_chm(_cloud(spark, d), SIZE)
