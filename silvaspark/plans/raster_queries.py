"""Queries of rasters and zones on the driver's tables, with their oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from silvaspark.functions import scalar
from silvaspark.operators import focal, raster, tiles, vector, warp, zonal
from silvaspark.plans.catalogue import query
from silvaspark.sources.roles import CROWNS, HEIGHTS, SPECTRAL, crowns, heights, spectral, table

THRESHOLD = 1000.0


def _axis(lo: str, hi: str, n: str, p: str) -> str:
    return f"""cast(greatest(floor({lo}), 0) as int) as {p}f, cast(least(floor({lo}) + ceil({hi} - {lo}), {n}) - 1 as int) as {p}l,
        cast(greatest(greatest(floor({lo}), 0), floor({lo} - 0.5) + 1) as int) as {p}i0,
        cast(least(least(floor({lo}) + ceil({hi} - {lo}), {n}) - 1, ceil({hi} - 0.5) - 1) as int) as {p}i1,
        cast(least(least(floor({lo}) + ceil({hi} - {lo}), {n}) - 1, ceil({hi}) - 1) as int) as {p}o1"""


def _zones(width: int, pixels: str) -> str:
    """CTEs ``w`` and ``z``: windows of the crowns and their pixel ranges c0..c1, r0..r1."""
    return f"""w as (select id, species, {_axis('minx', 'maxx', str(width), 'c')}, {_axis('miny', 'maxy', f'(select max(r) + 1 from {pixels})', 'r')} from k),
    z as (select id, species, case when t then cf else ci0 end as c0, case when t then co1 else ci1 end as c1,
        case when t then rf else ri0 end as r0, case when t then ro1 else ri1 end as r1
        from (select *, cl - cf < 2 or rl - rf < 2 or ci1 < ci0 or ri1 < ri0 as t from w where cf <= cl and rf <= rl))"""


def _height(df):
    return df.agg((F.max("row") + 1).alias("n")).scalar()


@query(f"""with {HEIGHTS}, {CROWNS}, {_zones(100, 'h')},
    j as (select id, species, v, cast(v as decimal(18,2)) as d from h join z on r between r0 and r1 and c between c0 and c1 where v > {THRESHOLD}),
    g as (select id, species, count(*) as n, median(v) as med, min(v) as mn, max(v) as mx, cast(sum(d) as double) as s1, cast(sum(d * d) as double) as s2 from j group by id, species)
    select id as crown_id, species, 'memory_raster' as raster_source, 1 as band, n, med, s1 / n as mean,
    sqrt(greatest(cast(n as double) * s2 - s1 * s1, 0)) / n as sd, mn as "min", mx as "max" from g""")
def zonal_stats(spark, d):
    """The flagship: statistics of the height raster per crown box."""
    h = heights(spark, d)
    return zonal.zonal_statistics(h.select("row", "col", F.array("v").alias("bands")), crowns(spark, d), 100, _height(h), THRESHOLD, scale=2)


@query(f"""with {HEIGHTS}, {CROWNS}, {_zones(100, 'h')}
    select id as crown_id, 1 as band, string_agg(cast(cast(v as decimal(18,2)) as varchar), ',' order by r, c) as "values"
    from h join z on r between r0 and r1 and c between c0 and c1 where v > {THRESHOLD} group by id""")
def zonal_raw(spark, d):
    h = heights(spark, d)
    raw = zonal.zonal_raw(h.select("row", "col", F.array("v").alias("bands")), crowns(spark, d), 100, _height(h), THRESHOLD)
    return raw.withColumn("values", F.array_join(F.transform("values", lambda v: v.cast("decimal(18,2)").cast("string")), ","))


_WIDE = ", ".join(f"median(b[{i}]) as {n}_med, round(avg(b[{i}]), 6) as {n}_mean, round(stddev_pop(b[{i}]), 6) as {n}_sd, min(b[{i}]) as {n}_min, max(b[{i}]) as {n}_max" for n, i in (("red", 3), ("nir", 40)))


@query(f"""with {SPECTRAL}, {CROWNS}, {_zones(25, 'e')}
    select id as crown_id, species, {_WIDE} from e join z on r between r0 and r1 and c between c0 and c1 group by id, species""")
def zonal_wide(spark, d):
    e = spectral(spark, d)
    out = zonal.zonal_wide(e, crowns(spark, d), 25, _height(e), {"red": 3, "nir": 40}, None)
    return out.select(*(F.round(c, 6).alias(c) if c.endswith(("_mean", "_sd")) else F.col(c) for c in out.columns))


@query(f"with {SPECTRAL} select r - 3 as row, c - 5 as col, b[1] as b1, b[7] as b7 from e where r between 3 and 12 and c between 5 and 14")
def raster_scan(spark, d):
    out = raster.scan(spectral(spark, d), [1, 7], (3, 5, 10, 10))
    return out.select("row", "col", F.get("bands", 0).alias("b1"), F.get("bands", 1).alias("b7"))


@query(f"with {SPECTRAL} select r as row, c as col, b[5] as v from e")
def get_band(spark, d):
    return raster.get_band(spectral(spark, d), "B5", {f"B{i}": i for i in range(1, 65)}, 64)


def _described(spark):
    i = F.col("id").cast("int")
    name = F.when(i % 7 == 3, F.lit(None)).when(i % 5 == 2, F.concat(F.lit("Infrared "), (400 + 10 * i).cast("string"), F.lit("Nanometers"))).when(i % 11 == 5, F.lit("panchromatic")).otherwise(F.concat(F.lit("B"), i.cast("string"), F.lit(" "), (400 + 10 * i).cast("string"), F.lit(" nm")))
    return spark.range(1, 65).select(i.alias("band"), name.cast("string").alias("description"))


_DESCRIBED = """d as (select cast(i as int) as band, case when i % 7 = 3 then null when i % 5 = 2 then 'Infrared ' || (400 + 10 * i) || 'Nanometers'
    when i % 11 = 5 then 'panchromatic' else 'B' || i || ' ' || (400 + 10 * i) || ' nm' end as description from range(1, 65) t(i))"""
_WAVE = "coalesce(try_cast(nullif(regexp_extract({0}, '(?i)(\\d+(?:\\.\\d+)?)\\s*(?:nm|nanometers?)\\b', 1), '') as double), -1.0)"


@query(f"with {_DESCRIBED} select band, coalesce(description, 'Band_' || band) as name, cast({_WAVE.format('description')} as double) as wavelength from d")
def band_metadata(spark, d):
    return _described(spark).select("band", scalar.band_names(F.col("description"), F.col("band")).alias("name"), scalar.wavelength(F.coalesce("description", F.lit(""))).alias("wavelength"))


@query(f"select p_partkey as id, cast({_WAVE.format('name')} as double) as wavelength from (select p_partkey, p_name || ' ' || p_size || case p_partkey % 4 when 0 then 'nm' when 1 then ' NM' when 2 then ' nanometer' else ' um' end as name from part)")
def wavelength_parse(spark, d):
    k = F.col("p_partkey")
    unit = F.when(k % 4 == 0, "nm").when(k % 4 == 1, " NM").when(k % 4 == 2, " nanometer").otherwise(" um")
    return table(spark, d, "part").select(k.alias("id"), scalar.wavelength(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), unit)).alias("wavelength"))


@query("""with b as (select cast(i as int) as band, 400.0::double + 10 * i as w from range(1, 65) t(i)), v as (select * from (values ('nir', 850.0::double), ('red', 655.0::double), ('blue', 447.0::double), ('swir', 1600.0::double)) t(variable, target))
    select variable, case when min(abs(w - target)) <= 20 then arg_min(band, (abs(w - target), band)) end as band, min(abs(w - target)) as distance from v, b group by variable""")
def map_wavelengths(spark, d):
    bands = spark.range(1, 65).select(F.col("id").cast("int").alias("band"), (F.lit(400.0) + 10 * F.col("id")).alias("wavelength"))
    wanted = spark.createDataFrame([("nir", 850.0), ("red", 655.0), ("blue", 447.0), ("swir", 1600.0)], "variable string, target double")
    return scalar.map_wavelengths(bands, wanted)


@query(f"with {SPECTRAL} select r as row, c as col, round((b[45] - b[25]) / nullif(b[45] + b[25], 0), 9) as v from e")
def spectral_index(spark, d):
    formula, waves = scalar.get_index("NDVI")
    bands = {name: int((w - 400) / 10) for name, w in waves.items()}
    return raster.spectral_index(spectral(spark, d), formula, bands).withColumn("v", F.round("v", 9))


@query(f"with {SPECTRAL} select cast(i as int) as band, r as row, c as col, b[i] as v from e, range(1, 65) t(i)")
def split_bands(spark, d):
    return raster.split_bands(spectral(spark, d))


@query(f"with {SPECTRAL}, {HEIGHTS} select e.r as row, e.c as col, b[1] as b1, b[64] as b64, v as b65, cast(len(b) + 1 as int) as n from e join h on e.r = h.r and e.c = h.c")
def stack_bands(spark, d):
    out = raster.stack_bands(spectral(spark, d), heights(spark, d).select("row", "col", F.array("v").alias("bands")))
    return out.select("row", "col", F.get("bands", 0).alias("b1"), F.get("bands", 63).alias("b64"), F.get("bands", 64).alias("b65"), F.size("bands").alias("n"))


@query(f"with {HEIGHTS} select r - 2 as row, c - 11 as col, v from h where r between 2 and 9 and c between 11 and 40")
def crop(spark, d):
    return raster.crop(heights(spark, d), raster.Affine(1.0, 0.0, 1.0, 0.0), (10.6, 2.2, 40.2, 9.4), 100, 10**6)


@query(f"with {HEIGHTS} select r // 32 as tile_r, c // 32 as tile_c, count(*) as n, min(r) as row0, max(r) as row1, min(c) as col0, max(c) as col1, max(v) as top from h group by 1, 2")
def iter_tiles(spark, d):
    return tiles.tile_of(heights(spark, d), 32).groupBy("tile_r", "tile_c").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"), F.max("v").alias("top"))


@query(f"""with {HEIGHTS}, tr as (select distinct cast(i as int) as tile_r from range(0, 100000) t(i) where i * 24 <= (select max(r) from h)), tc as (select cast(i as int) as tile_c from range(0, 5) t(i) where i * 24 <= 99)
    select tile_r, tile_c, count(*) as n, max(v) as top from h, tr, tc where r >= tile_r * 24 and r < tile_r * 24 + 32 and c >= tile_c * 24 and c < tile_c * 24 + 32 group by 1, 2""")
def iter_tiles_overlap(spark, d):
    return tiles.overlapping_tiles(heights(spark, d), 32, 8).groupBy("tile_r", "tile_c").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))


@query(f"""with {HEIGHTS}, t as (select distinct r // 32 as tile_r, c // 32 as tile_c from h)
    select tile_r, tile_c, count(*) as n, count(*) filter (where r // 32 = tile_r and c // 32 = tile_c) as core, max(v) as top from h, t
    where r >= tile_r * 32 - 4 and r < tile_r * 32 + 36 and c >= tile_c * 32 - 4 and c < tile_c * 32 + 36 group by 1, 2""")
def core_halo(spark, d):
    halo = tiles.in_raster(tiles.core_halo(heights(spark, d), 32, 4), 32)
    return halo.groupBy("tile_r", "tile_c").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_core").alias("core"), F.max("v").alias("top"))


@query(f"with {HEIGHTS} select r as row, c as col, v as a, v * 2 as b, v + v * 2 as total from h")
def multi_raster_zip(spark, d):
    h = heights(spark, d)
    return raster.zip_rasters({"a": h, "b": h.withColumn("v", F.col("v") * 2)}).withColumn("total", F.col("a") + F.col("b"))


@query(f"with {HEIGHTS} select r as row, c as col, case when r between 3 and 7 and c between 10 and 19 then -1.0 else v end as v from h")
def window_patch(spark, d):
    h = heights(spark, d)
    return tiles.window_patch(h, h.where("row between 3 and 7 and col between 10 and 19").withColumn("v", F.lit(-1.0)))


@query(f"""with {HEIGHTS} select r as row, c as col, v + 100 * greatest(0, floor(r / 24.0)) + greatest(0, floor(c / 24.0)) as v from h""")
def tile_stitch(spark, d):
    t = tiles.overlapping_tiles(heights(spark, d), 32, 8)
    return tiles.stitch(t.withColumn("seq", F.struct("tile_r", "tile_c")).withColumn("v", F.col("v") + 100 * F.col("tile_r") + F.col("tile_c")))


@query(f"with {HEIGHTS} select r as row, c as col, v, r // 16 as tile_r, c // 16 as tile_c from h")
def retile(spark, d):
    return tiles.retile(heights(spark, d), 16).select("row", "col", "v", "tile_r", "tile_c")


@query(f"""with {HEIGHTS}, n as (select cast(floor((max(r) + 1) * 0.4) as int) as nr, 40 as nc from h), g as (select cast(i as int) as row, cast(j as int) as col from n, range(0, 10000) a(i), range(0, 40) b(j) where i < nr)
    select row, col, v from g join h on r = cast(floor((row + 0.5) / 0.4) as int) and c = cast(floor((col + 0.5) / 0.4) as int)""")
def resample_nearest(spark, d):
    h = heights(spark, d)
    return raster.resample_nearest(h, 0.4, 100, h.agg(F.max("row")).first()[0] + 1)


@query(f"""with {HEIGHTS}, n as (select max(r) + 1 as hh from h), g as (select cast(i as int) as row, cast(j as int) as col, (i + 0.5) / 2 - 0.5 as y, (j + 0.5) / 2 - 0.5 as x from n, range(0, 20000) a(i), range(0, 200) b(j) where i < 2 * hh)
    select row, col, round(sum(v * (1 - abs(y - r)) * (1 - abs(x - c))) / sum((1 - abs(y - r)) * (1 - abs(x - c))), 7) as v
    from g join h on r in (cast(floor(y) as int), cast(floor(y) as int) + 1) and c in (cast(floor(x) as int), cast(floor(x) as int) + 1) where abs(y - r) < 1 and abs(x - c) < 1 group by row, col""")
def resample_bilinear(spark, d):
    h = heights(spark, d)
    return raster.resample_bilinear(h, 2.0, 100, h.agg(F.max("row")).first()[0] + 1).withColumn("v", F.round("v", 7))


@query(f"with {HEIGHTS}, {SPECTRAL} select e.r as row, e.c as col, h.v from e left join h on h.r = cast(floor((e.r + 0.5) * 0.5 + 0.25) as int) and h.c = cast(floor((e.c + 0.5) * 2.0 + 1.0) as int)")
def align_nearest(spark, d):
    return raster.align(heights(spark, d), raster.Affine(1.0, 0.0, 1.0, 0.0), spectral(spark, d), raster.Affine(2.0, 1.0, 0.5, 0.25))


@query(f"""with {HEIGHTS}, n as (select max(r) + 1 as hh, radians(0.01::double) * 6378137.0::double as side from h),
    p as (select r as row, c as col, hh, degrees((c + 0.5::double) * side / 6378137.0::double) as lon, degrees(2 * atan(exp((side * hh - (r + 0.5::double) * side) / 6378137.0::double)) - pi() / 2) as lat from h, n)
    select row, col, v from p left join h on h.r = cast(floor((lat - 0.01::double * hh) / -0.01::double) as int) and h.c = cast(floor(lon / 0.01::double) as int)""")
def reproject_nearest(spark, d):
    """The height raster in degrees (0.01 per pixel) on a web-mercator grid of the same size, nearest neighbour."""
    h = heights(spark, d)
    n = h.agg(F.max("row")).first()[0] + 1
    side = math.radians(0.01) * 6378137.0
    grid = h.select("row", "col")
    x, y = raster.Affine(side, 0.0, -side, side * n).center(F.col("row"), F.col("col"))
    lon, lat = F.degrees(x / 6378137.0), F.degrees(2 * F.atan(F.exp(y / 6378137.0)) - math.pi / 2)
    r, c = raster.Affine(0.01, 0.0, -0.01, 0.01 * n).cell(lon, lat)
    source = h.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "v")
    return grid.select("row", "col", r.alias("__r"), c.alias("__c")).join(source, ["__r", "__c"], "left").select("row", "col", "v")


@query(f"with {HEIGHTS} select c as col, r as row, v as height from (select *, max(m) over (partition by c order by r range between 2 preceding and 2 following) as mm from (select *, max(v) over (partition by r order by c range between 2 preceding and 2 following) as m from h)) where v = mm and v >= 2")
def treetops_lmf(spark, d):
    return focal.treetops_lmf(heights(spark, d))


@query(f"with {HEIGHTS} select r as row, c as col, v, row_number() over (order by v desc, r desc, c desc) - 1 as rank from h where v >= 400000")
def candidates_sorted(spark, d):
    from silvaspark.operators.vector import numbered

    tall = heights(spark, d).where("v >= 400000").select("row", "col", "v", (-F.col("v")).alias("a"), (-F.col("row")).alias("b"), (-F.col("col")).alias("c"))
    return numbered(tall, ["a", "b", "c"]).select("row", "col", "v", F.col("__n").alias("rank"))


@query(f"with {HEIGHTS} select r as row, c as col, v, row_number() over (order by v desc, r desc, c desc) - 1 as rank from h where v >= 2")
def candidates_ranked(spark, d):
    """All candidates of a detection, from the height on that ``treetops_lmf`` takes."""
    from silvaspark.operators.vector import numbered

    tall = heights(spark, d).where("v >= 2").select("row", "col", "v", (-F.col("v")).alias("a"), (-F.col("row")).alias("b"), (-F.col("col")).alias("c"))
    return numbered(tall, ["a", "b", "c"]).select("row", "col", "v", F.col("__n").alias("rank"))


def _pass(source: str, f: str) -> str:
    return f"(select r, c, {f}(m) over (partition by c order by r range between 1 preceding and 1 following) as v from (select r, c, {f}(v) over (partition by r order by c range between 1 preceding and 1 following) as m from {source}))"


@query(f"with {HEIGHTS} select r as row, c as col, v from {_pass(_pass('h', 'max'), 'min')}")
def grey_closing(spark, d):
    return focal.grey_closing(heights(spark, d))


@query(f"""with {HEIGHTS}, n as (select max(r) as m from h), o as (select cast(i as int) - 1 as dr, cast(j as int) - 1 as dc from range(0, 3) a(i), range(0, 3) b(j))
    select t.r as row, t.c as col, median(s.v) as v from h t, n, o, h s where s.r = least(greatest(t.r + dr, 0), m) and s.c = least(greatest(t.c + dc, 0), 99) group by t.r, t.c""")
def chm_median(spark, d):
    h = heights(spark, d)
    return focal.median(h, 100, h.agg(F.max("row")).first()[0] + 1)


@query("""with o as (select cast(i as int) - 10 as dy, cast(j as int) - 10 as dx from range(0, 21) a(i), range(0, 21) b(j))
    select dy, dx, dy * dy + dx * dx as d2, dense_rank() over (order by dy * dy + dx * dx) as ring from o where dy * dy + dx * dx between 1 and 100""")
def expansion_rings(spark, d):
    from pyspark.sql import Window

    axis = F.sequence(F.lit(-10), F.lit(10))
    o = spark.range(1).select(F.explode(axis).alias("dy")).select("dy", F.explode(axis).alias("dx")).withColumn("d2", F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx"))
    return o.where("d2 between 1 and 100").withColumn("ring", F.dense_rank().over(Window.orderBy("d2")))


@query(f"""with {HEIGHTS}, {CROWNS}, {_zones(100, 'h')} select id as crown_id, max(v) as height from h join z on r between r0 and r1 and c between c0 and c1 group by id""")
def crown_height(spark, d):
    h = heights(spark, d)
    held = zonal.zonal_pixels(h, zonal.pixel_ranges(crowns(spark, d), 100, _height(h)))
    return held.groupBy("crown_id").agg(F.max("v").alias("height"))


@query(f"with {HEIGHTS} select (r // 7) * 15 + c // 7 as label, count(*) as pixels, min(r) as min_row, max(r) as max_row, min(c) as min_col, max(c) as max_col, max(v) as height from h group by 1")
def crown_footprint(spark, d):
    return focal.footprints(heights(spark, d).withColumn("label", F.expr("row div 7 * 15 + col div 7")))


@query(f"with {HEIGHTS} select max(t) as total from (select sum(cast(v as decimal(18,2)))::double as t from h group by r // 64, c // 64)")
def dispatch_reduce(spark, d):
    import numpy as np

    best = tiles.dispatch(heights(spark, d), lambda a: round(float(np.nansum(np.round(a * 100))) / 100, 2), "reduce", max, size=64)
    return spark.createDataFrame([(best,)], "total double")


@query(f"with {HEIGHTS} select r // 64 as tile_r, c // 64 as tile_c, max(v) as result from h group by 1, 2")
def dispatch_collect(spark, d):
    import numpy as np

    return tiles.dispatch(heights(spark, d), lambda a: float(np.nanmax(a)), "collect", size=64)


@query(f"with {HEIGHTS} select r as row, c as col, v / 2 as v from h")
def dispatch_stitch(spark, d):
    return tiles.dispatch(heights(spark, d), lambda a: a / 2, "stitch", size=64)


@query(f"""with {HEIGHTS}, n as (select max(r) + 1 as hh from h), k as (select i, exp(-0.5 * i * i) / (select sum(exp(-0.5 * j * j)) from range(-4, 5) q(j)) as w from range(-4, 5) o(i)),
    y as (select t.r, t.c, sum(s.v * w) as v from h t, n, k, h s where s.c = t.c and s.r = case when t.r + i < 0 then -1 - (t.r + i) when t.r + i >= hh then 2 * hh - 1 - (t.r + i) else t.r + i end group by 1, 2)
    select t.r as row, t.c as col, round(sum(s.v * w), 3) as v from y t, k, y s where s.r = t.r and s.c = case when t.c + i < 0 then -1 - (t.c + i) when t.c + i >= 100 then 199 - (t.c + i) else t.c + i end group by 1, 2""")
def gaussian_smooth(spark, d):
    return focal.gaussian(heights(spark, d), 1.0, 512).withColumn("v", F.round("v", 3))


@query()
def footprint_closing(spark, d):
    h = heights(spark, d)
    return focal.footprint_closing(h.withColumn("v", F.when(F.col("v") > 60000, F.col("v"))))


@query(f"""with {HEIGHTS}, w as (select * from (values (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)) q(dr, dc)),
    m as (select t.r, t.c, dr, dc, min(k) as k from (select * from h where v <= 60000) t, w, range(1, 11) z(k), h s where s.r = t.r + k * dr and s.c = t.c + k * dc and s.v > 60000 group by 1, 2, 3, 4),
    f as (select m.r, m.c, sum(s.v / (k * sqrt(dr * dr + dc * dc))) / sum(1 / (k * sqrt(dr * dr + dc * dc))) as v from m join h s on s.r = m.r + k * dr and s.c = m.c + k * dc group by 1, 2)
    select h.r as row, h.c as col, round(case when h.v > 60000 then h.v else coalesce(f.v, 'nan'::double) end, 6) as v from h left join f on f.r = h.r and f.c = h.c""")
def fill_nodata(spark, d):
    h = heights(spark, d)
    return focal.fill_nodata(h.withColumn("v", F.when(F.col("v") > 60000, F.col("v"))), 10).withColumn("v", F.round("v", 6))


def _canopy(spark, d):
    """Heights as metres, so that tree-sized parameters fit."""
    return heights(spark, d).withColumn("v", F.col("v") / 10000.0)


@query()
def treetops_vws(spark, d):
    return focal.treetops_vws(_canopy(spark, d), size=256, overlap=32)


@query()
def treetops_prominence(spark, d):
    return focal.treetops_prominence(_canopy(spark, d), prominence=5.0, size=256, overlap=32)


def _tops(spark, d):
    return focal.treetops_lmf(_canopy(spark, d), 7).select((F.col("row") * 1000 + F.col("col")).cast("long").alias("tree_id"), "row", "col")


@query()
def crowns_watershed(spark, d):
    return focal.crowns(_canopy(spark, d), _tops(spark, d), "watershed", size=256, overlap=32)


@query()
def crowns_region_growing(spark, d):
    return focal.crowns(_canopy(spark, d), _tops(spark, d), "region_growing", size=256, overlap=32)


@query()
def crown_polygons(spark, d):
    """Outer rings of the crowns that region growing gives."""
    labels = focal.crowns(_canopy(spark, d), _tops(spark, d), "region_growing", size=256, overlap=32)
    return focal.label_polygons(labels).select("tree_id", F.size("ring").alias("vertices"))


@query(f"""with {HEIGHTS}, n as (select max(r) + 1 as hh from h),
    k as (select hh, radians(0.001 * 100) * 6378137.0 as mx, ln(tan(pi() / 4 + radians(0.001 * hh) / 2)) * 6378137.0 as my, ln(tan(pi() / 4)) * 6378137.0 as y0 from n),
    s as (select *, sqrt(mx * mx + (my - y0) * (my - y0)) / sqrt(10000 + hh * hh) as ps from k),
    w as (select *, cast(floor(mx / ps + 0.5) as bigint) as wide, cast(floor((my - y0) / ps + 0.5) as bigint) as high from s),
    g as (select row, unnest(range(wide)) as col, ps, my, hh from (select *, unnest(range(high)) as row from w)),
    p as (select cast(row as int) as row, cast(col as int) as col, hh, degrees((col + 0.5) * ps / 6378137.0) / 0.001 as x, (0.001 * hh - degrees(2 * atan(exp((my - (row + 0.5) * ps) / 6378137.0)) - pi() / 2)) / 0.001 as y from g),
    m as (select row, col, v, (1 - abs(r + 0.5 - y)) * (1 - abs(c + 0.5 - x)) as q from p join h on r in (cast(floor(y - 0.5) as int), cast(floor(y - 0.5) as int) + 1) and c in (cast(floor(x - 0.5) as int), cast(floor(x - 0.5) as int) + 1)
        where x >= 0 and x < 100 and y >= 0 and y < hh and abs(r + 0.5 - y) < 1 and abs(c + 0.5 - x) < 1)
    select p.row, p.col, round(sum(v * q) / sum(q)) as v from p left join m on m.row = p.row and m.col = p.col group by 1, 2""")
def reproject_bilinear(spark, d):
    """The height raster in degrees (0.001 a pixel) in web mercator, on the grid and resolution that follow from it."""
    h = heights(spark, d)
    n = h.agg(F.max("row")).first()[0] + 1
    out, *_ = warp.reproject(h, raster.Affine(0.001, 0.0, -0.001, 0.001 * n), 100, n, 4326, 3857)
    return out.withColumn("v", F.round("v"))


@query(f"""with {HEIGHTS}, {SPECTRAL}, n as (select max(r) + 1 as hh from h), p as (select e.r as row, e.c as col, (e.c + 0.5) * 2 + 1 as x, (e.r + 0.5) * 0.5 + 0.25 as y, hh from e, n),
    m as (select row, col, v, (1 - abs(r + 0.5 - y)) * (1 - abs(c + 0.5 - x)) as q from p join h on r in (cast(floor(y - 0.5) as int), cast(floor(y - 0.5) as int) + 1) and c in (cast(floor(x - 0.5) as int), cast(floor(x - 0.5) as int) + 1)
        where x < 100 and y < hh and abs(r + 0.5 - y) < 1 and abs(c + 0.5 - x) < 1)
    select p.row, p.col, round(sum(v * q) / sum(q), 6) as v from p left join m on m.row = p.row and m.col = p.col group by 1, 2""")
def align_bilinear(spark, d):
    h = heights(spark, d)
    n = h.agg(F.max("row")).first()[0] + 1
    out = warp.align(h, raster.Affine(1.0, 0.0, 1.0, 0.0), 100, n, spectral(spark, d), raster.Affine(2.0, 1.0, 0.5, 0.25), resampling="bilinear")
    return out.withColumn("v", F.round("v", 6))


@query(f"""with {CROWNS}, {HEIGHTS}, n as (select max(r) + 1 as hh from h), d as (select id, (minx + maxx) / 2 as cx, (miny + maxy) / 2 as cy, (maxx - minx) / 2 + 0.03 as s from k),
    w as (select *, greatest(0, floor(cx - s)) as c0, least(100, floor(cx - s) + ceil((cx + s) - (cx - s))) as c1, greatest(0, floor(cy - s)) as r0, least(hh, floor(cy - s) + ceil((cy + s) - (cy - s))) as r1 from d, n),
    p as (select id, v, abs(c + 0.5 - cx) + abs(r + 0.5 - cy) < s as held, greatest(0, c - cx, cx - (c + 1)) + greatest(0, r - cy, cy - (r + 1)) < s as met, c1 - c0 <= 2 or r1 - r0 <= 2 as small
        from w join h on r >= r0 and r < r1 and c >= c0 and c < c1),
    e as (select *, bool_or(held) over (partition by id) as any_held from p)
    select id as crown_id, count(*) as n, min(v) as low, max(v) as high, median(v) as med from e where held or (met and (small or not any_held)) group by id""")
def zonal_polygons(spark, d):
    """Heights within diamonds round the crowns: pixels by their centres, in small windows all that are touched."""
    h, k = heights(spark, d), crowns(spark, d)
    cx, cy, s = (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, (F.col("maxx") - F.col("minx")) / 2 + 0.03
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(corner(cx - s, cy), corner(cx, cy - s), corner(cx + s, cy), corner(cx, cy + s), corner(cx - s, cy))
    shapes = vector.ring_wkb(k.select("crown_id", ring.alias("ring"))).select("crown_id", "geom")
    held = vector.zonal_polygons(h, shapes, 100, h.agg(F.max("row")).first()[0] + 1)
    return held.groupBy("crown_id").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.median("v").alias("med"))
