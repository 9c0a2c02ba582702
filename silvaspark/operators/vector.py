"""Vector layers as DataFrames: attributes beside ``minx, miny, maxx, maxy`` boxes, ``x, y`` points or ``geom`` WKB."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType

from silvaspark.functions import crs, geometry
from silvaspark.operators.tiles import kept

GEOMETRY = {"geom", "srid", "minx", "miny", "maxx", "maxy", "x", "y", "z"}


def select_columns(layer: DataFrame, columns: list[str]) -> DataFrame:
    """Chosen attributes; geometry columns always stay."""
    return layer.select(*columns, *(c for c in layer.columns if c in GEOMETRY and c not in columns))


def filter_vector(layer: DataFrame, condition: Column | Callable[[DataFrame], Column]) -> DataFrame:
    return layer.where(condition(layer) if callable(condition) and not isinstance(condition, Column) else condition)


def total_bounds(layer: DataFrame) -> DataFrame:
    return layer.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def box_ring(layer: DataFrame) -> DataFrame:
    """Boxes with their closed ring ``ring ARRAY<STRUCT<x, y>>``."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return layer.withColumn("ring", F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"), corner("minx", "maxy"), corner("minx", "miny")))


def centroid(layer: DataFrame, ring: str = "ring") -> DataFrame:
    """``cx, cy`` of closed rings by the shoelace formula, taken about the first vertex; vertex mean for rings without area."""
    n = F.size(ring)
    x0, y0 = F.get(ring, 0)["x"], F.get(ring, 0)["y"]
    at = lambda i: (F.get(ring, i)["x"] - x0, F.get(ring, i)["y"] - y0)

    def add(s: Column, i: Column) -> Column:
        (xa, ya), (xb, yb) = at(i), at(i + 1)
        cross = xa * yb - xb * ya
        return F.struct((s["a"] + cross).alias("a"), (s["x"] + (xa + xb) * cross).alias("x"), (s["y"] + (ya + yb) * cross).alias("y"))

    zero = F.struct(*(F.lit(0.0).alias(k) for k in "axy"))
    out = layer.withColumn("__s", F.aggregate(F.sequence(F.lit(0), n - 2), zero, add))
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[k]) / n
    some = F.col("__s.a") != 0
    return out.withColumn("cx", F.when(some, x0 + F.try_divide(F.col("__s.x"), 3 * F.col("__s.a"))).otherwise(mean("x"))).withColumn("cy", F.when(some, y0 + F.try_divide(F.col("__s.y"), 3 * F.col("__s.a"))).otherwise(mean("y"))).drop("__s")


def force_z(layer: DataFrame, dimensions: int) -> DataFrame:
    """Points with (3) or without (2) a ``z`` column; others raise ValueError. A layer that conforms stays as it is."""
    if dimensions not in (2, 3):
        raise ValueError(f"dimensions must be 2 or 3, not {dimensions}")
    if dimensions == 2:
        return layer.drop("z")
    return layer if "z" in layer.columns else layer.withColumn("z", F.lit(0.0))


def force_z_wkb(layer: DataFrame, dimensions: int) -> DataFrame:
    if dimensions not in (2, 3):
        raise ValueError(f"dimensions must be 2 or 3, not {dimensions}")

    @F.pandas_udf(BinaryType())
    def change(g: pd.Series) -> pd.Series:
        return g.map(lambda b: None if b is None else geometry.to_wkb(geometry.set_dimensions(geometry.from_wkb(b), dimensions)))

    return layer.withColumn("geom", change("geom"))


def validate(layer: DataFrame, fix_invalid: bool = True, drop_invalid: bool = True) -> DataFrame:
    """Repair self-crossing and open polygons, then drop what is still invalid; valid geometries pass unread by the repair."""
    @F.pandas_udf(BinaryType())
    def repair(g: pd.Series) -> pd.Series:
        return g.map(lambda b: b if b is None or geometry.is_valid(b) else geometry.repair(b))

    @F.pandas_udf(BooleanType())
    def ok(g: pd.Series) -> pd.Series:
        return g.map(lambda b: b is not None and geometry.is_valid(b))

    out = layer.withColumn("geom", repair("geom")) if fix_invalid else layer
    return out.where(ok("geom")) if drop_invalid else out


def to_crs(layer: DataFrame, source: int, target: int, x: str = "x", y: str = "y") -> DataFrame:
    """Point columns in another coordinate system (EPSG numbers: 4326, 3857, UTM zones); stays in generated code."""
    east, north = crs.transform(F.col(x), F.col(y), source, target)
    return layer.withColumns({x: east, y: north})


def to_crs_wkb(layer: DataFrame, source: int, target: int) -> DataFrame:
    """``geom`` (WKB) in another coordinate system, vertex by vertex; null stays, a Z stays as it is."""

    @F.pandas_udf(BinaryType())
    def change(g: pd.Series) -> pd.Series:
        move = lambda p: (*crs.transform(p[0], p[1], source, target, crs.NUMBERS), *p[2:])
        return g.map(lambda b: None if b is None else geometry.to_wkb(geometry.mapped(geometry.from_wkb(b), move)))

    return layer.withColumn("geom", change("geom"))


def to_web_mercator(layer: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """EPSG:4326 degrees to EPSG:3857 metres ``x, y``."""
    x, y = crs.transform(F.col(lon), F.col(lat), 4326, 3857)
    return layer.withColumn("x", x).withColumn("y", y)


def from_web_mercator(layer: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    lon, lat = crs.transform(F.col(x), F.col(y), 3857, 4326)
    return layer.withColumn("lon", lon).withColumn("lat", lat)


def to_utm(layer: DataFrame, srid: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """EPSG:4326 to a UTM zone (EPSG:326zz north, 327zz south)."""
    crs.zone(srid)
    x, y = crs.transform(F.col(lon), F.col(lat), 4326, srid)
    return layer.withColumn("x", x).withColumn("y", y)


def prepare_crowns(layer: DataFrame, id_column: str, species_column: str | None = None, do_validate: bool = False, fix_invalid: bool = True) -> DataFrame:
    """``crown_id, species`` and the rest. If any id repeats, all are replaced by the row's index in order of id and box.

    Ids become integers where all can be read as such, else they stay. With ``do_validate`` polygons in ``geom`` are
    checked first (repaired with ``fix_invalid``, dropped if they cannot be); if none is left, ValueError.
    """
    if do_validate and "geom" in layer.columns:
        layer = kept(validate(layer, fix_invalid))
        if layer.isEmpty():
            raise ValueError("no valid geometry is left")
    out = layer.withColumnRenamed(id_column, "crown_id")
    out = out.withColumnRenamed(species_column, "species") if species_column and species_column in out.columns else out.withColumn("species", F.lit(None).cast("string"))
    if not out.groupBy("crown_id").count().where("count > 1").isEmpty():
        keys = [c for c in ("crown_id", "minx", "miny", "maxx", "maxy") if c in out.columns]
        return numbered(out, keys).withColumn("crown_id", F.col("__n")).drop("__n")
    if out.schema["crown_id"].dataType.simpleString() == "string" and out.where(F.col("crown_id").isNotNull() & F.expr("try_cast(crown_id as bigint)").isNull()).isEmpty():
        out = out.withColumn("crown_id", F.expr("try_cast(crown_id as bigint)"))
    return out


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """``__n``: the rows' numbers from 0 in order of ``keys``, without one task for all.

    Rows are range-partitioned and sorted; each partition's size gives where the next begins (a row per partition).
    They are kept, as two exchanges would sample other ranges and count other partitions than those that are numbered.
    """
    ordered = kept(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id()))
    sizes = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("m"))
    start = sizes.select("__p", (F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("m")).alias("__s"))
    return ordered.join(start, "__p").withColumn("__n", F.col("__m") + F.col("__s")).drop("__p", "__m", "__s")


def prepare_treetops(layer: DataFrame, mapping: dict[str, str], default_status: str = "Alive") -> DataFrame:
    """Rename, check that ``tree_id`` and ``species`` are there (KeyError), ids as text, a status where there is none."""
    out = layer.withColumnsRenamed(mapping)
    for c in ("tree_id", "species"):
        if c not in out.columns:
            raise KeyError(c)
    out = out.withColumn("tree_id", F.col("tree_id").cast("string"))
    return out if "status" in out.columns else out.withColumn("status", F.lit(default_status))


def nearest(targets: DataFrame, source: DataFrame, payload: str, max_dist: float, key: str = "id") -> DataFrame:
    """Targets (``x, y``) with ``payload`` of the nearest source point within ``max_dist``, NULL if there is none.

    Sources are exploded to the 3 x 3 cells round theirs, cells as wide as ``max_dist``; targets join on their own
    cell. Ties go to the least ``key``. Rows of the result are combined map-side before they are shuffled.
    """
    cell = lambda c: F.floor(F.col(c) / max_dist)
    around = F.sequence(F.lit(-1), F.lit(1))
    s = source.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col(payload).alias("__payload"), F.col(key).alias("__key"), cell("x").alias("cx0"), cell("y").alias("cy0"))
    s = s.withColumn("gx", F.explode(F.transform(around, lambda d: F.col("cx0") + d))).withColumn("gy", F.explode(F.transform(around, lambda d: F.col("cy0") + d)))
    t = targets.withColumn("gx", cell("x")).withColumn("gy", cell("y"))
    d2 = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
    close = t.join(s, ["gx", "gy"]).where(d2 <= max_dist * max_dist)
    best = close.groupBy("x", "y").agg(F.min_by("__payload", F.struct(d2, "__key")).alias("__found"))
    return targets.join(best, ["x", "y"], "left").withColumnRenamed("__found", f"nearest_{payload}")


def label_crowns(crowns: DataFrame, trees: DataFrame, label: str = "species", max_dist: float = 2.0) -> DataFrame:
    """Crowns with ``species`` of the tree nearest to their centre; without one the value they have stays."""
    centred = crowns.withColumn("x", (F.col("minx") + F.col("maxx")) / 2).withColumn("y", (F.col("miny") + F.col("maxy")) / 2)
    found = nearest(centred, trees, label, max_dist, "tree_id")
    old = F.col("species") if "species" in crowns.columns else F.lit(None)
    return found.withColumn("species", F.coalesce(f"nearest_{label}", old)).drop("x", "y", f"nearest_{label}")


def assign_tree_ids(crowns: DataFrame, trees: DataFrame, cell: float = 8.0) -> DataFrame:
    """``crown_id, tree_id``: trees within crowns, the least tree per crown, then the least crown per tree."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    # a small file is one task's, and the aggregation in front of the exchange sorts all that the join gives it
    c = crowns.select("crown_id", "minx", "miny", "maxx", "maxy").transform(spread).withColumn("gx", span("minx", "maxx")).withColumn("gy", span("miny", "maxy"))
    t = trees.select("tree_id", "x", "y", F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    inside = c.join(t, ["gx", "gy"]).where("x between minx and maxx and y between miny and maxy")
    per_crown = inside.groupBy("crown_id").agg(F.min("tree_id").alias("tree_id"))
    return per_crown.groupBy("tree_id").agg(F.min("crown_id").alias("crown_id")).select("crown_id", "tree_id")


def ring_wkb(layer: DataFrame, ring: str = "ring") -> DataFrame:
    """``geom``: polygons (WKB) of closed rings ``ARRAY<STRUCT<x, y>>``; null for a null ring."""

    @F.pandas_udf(BinaryType())
    def pack(r: pd.Series) -> pd.Series:
        return r.map(lambda ps: None if ps is None else geometry.to_wkb((3, [[(p["x"], p["y"]) for p in ps]])))

    return spread(layer).withColumn("geom", pack(ring))


def spread(layer: DataFrame) -> DataFrame:
    """Rows dealt over three tasks a core: a file of small rows may be read by one task. Tasks are not put together again."""
    return layer.repartition(3 * layer.sparkSession.sparkContext.defaultParallelism)


def zonal_polygons(pixels: DataFrame, polygons: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """``pixels`` joined to the polygons (``crown_id, geom`` WKB, unit pixels) that hold them.

    A polygon has the pixels whose centres it holds. In a raster of ``height`` by ``width`` its window is its box rounded
    to pixels and cut to the raster; if that is at most two pixels wide or high, or holds no centre, the polygon has every
    pixel that it touches. Polygons are cut to pixels in batches of Arrow; the join is on row and column. Null geometries
    hold nothing; repeated rows of a polygon repeat its pixels.
    """

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if width is not None and height is not None:
                for at in range(0, len(batch), 2000):
                    part = batch.iloc[at : at + 2000]
                    which, rows, cols = geometry.many_window_pixels(part.geom.tolist(), width, height)
                    yield pd.DataFrame({"crown_id": part.crown_id.to_numpy()[which], "row": rows.astype("int32"), "col": cols.astype("int32")})
                continue
            for crown_id, geom in zip(batch.crown_id, batch.geom, strict=True):
                rows, cols = geometry.pixels(geometry.from_wkb(geom))
                yield pd.DataFrame({"crown_id": crown_id, "row": rows, "col": cols}).astype({"row": "int32", "col": "int32"})

    kind = polygons.schema["crown_id"].dataType.simpleString()
    covered = spread(polygons.select("crown_id", "geom").where("geom is not null")).mapInPandas(cover, f"crown_id {kind}, row int, col int")
    # packed well on disk, pixels look small enough to be broadcast, and then do not fit the driver
    return pixels.join(covered.hint("merge"), ["row", "col"])
