"""Rasters on other grids and in other coordinate systems.

Every new pixel looks for the old ones that its centre needs, by an equi-join on their row and column: nothing but the
pixels that meet is moved, and no task holds a raster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvaspark.functions import crs
from silvaspark.operators.raster import Affine


def default_grid(own: Affine, width: int, height: int, source: int, target: int, resolution: float | None = None) -> tuple[Affine, int, int]:
    """Affine, width and height of a raster's extent in another system.

    Pixels are square and as many along the diagonal as the raster has, unless ``resolution`` is given.
    """
    steps = [i / 20 for i in range(21)]
    edge = [p for s in steps for p in ((s * width, 0), (s * width, height), (0, s * height), (width, s * height))]
    at = [crs.transform(own.a * c + own.c, own.e * r + own.f, source, target, crs.NUMBERS) for c, r in edge]
    minx, maxx, miny, maxy = min(p[0] for p in at), max(p[0] for p in at), min(p[1] for p in at), max(p[1] for p in at)
    size = resolution or math.hypot(maxx - minx, maxy - miny) / math.hypot(width, height)
    shape = [max(1, math.floor((b - a) / size + 0.5)) for a, b in ((minx, maxx), (miny, maxy))]
    return Affine(size, minx, -size, maxy), *shape


def sample(wanted: DataFrame, pixels: DataFrame, x: Column, y: Column, own: Affine, width: int, height: int, resampling: str = "bilinear") -> DataFrame:
    """``wanted (row, col)`` with ``v`` of ``pixels`` at the point ``x, y``: NULL outside the raster and where it has none.

    ``nearest``: the pixel that holds the point. ``bilinear``: the weighted mean of the four round it; those that are
    missing, null or NaN are left out. Points within the raster's outer half pixel take what is there.
    """
    c, r = (x - own.c) / own.a, (y - own.f) / own.e
    placed = wanted.select("row", "col", r.alias("__y"), c.alias("__x"))
    there = pixels.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "v")
    inside = (F.col("__x") >= 0) & (F.col("__x") < width) & (F.col("__y") >= 0) & (F.col("__y") < height)
    if resampling == "nearest":
        keyed = placed.select("row", "col", F.when(inside, F.floor("__y").cast("int")).alias("__r"), F.when(inside, F.floor("__x").cast("int")).alias("__c"))
        return keyed.join(there, ["__r", "__c"], "left").select("row", "col", "v")
    if resampling != "bilinear":
        raise ValueError(f"{resampling} is none of nearest, bilinear")
    side = lambda p, n: F.filter(F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.struct((F.floor(p - 0.5) + i).cast("int").alias("k"), (1 - F.abs(F.floor(p - 0.5) + i + 0.5 - p)).alias("w"))), lambda s: (s["w"] > 0) & (s["k"] >= 0) & (s["k"] < n))
    near = placed.where(inside).select("row", "col", F.explode(side(F.col("__y"), height)).alias("a"), "__x").select("row", "col", "a", F.explode(side(F.col("__x"), width)).alias("b"))
    shares = near.select("row", "col", F.col("a.k").alias("__r"), F.col("b.k").alias("__c"), (F.col("a.w") * F.col("b.w")).alias("w"))
    met = shares.join(there.where(F.col("v").isNotNull() & ~F.isnan("v")), ["__r", "__c"])
    found = met.groupBy("row", "col").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    return wanted.select("row", "col").join(found, ["row", "col"], "left")


def grid(spark, width: int, height: int) -> DataFrame:
    """Every ``row, col`` of a raster."""
    n = spark.range(width * height)
    return n.select(F.expr(f"cast(id div {width} as int)").alias("row"), (F.col("id") % width).cast("int").alias("col"))


def reproject(pixels: DataFrame, own: Affine, width: int, height: int, source: int, target: int, resolution: float | None = None, resampling: str = "bilinear") -> tuple[DataFrame, Affine, int, int]:
    """``row, col, v`` of a raster in another coordinate system, with its affine, width and height.

    Pixels that the raster does not reach have a NULL ``v``; an empty raster gives NULLs. Systems are EPSG numbers.
    """
    to, w, h = default_grid(own, width, height, source, target, resolution)
    x, y = to.center(F.col("row"), F.col("col"))
    return sample(grid(pixels.sparkSession, w, h), pixels, *crs.transform(x, y, target, source), own, width, height, resampling), to, w, h


def align(pixels: DataFrame, own: Affine, width: int, height: int, target: DataFrame, to: Affine, source_crs: int = 4326, target_crs: int = 4326, resampling: str = "nearest") -> DataFrame:
    """``pixels`` on the grid ``row, col`` of ``target``, whatever its system; a raster of the same grid stays as it is."""
    if own.near(to) and source_crs == target_crs:
        return target.select("row", "col").join(pixels.select("row", "col", "v"), ["row", "col"], "left")
    x, y = to.center(F.col("row"), F.col("col"))
    return sample(target, pixels, *crs.transform(x, y, target_crs, source_crs), own, width, height, resampling)
