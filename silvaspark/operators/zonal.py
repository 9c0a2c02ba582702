"""Zonal statistics: pixels of a raster per crown box or polygon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = 16


def pixel_ranges(crowns: DataFrame, width: int, height: Column | int) -> DataFrame:
    """Crown boxes with the rows and columns of their pixels, ``r0..r1, c0..c1`` (inclusive), in a raster of unit pixels.

    The window starts at the floor of the box and is as long as its size rounded up, cut to the raster. A pixel
    belongs to the crown if its centre is inside; if the window is at most two pixels wide or high, or no centre is
    inside, every pixel of the window that the box touches does. Crowns outside the raster are left out.
    """
    def axis(lo: str, hi: str, n, name: str) -> list[Column]:
        a = F.floor(lo)
        first, last = F.greatest(a, F.lit(0)), F.least(a + F.ceil(F.col(hi) - F.col(lo)), F.lit(n) if isinstance(n, int) else n) - 1
        inner0 = F.greatest(first, F.floor(F.col(lo) - 0.5) + 1)
        inner1 = F.least(last, F.ceil(F.col(hi) - 0.5) - 1)
        outer1 = F.least(last, F.ceil(hi) - 1)
        return [first.alias(f"{name}_first"), last.alias(f"{name}_last"), inner0.alias(f"{name}_in0"), inner1.alias(f"{name}_in1"), outer1.alias(f"{name}_out1")]

    w = crowns.select("*", *axis("minx", "maxx", width, "c"), *axis("miny", "maxy", height, "r"))
    w = w.where("c_first <= c_last and r_first <= r_last")
    touched = F.expr("c_last - c_first < 2 or r_last - r_first < 2 or c_in1 < c_in0 or r_in1 < r_in0")
    pick = lambda n: [F.when(touched, F.col(f"{n}_first")).otherwise(F.col(f"{n}_in0")).cast("int").alias(f"{n}0"), F.when(touched, F.col(f"{n}_out1")).otherwise(F.col(f"{n}_in1")).cast("int").alias(f"{n}1")]
    return w.select(*crowns.columns, *pick("c"), *pick("r"))


def zonal_pixels(pixels: DataFrame, ranges: DataFrame, cell: int = CELL) -> DataFrame:
    """Pixels joined to the crowns that hold them.

    Crowns are exploded to the cells that they reach and joined on the cell: an equi-join that Spark can shuffle,
    broadcast or split when skewed, where a range condition alone would compare all pixels with all crowns. A pixel is
    in one cell, so no pair comes twice.
    """
    cells = lambda n: F.explode(F.sequence(F.floor(F.col(f"{n}0") / cell).cast("int"), F.floor(F.col(f"{n}1") / cell).cast("int")))
    zones = ranges.where("c0 <= c1 and r0 <= r1").withColumn("cell_r", cells("r")).withColumn("cell_c", cells("c"))
    keyed = pixels.withColumn("cell_r", F.floor(F.col("row") / cell).cast("int")).withColumn("cell_c", F.floor(F.col("col") / cell).cast("int"))
    return keyed.join(zones, ["cell_r", "cell_c"]).where("row between r0 and r1 and col between c0 and c1").drop("cell_r", "cell_c")


def valid(bands: str, threshold: float | None, nodata: float | None = None) -> Column:
    """A pixel counts if no band is null, NaN or nodata and all are over the threshold."""
    def good(b: Column) -> Column:
        ok = b.isNotNull() & ~F.isnan(b)
        if nodata is not None:
            ok = ok & (b != F.lit(nodata))
        return ok & (b > F.lit(threshold)) if threshold is not None else ok

    return F.forall(bands, good)


def statistics(value: Column, scale: int | None = None) -> list[Column]:
    """Count, median, mean, population deviation, minimum and maximum.

    With ``scale`` (decimals of the data) sums are exact decimals, so results do not depend on the order of rows.
    """
    n = F.count(value)
    if scale is None:
        mean, sd = F.avg(value), F.stddev_pop(value)
    else:
        d = value.cast(f"decimal(18,{scale})")
        s1, s2 = F.sum(d).cast("double"), F.sum(d * d).cast("double")
        mean, sd = s1 / n, F.sqrt(F.greatest(n.cast("double") * s2 - s1 * s1, F.lit(0.0))) / n
    return [n.alias("n"), F.median(value).alias("med"), mean.alias("mean"), sd.alias("sd"), F.min(value).alias("min"), F.max(value).alias("max")]


def first_of_id(crowns: DataFrame) -> DataFrame:
    """One crown per id; of repeated ids the one with the least box."""
    least = crowns.groupBy("crown_id").agg(F.min(F.struct("minx", "miny", "maxx", "maxy", "species")).alias("x"))
    return least.select("crown_id", "x.species", "x.minx", "x.miny", "x.maxx", "x.maxy")


def zonal_statistics(pixels: DataFrame, crowns: DataFrame, width: int, height, threshold: float | None = 0.001, nodata: float | None = None, scale: int | None = None, source: str = "memory_raster") -> DataFrame:
    """Long table ``crown_id, species, raster_source, band, n, med, mean, sd, min, max`` of ``pixels (row, col, bands)``.

    Crowns without a valid pixel have no row.
    """
    held = zonal_pixels(pixels, pixel_ranges(first_of_id(crowns), width, height)).where(valid("bands", threshold, nodata))
    long = held.select("crown_id", "species", F.posexplode("bands").alias("band", "value"))
    return long.groupBy("crown_id", "species", (F.col("band") + 1).alias("band")).agg(*statistics(F.col("value"), scale)).withColumn("raster_source", F.lit(source))


def zonal_raw(pixels: DataFrame, crowns: DataFrame, width: int, height, threshold: float | None = 0.001) -> DataFrame:
    """The values themselves per crown and band, in row and column order."""
    held = zonal_pixels(pixels, pixel_ranges(first_of_id(crowns), width, height)).where(valid("bands", threshold))
    long = held.select("crown_id", "row", "col", F.posexplode("bands").alias("band", "value"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("row", "col", "value"))), lambda x: x["value"])
    return long.groupBy("crown_id", (F.col("band") + 1).alias("band")).agg(values.alias("values"))


def zonal_wide(pixels: DataFrame, crowns: DataFrame, width: int, height, bands: dict[str, int], threshold: float | None = 0.001) -> DataFrame:
    """A row per crown with ``{band}_med, {band}_mean ...`` for the named bands (1-based numbers): pruned, no pivot shuffle."""
    picked = pixels.select("row", "col", F.array(*(F.get("bands", i - 1) for i in bands.values())).alias("bands"))
    held = zonal_pixels(picked, pixel_ranges(first_of_id(crowns), width, height)).where(valid("bands", threshold))
    aggs = [c.alias(f"{name}_{s}") for i, name in enumerate(bands) for s, c in zip(("n", "med", "mean", "sd", "min", "max"), statistics(F.get("bands", i)), strict=True) if s != "n"]
    return held.groupBy("crown_id", "species").agg(*aggs)
