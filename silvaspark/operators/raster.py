"""Pixel tables: bands, windows, stacking, resampling, alignment, index formulas.

A raster is ``row, col`` and either ``v`` or ``bands ARRAY<DOUBLE>``; nodata is NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Affine:
    """``x = a * col + c``, ``y = e * row + f``: pixel sizes and the outer corner of the first pixel."""

    a: float
    c: float
    e: float
    f: float

    def center(self, row: Column, col: Column) -> tuple[Column, Column]:
        return (col + 0.5) * self.a + self.c, (row + 0.5) * self.e + self.f

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column that hold a point."""
        return F.floor((y - self.f) / self.e).cast("int"), F.floor((x - self.c) / self.a).cast("int")

    def near(self, other: Affine) -> bool:
        return all(abs(p - q) < 1e-6 for p, q in zip((self.a, self.c, self.e, self.f), (other.a, other.c, other.e, other.f), strict=True))


def scan(pixels: DataFrame, bands: list[int] | int | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Chosen bands (1-based) of a window ``row, col, height, width``, pixels counted from the window's corner."""
    if window:
        r, c, h, w = window
        pixels = pixels.where(F.col("row").between(r, r + h - 1) & F.col("col").between(c, c + w - 1)).withColumn("row", F.col("row") - r).withColumn("col", F.col("col") - c)
    if bands is None:
        return pixels.select("row", "col", "bands")
    picked = [bands] if isinstance(bands, int) else bands
    return pixels.select("row", "col", F.array(*(F.get("bands", b - 1) for b in picked)).alias("bands"))


def get_band(pixels: DataFrame, band: int | str, names: dict[str, int] | None = None, count: int | None = None) -> DataFrame:
    """One band as ``row, col, v``. Unknown names raise KeyError, numbers outside 1..count IndexError."""
    if isinstance(band, str):
        band = (names or {})[band]
    if band < 1 or (count is not None and band > count):
        raise IndexError(f"band {band} is not in 1..{count}")
    return pixels.select("row", "col", F.get("bands", band - 1).alias("v"))


def split_bands(pixels: DataFrame) -> DataFrame:
    """A row per band: ``band, row, col, v``."""
    return pixels.select("row", "col", F.posexplode("bands").alias("p", "v")).select((F.col("p") + 1).alias("band"), "row", "col", "v")


def stack_bands(left: DataFrame, right: DataFrame) -> DataFrame:
    """Bands of two rasters of the same grid after one another."""
    return left.select("row", "col", F.col("bands").alias("x")).join(right.select("row", "col", F.col("bands").alias("y")), ["row", "col"]).select("row", "col", F.concat("x", "y").alias("bands"))


def same_grid(left: DataFrame, right: DataFrame) -> bool:
    """Whether two rasters have exactly the same pixels."""
    a, b = left.select("row", "col"), right.select("row", "col")
    return a.join(b, ["row", "col"], "left_anti").isEmpty() and b.join(a, ["row", "col"], "left_anti").isEmpty()


def zip_rasters(rasters: dict[str, DataFrame]) -> DataFrame:
    """Rasters of one grid side by side, a column each; different grids raise ValueError."""
    (first, out), *rest = rasters.items()
    out = out.select("row", "col", F.col("v").alias(first))
    for name, r in rest:
        if not same_grid(out, r):
            raise ValueError(f"{name} does not have the grid of {first}")
        out = out.join(r.select("row", "col", F.col("v").alias(name)), ["row", "col"])
    return out


def crop(pixels: DataFrame, affine: Affine, bounds: tuple[float, float, float, float], width: int, height: int) -> DataFrame:
    """Pixels within ``minx, miny, maxx, maxy``: the offset is rounded, the length rounded up, cut to the raster."""
    minx, miny, maxx, maxy = bounds
    c0, r0 = (minx - affine.c) / affine.a, ((maxy if affine.e < 0 else miny) - affine.f) / affine.e
    import math

    c, r = math.floor(c0 + 0.5), math.floor(r0 + 0.5)
    c1, r1 = min(width, c + math.ceil((maxx - minx) / affine.a)), min(height, r + math.ceil((maxy - miny) / abs(affine.e)))
    c, r = max(0, c), max(0, r)
    if c >= c1 or r >= r1:
        raise ValueError(f"{bounds} holds no pixel")
    return pixels.where(F.col("row").between(r, r1 - 1) & F.col("col").between(c, c1 - 1)).withColumn("row", F.col("row") - r).withColumn("col", F.col("col") - c)


def resample_nearest(pixels: DataFrame, scale: float, width: int, height: int) -> DataFrame:
    """Size ``int(n * scale)``; each new pixel has the value of the old one at its centre. Pixels that shrink are exploded
    from their new places, so only the wanted ones are joined."""
    old = pixels.select("row", "col", "v")
    def span(p: str, n: int) -> Column:
        lo, hi = F.ceil(F.col(p) * scale - 0.5), F.ceil((F.col(p) + 1) * scale - 0.5) - 1
        lo, hi = F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit(int(n * scale) - 1)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    out = old.select(F.explode(span("row", height)).alias("row"), "col", "v")
    return out.select("row", F.explode(span("col", width)).alias("col"), "v")


def resample_bilinear(pixels: DataFrame, scale: float, width: int, height: int) -> DataFrame:
    """Weighted mean of the four old pixels round each new centre; at the edge the missing ones are left out.

    Each old pixel gives its share to the new pixels it touches; shares are summed by pixel (combined map-side).
    """
    def reach(p: str, n: int) -> Column:
        lo, hi = F.floor((F.col(p) - 0.5) * scale - 0.5) + 1, F.ceil((F.col(p) + 1.5) * scale - 0.5) - 1
        lo, hi = F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, F.lit(int(n * scale) - 1)).cast("int")
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    out = pixels.select("row", "col", "v", F.explode(reach("row", height)).alias("r")).select("row", "col", "v", "r", F.explode(reach("col", width)).alias("c"))
    share = lambda new, old: F.greatest(F.lit(0.0), 1 - F.abs((F.col(new) + 0.5) / scale - 0.5 - F.col(old)))
    out = out.select("r", "c", "v", (share("r", "row") * share("c", "col")).alias("w")).where("w > 0")
    return out.groupBy(F.col("r").alias("row"), F.col("c").alias("col")).agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def align(pixels: DataFrame, own: Affine, target: DataFrame, to: Affine, method: str = "first", resampling: str = "nearest") -> DataFrame:
    """``pixels`` on the grid ``row, col`` of ``target``: the value at each centre, NULL outside."""
    if method != "first" or resampling != "nearest":
        raise NotImplementedError(f"{method}, {resampling}")
    if own.near(to):
        return target.select("row", "col").join(pixels.select("row", "col", "v"), ["row", "col"], "left")
    r, c = own.cell(*to.center(F.col("row"), F.col("col")))
    wanted = target.select("row", "col", r.alias("__r"), c.alias("__c"))
    there = pixels.select(F.col("row").alias("__r"), F.col("col").alias("__c"), "v")
    return wanted.join(there, ["__r", "__c"], "left").select("row", "col", "v")


def spectral_index(pixels: DataFrame, formula: str, bands: dict[str, int], nodata: float | None = None, name: str = "v") -> DataFrame:
    """A formula over named bands (1-based), NULL where a used band is null, NaN or nodata or the formula divides by 0.

    The formula is a SQL expression, so it stays in generated code; ``/`` is read as division that gives NULL for 0.
    """
    picked = pixels.select("row", "col", *(F.get("bands", i - 1).alias(n) for n, i in bands.items()))
    used = F.lit(True)
    for n in bands:
        used = used & F.col(n).isNotNull() & ~F.isnan(n)
        if nodata is not None:
            used = used & (F.col(n) != F.lit(nodata))
    return picked.select("row", "col", F.when(used, F.expr(formula)).alias(name))
