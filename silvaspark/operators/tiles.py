"""Tiles of pixel tables: keys, overlaps, halos, stitching, and user functions per tile."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvaspark.operators.raster import Affine


def kept(df: DataFrame) -> DataFrame:
    """Computed once and written to the checkpoint folder, so that lost executors cost nothing.

    Where the session names no folder and all runs on one machine (tests), a temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="silvaspark-"))
    return df.checkpoint()


def tile_of(pixels: DataFrame, size: int) -> DataFrame:
    """Pixels with the key ``tile_r, tile_c`` of the only tile that holds them."""
    return pixels.withColumn("tile_r", F.floor(F.col("row") / size).cast("int")).withColumn("tile_c", F.floor(F.col("col") / size).cast("int"))


def _covering(position: str, size: int, step: int) -> Column:
    """Numbers of the tiles ``[k * step, k * step + size)`` that hold a position."""
    p = F.col(position)
    return F.sequence(F.greatest(F.lit(0), F.floor((p - size) / step) + 1).cast("int"), F.floor(p / step).cast("int"))


def overlapping_tiles(pixels: DataFrame, size: int, overlap: int) -> DataFrame:
    """Each pixel once for every tile that covers it; tiles start every ``size - overlap`` pixels, ragged at the edges."""
    if not 0 <= overlap < size:
        raise ValueError(f"overlap {overlap} must be at least 0 and less than the tile size {size}")
    step = size - overlap
    return pixels.withColumn("tile_r", F.explode(_covering("row", size, step))).withColumn("tile_c", F.explode(_covering("col", size, step)))


def core_halo(pixels: DataFrame, size: int, overlap: int) -> DataFrame:
    """Each pixel for its own tile (``is_core``) and for every neighbour whose halo of ``overlap`` pixels holds it."""
    def near(p: str) -> Column:
        return F.sequence(F.greatest(F.lit(0), F.floor((F.col(p) - overlap) / size)).cast("int"), F.floor((F.col(p) + overlap) / size).cast("int"))

    out = pixels.withColumn("tile_r", F.explode(near("row"))).withColumn("tile_c", F.explode(near("col")))
    core = (F.floor(F.col("row") / size) == F.col("tile_r")) & (F.floor(F.col("col") / size) == F.col("tile_c"))
    return out.withColumn("is_core", core)


def in_raster(tiles: DataFrame, size: int) -> DataFrame:
    """Drop tiles that have no core pixel (halos beyond the raster's edge)."""
    real = tiles.where("is_core").select("tile_r", "tile_c").distinct()
    return tiles.join(real, ["tile_r", "tile_c"], "left_semi")


def stitch(tiles: DataFrame, value: str = "v", order: str = "seq") -> DataFrame:
    """One value per pixel from overlapping tiles: the tile with the highest ``order`` wins."""
    return tiles.groupBy("row", "col").agg(F.max_by(value, order).alias(value))


def retile(pixels: DataFrame, size: int) -> DataFrame:
    """Pixels laid out by tile: together in a partition and sorted within it, so that windows prune row groups."""
    return tile_of(pixels, size).repartition("tile_r", "tile_c").sortWithinPartitions("tile_r", "tile_c", "row", "col")


def window_patch(base: DataFrame, patch: DataFrame, value: str = "v") -> DataFrame:
    """Overwrite a window: values of ``patch`` where it has the pixel, else those of ``base``."""
    new = patch.select("row", "col", F.col(value).alias("__new"))
    return base.join(new, ["row", "col"], "left").withColumn(value, F.coalesce("__new", value)).drop("__new")


def tile_kernel(pixels: DataFrame, kernel: Callable[..., pd.DataFrame], schema: str, size: int = 1024, overlap: int = 64, value: str = "v") -> DataFrame:
    """Run ``kernel(array, r0, c0, core)`` on every tile with its halo.

    ``array`` is the dense tile with halo (NaN where there is no pixel), ``r0, c0`` the place of its first element,
    ``core`` a boolean array of the pixels that the tile owns. A task holds one tile, so memory is bounded by
    ``(size + 2 * overlap) ** 2`` values whatever the raster's size.
    """
    tiles = in_raster(core_halo(pixels.select("row", "col", F.col(value).cast("double").alias("v")), size, overlap), size)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(part.row.min()), int(part.col.min())
        shape = int(part.row.max()) - r0 + 1, int(part.col.max()) - c0 + 1
        array, core = np.full(shape, np.nan), np.zeros(shape, bool)
        r, c = part.row.to_numpy() - r0, part.col.to_numpy() - c0
        array[r, c], core[r, c] = part.v.to_numpy(), part.is_core.to_numpy()
        return kernel(array, r0, c0, core)

    return tiles.groupBy("tile_r", "tile_c").applyInPandas(run, schema)


def grid_kernel(cells: DataFrame, kernel: Callable[..., pd.DataFrame], schema: str, width: int, height: int, size: int = 1024, overlap: int = 64) -> DataFrame:
    """Run ``kernel(arrays, r0, c0, core)`` on every tile of a raster that has a cell in it or in its halo.

    Only the cells that there are move; each task lays its tile out whole, cut to the raster of ``height`` by ``width``.
    ``arrays`` has an array per column of ``cells`` beside ``row`` and ``col`` (NaN where there is no cell or a null),
    ``core`` is True in the tile itself, also where it has no cell. Cells outside the raster are left out.
    """
    names = [c for c in cells.columns if c not in ("row", "col")]
    tiles = in_grid(cells.select("row", "col", *(F.col(n).cast("double").alias(n) for n in names)), width, height, size, overlap)
    run = lambda part: kernel(*laid_out(part, names, width, height, size, overlap))
    return tiles.groupBy("tile_r", "tile_c").applyInPandas(run, schema)


def in_grid(cells: DataFrame, width: int, height: int, size: int, overlap: int) -> DataFrame:
    """The cells in a raster, each for every tile of it whose core or halo holds it."""
    there = cells.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    return core_halo(there, size, overlap).where((F.col("tile_r") * size < height) & (F.col("tile_c") * size < width)).drop("is_core")


def laid_out(part: pd.DataFrame, names: list[str], width: int, height: int, size: int, overlap: int) -> tuple[dict, int, int, np.ndarray]:
    """Arrays of one tile's cells with its halo, the place of their first element, and which are the tile's own."""
    tr, tc = int(part.tile_r.iloc[0]) * size, int(part.tile_c.iloc[0]) * size
    r0, c0 = max(0, tr - overlap), max(0, tc - overlap)
    shape = min(height, tr + size + overlap) - r0, min(width, tc + size + overlap) - c0
    arrays, core = {n: np.full(shape, np.nan) for n in names}, np.zeros(shape, bool)
    core[tr - r0 : tr - r0 + size, tc - c0 : tc - c0 + size] = True
    r, c = part.row.to_numpy() - r0, part.col.to_numpy() - c0
    for n in names:
        arrays[n][r, c] = part[n].to_numpy()
    return arrays, r0, c0, core


def dispatch(pixels: DataFrame, func: Callable[[np.ndarray], object], how: str = "stitch", reducer: Callable | None = None, size: int = 1024, overlap: int = 0):
    """Apply a user function to every tile's array.

    ``stitch``: the function gives an array of the same shape, the result is a pixel table. ``collect``: it gives a
    number, the result is a row per tile. ``reduce``: numbers are folded by ``reducer`` in tile order. ``none``: the
    function runs for its effects.
    """
    if how == "stitch":
        def whole(array, r0, c0, core):
            r, c = np.nonzero(core)
            return pd.DataFrame({"row": r + r0, "col": c + c0, "v": np.asarray(func(array), float)[r, c]})

        return tile_kernel(pixels, whole, "row int, col int, v double", size, overlap)

    def one(array, r0, c0, core):
        r, c = np.nonzero(core)
        result = func(np.where(core, array, np.nan))
        return pd.DataFrame({"tile_r": [(r[0] + r0) // size], "tile_c": [(c[0] + c0) // size], "result": [float(result) if result is not None else np.nan]})

    rows = tile_kernel(pixels, one, "tile_r int, tile_c int, result double", size, overlap)
    if how == "collect":
        return rows
    if how == "none":
        rows.foreachPartition(lambda _: None)
        return None
    if how == "reduce":
        if reducer is None:
            raise ValueError("reduce needs a reducer")
        from functools import reduce

        return reduce(reducer, (r.result for r in rows.orderBy("tile_r", "tile_c").toLocalIterator()))
    raise ValueError(f"{how} is none of stitch, collect, reduce, none")


def seed_tiles(tops: DataFrame, pixels: DataFrame, grid: Affine, size: int = 1024, overlap: int = 64) -> DataFrame:
    """``tree_id, tile_r, tile_c, row, col, local_row, local_col, is_core``: treetops ``tree_id, x, y`` in every tile whose halo box holds them.

    Tiles are those of the whole raster ``pixels``; treetops beyond its edge are in none. ``local_row, local_col`` count
    from the first pixel of the tile with its halo.
    """
    boxes = in_raster(core_halo(pixels.select("row", "col"), size, overlap), size).groupBy("tile_r", "tile_c").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    row, col = grid.cell(F.col("x"), F.col("y"))
    seeds = core_halo(tops.select("tree_id", row.alias("row"), col.alias("col")), size, overlap)
    held = seeds.join(boxes, ["tile_r", "tile_c"]).where("row between r0 and r1 and col between c0 and c1")
    return held.select("tree_id", "tile_r", "tile_c", "row", "col", (F.col("row") - F.col("r0")).alias("local_row"), (F.col("col") - F.col("c0")).alias("local_col"), "is_core")


def strategy_report(df: DataFrame) -> dict:
    """What takes the place of a tiling strategy: the physical plan and the number of scan partitions."""
    return {"plan": df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")), "partitions": df.rdd.getNumPartitions()}
