"""Operators on small hand-made inputs: kernels, geometry, tiles, vectors, store, sources, streaming."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from silvaspark.functions import geometry, kernels, scalar
from silvaspark.operators import focal, points, raster, similarity, store, tiles, vector, zonal
from silvaspark.sources.roles import heights


def pixels(spark, a):
    r, c = np.indices(a.shape)
    flat = [None if np.isnan(v) else float(v) for v in a.ravel()]
    return spark.createDataFrame(list(zip(r.ravel().tolist(), c.ravel().tolist(), flat, strict=True)), "row int, col int, v double")


def grid(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r.v is None else r.v
    return out


def cones():
    y, x = np.mgrid[:21, :21]
    return np.maximum(0, np.maximum(10 - np.hypot(y - 5, x - 5) * 2, 8 - np.hypot(y - 14, x - 14) * 2))


def test_two_cones(spark):
    a = cones()
    p = pixels(spark, a)
    tops = {(5, 5), (14, 14)}
    assert {(r.row, r.col) for r in focal.treetops_lmf(p).collect()} == tops
    assert {(r.row, r.col) for r in focal.treetops_vws(p, base=4.0, size=8, overlap=8).collect()} == tops
    assert {(r.row, r.col) for r in focal.treetops_prominence(p, 1.0).collect()} == tops
    seeds = focal.treetops_lmf(p).select((F.col("row") * 100).cast("long").alias("tree_id"), "row", "col")
    for method in ("watershed", "region_growing"):
        whole = {(r.tree_id, r.row, r.col) for r in focal.crowns(p, seeds, method).collect()}
        assert {t for t, _, _ in whole} == {500, 1400}
        assert len({(r, c) for _, r, c in whole}) == len(whole)  # a pixel has one label at most
        assert {(r.tree_id, r.row, r.col) for r in focal.crowns(p, seeds, method, size=11, overlap=21).collect()} == whole
        rings = focal.label_polygons(focal.crowns(p, seeds, method)).collect()
        assert sum(abs(geometry.area([tuple(x) for x in r.ring])) for r in rings) == len(whole)


def test_plateau_gives_every_pixel(spark):
    a = np.zeros((9, 9))
    a[2:7, 2:7] = 5
    assert focal.treetops_lmf(pixels(spark, a)).count() == 25


def test_focal_filters_do_not_depend_on_tiles(spark):
    a = np.random.default_rng(0).normal(10, 3, (23, 31))
    p = pixels(spark, a)
    assert np.allclose(grid(focal.gaussian(p, 1.2, 7), a.shape), kernels.gaussian(a, 1.2))
    assert np.array_equal(grid(focal.grey_closing(p), a.shape), kernels.closing(a))
    padded = np.pad(a, 2, mode="symmetric")
    for k in (3, 5):
        views = np.lib.stride_tricks.sliding_window_view(padded[2 - k // 2 : padded.shape[0] - 2 + k // 2, 2 - k // 2 : padded.shape[1] - 2 + k // 2], (k, k))
        assert np.allclose(grid(focal.median(p, 31, 23, k), a.shape), np.median(views, axis=(2, 3)))
    a[5:8, 5:8] = np.nan
    filled = grid(focal.fill_nodata(pixels(spark, a), 5, 9), a.shape)
    assert np.allclose(filled, kernels.fill(a, 5)) and not np.isnan(filled).any()
    assert np.isnan(kernels.fill(np.full((3, 3), np.nan), 2)).all()


def test_footprint_closes_holes():
    m = np.ones((15, 15), bool)
    m[5:8, 5:8] = False
    m[:, 13:] = False
    out = kernels.footprint(m)
    assert out[5:8, 5:8].all() and not out[0, 14]
    assert kernels.components(np.array([[1, 0, 1], [1, 0, 1], [0, 0, 1]], bool)).tolist() == [[1, 0, 2], [1, 0, 2], [0, 0, 2]]


def test_footprint_does_not_depend_on_tiles(spark):
    """Holes wider than a tile and its halo, a ring around an island, and a winding gap that reaches the raster's edge."""
    a = np.ones((60, 70))
    a[6:36, 5:45] = np.nan
    a[15:26, 15:30] = 1.0
    a[42:48, 5:65] = np.nan
    a[6:48, 58:64] = np.nan
    a[6:12, 50:64] = np.nan
    a[42:60, 5:11] = np.nan
    a[52:58, 20:60] = np.nan
    want = kernels.footprint(~np.isnan(a)).astype(float)
    assert want[6:36, 5:45].all() and not want[8, 52] and want[54, 40]
    for size, overlap in ((8, 4), (13, 0), (1024, 64)):
        assert np.array_equal(grid(focal.footprint_closing(pixels(spark, a), size, overlap), a.shape), want)
    rare = np.where(np.random.default_rng(4).random((50, 50)) < 0.04, 1.0, np.nan)
    rare[:, 20:32] = np.nan
    rare[[0, -1], :] = rare[:, [0, -1]] = 1.0  # pixels without a row: in whole tiles, and a hole across them
    got = focal.footprint_closing(pixels(spark, rare).where("v is not null"), 7, 4).collect()
    want = kernels.footprint(~np.isnan(rare))
    assert sorted((r.row, r.col) for r in got) == sorted(zip(*(x.tolist() for x in np.nonzero(~np.isnan(rare))), strict=True))
    assert all(r.v == want[r.row, r.col] for r in got)
    assert np.array_equal(grid(focal.footprint_closing(pixels(spark, rare), 7, 4), rare.shape), want)


def test_cloth_finds_the_plane(spark):
    rows = [(float(x), float(y), 0.1 * x + (5.0 if 8 <= x < 11 and 8 <= y < 11 else 0.0)) for x in range(20) for y in range(20)]
    p = spark.createDataFrame(rows, "x double, y double, z double").withColumn("classification", F.lit(5)).withColumn("return_number", F.lit(1))
    terrain = points.Terrain(1.0, 60, 0.3, 0.3, 0.6)
    got = {(r.x, r.y): r.is_ground for r in points.ground_points(p, terrain).collect()}
    assert not any(got[x, y] for x in (8.0, 9.0, 10.0) for y in (8.0, 9.0, 10.0))
    assert sum(got.values()) > 350
    assert {(r.x, r.y): r.is_ground for r in points.ground_points(p, terrain, tile=6).collect()} == got
    assert kernels.cloth(np.array([[1.0]]), 3.0, 5, 1.0, 0.5).tolist() == [[1.0]]
    with pytest.raises(ValueError, match="median"):
        points.points_to_grid(p, points.extent(p), 1.0, "median")


def test_numbers_have_no_gap_on_many_rows(spark):
    """More rows than a sample of the ranges holds: every row is numbered once, in order."""
    tall = heights(spark, "/root/testdata/sf0.1").select("row", "col", "v", (-F.col("v")).alias("a"), (-F.col("row")).alias("b"), (-F.col("col")).alias("c"))
    got = vector.numbered(tall, ["a", "b", "c"]).select("row", "col", "v", F.col("__n").alias("n")).toPandas()
    want = got.sort_values(["v", "row", "col"], ascending=False)
    assert len(got) == 150000 and want.n.tolist() == list(range(150000))


def test_seeds_in_every_tile(spark):
    """Every treetop of the raster is in its own tile once and in each tile whose halo box holds it; those beyond the edge are dropped."""
    p = pixels(spark, np.zeros((50, 90)))
    tops = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0.5, 0.5), (7.5, 40.0), (8.0, 49.9), (9.9, 10.0), (75.0, 3.0), (89.9, 49.9), (90.0, 3.0), (-0.5, 3.0), (3.0, 50.0), (3.0, -30.0)])]
    got = sorted(tuple(r) for r in tiles.seed_tiles(spark.createDataFrame(tops, "tree_id long, x double, y double"), p, raster.Affine(1.0, 0.0, 1.0, 0.0), 10, 2).collect())
    want = []
    for i, x, y in tops:
        r, c = math.floor(y), math.floor(x)
        for tr in range(5):
            for tc in range(9):
                r0, c0 = max(tr * 10 - 2, 0), max(tc * 10 - 2, 0)
                if r0 <= r < min(tr * 10 + 12, 50) and c0 <= c < min(tc * 10 + 12, 90):
                    want.append((i, tr, tc, r, c, r - r0, c - c0, r // 10 == tr and c // 10 == tc))
    assert got == sorted(want)
    assert sorted(g[0] for g in got if g[7]) == [0, 1, 2, 3, 4, 5]


def test_tiles(spark):
    a = np.arange(300.0).reshape(15, 20)
    p = pixels(spark, a)
    assert np.array_equal(grid(tiles.dispatch(p, lambda t: t + 1, size=6, overlap=2), a.shape), a + 1)
    for size in (4, 7, 50):
        assert tiles.dispatch(p, lambda t: float(np.nansum(t)), "reduce", lambda x, y: x + y, size) == a.sum()
    assert tiles.dispatch(p, lambda t: None, "none", size=8) is None
    with pytest.raises(ValueError, match="overlap"):
        tiles.overlapping_tiles(p, 4, 4)
    with pytest.raises(ValueError, match="none of"):
        tiles.dispatch(p, lambda t: 1.0, "other")
    assert tiles.strategy_report(p)["partitions"] >= 1


def test_zonal_touched_and_partition_invariance(spark):
    a = np.arange(400.0).reshape(20, 20)
    p = pixels(spark, a).select("row", "col", F.array("v").alias("bands"))
    crowns = spark.createDataFrame([(1, "x", 2.0, 2.0, 8.0, 8.0), (2, "x", 4.2, 4.2, 4.4, 4.4), (3, "x", 30.0, 30.0, 31.0, 31.0), (4, "y", -3.0, -3.0, 3.0, 3.0), (1, "z", 9.0, 9.0, 12.0, 12.0)], "crown_id long, species string, minx double, miny double, maxx double, maxy double")
    got = {r.crown_id: r for r in zonal.zonal_statistics(p, crowns, 20, 20, None).collect()}
    assert set(got) == {1, 2, 4} and got[1].species == "x"
    assert got[1].n == 36 and got[1].mean == pytest.approx(a[2:8, 2:8].mean()) and got[1].sd == pytest.approx(a[2:8, 2:8].std()) and got[1].med == np.median(a[2:8, 2:8])
    assert got[2].n == 1 and got[2].min == a[4, 4] and got[4].n == 9
    for cell in (1, 3, 64):
        held = zonal.zonal_pixels(p, zonal.pixel_ranges(zonal.first_of_id(crowns), 20, 20), cell)
        assert {(r.crown_id, r["count"]) for r in held.groupBy("crown_id").count().collect()} == {(1, 36), (2, 1), (4, 9)}
    nan = p.withColumn("bands", F.array(F.lit(float("nan"))))
    assert zonal.zonal_statistics(nan, crowns, 20, 20, 0.0).count() == 0
    ring = geometry.to_wkb((3, [[(2.0, 2.0), (8.0, 2.0), (8.0, 8.0), (2.0, 8.0), (2.0, 2.0)], [(3.0, 3.0), (5.0, 3.0), (5.0, 5.0), (3.0, 5.0), (3.0, 3.0)]]))
    assert vector.zonal_polygons(p, spark.createDataFrame([(1, bytearray(ring))], "crown_id long, geom binary")).count() == 32


def test_raster_algebra(spark):
    a = np.random.default_rng(1).random((12, 16))
    p = pixels(spark, a).select("row", "col", F.array("v", F.col("v") * 2, F.lit(0.5)).alias("bands"))
    again = raster.split_bands(p).groupBy("row", "col").agg(F.array_sort(F.collect_list(F.struct("band", "v"))).alias("x")).select("row", "col", F.col("x.v").alias("bands"))
    assert again.exceptAll(p).isEmpty() and p.exceptAll(again).isEmpty()
    single = raster.get_band(p, 1)
    one = raster.Affine(1.0, 0.0, 1.0, 0.0)
    assert np.array_equal(grid(raster.crop(single, one, (0, 0, 16, 12), 16, 12), a.shape), a)
    with pytest.raises(ValueError, match="no pixel"):
        raster.crop(single, one, (40, 40, 50, 50), 16, 12)
    half = grid(raster.resample_bilinear(single, 0.5, 16, 12), (6, 8))
    assert np.allclose(half, a.reshape(6, 2, 8, 2).mean(axis=(1, 3)), atol=0.3) and abs(half.mean() - a.mean()) < 0.01
    assert np.array_equal(grid(raster.resample_nearest(single, 3, 16, 12), (36, 48)), np.repeat(np.repeat(a, 3, 0), 3, 1))
    assert np.array_equal(grid(raster.align(single, one, single, one), a.shape), a)
    with pytest.raises(NotImplementedError):
        raster.align(single, one, single, one, "union")
    with pytest.raises(KeyError):
        raster.get_band(p, "x", {"y": 1})
    with pytest.raises(IndexError):
        raster.get_band(p, 4, count=3)
    with pytest.raises(ValueError, match="grid"):
        raster.zip_rasters({"a": single, "b": single.limit(3)})
    zero = raster.spectral_index(p.withColumn("bands", F.array(F.lit(0.0), F.lit(0.0))), scalar.get_index("ndvi")[0], {"nir": 1, "red": 2})
    assert zero.where("v is not null").isEmpty()


def test_indices_and_wavelengths(spark):
    scalar.register_index("gap", "a - b", {"a": 500.0, "b": 2000.0})
    bands = spark.createDataFrame([(1, 490.0), (2, 510.0)], "band int, wavelength double")
    wanted = spark.createDataFrame(list(scalar.get_index("GAP")[1].items()), "variable string, target double")
    got = {r.variable: r.band for r in scalar.map_wavelengths(bands, wanted).collect()}
    assert got == {"a": 1, "b": None}  # a tie goes to the first band
    with pytest.raises(ValueError, match="b"):
        scalar.check_mapped(scalar.map_wavelengths(bands, wanted))
    with pytest.raises(ValueError, match="none of"):
        scalar.get_index("nothing")


def test_geometry():
    bow = geometry.to_wkb((3, [[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]))
    assert not geometry.is_valid(bow)
    fixed = geometry.from_wkb(geometry.repair(bow))
    assert geometry.is_valid(geometry.repair(bow)) and sum(abs(geometry.area(p[0])) for p in geometry.polygons(fixed)) == 2
    assert geometry.repair(geometry.to_wkb((3, [[(0, 0), (1, 0), (0, 0), (1, 0), (0, 0)]]))) is None
    point = geometry.to_wkb((1, (1.0, 2.0, 3.0)), 32619)
    assert point.hex().startswith("01010000a06b7f0000") and geometry.from_wkb(point) == (1, (1.0, 2.0, 3.0))
    assert geometry.from_wkb(struct.pack(">BI2d", 0, 1, 4.0, 5.0)) == (1, (4.0, 5.0))
    multi = (6, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]])
    assert geometry.from_wkb(geometry.to_wkb(multi)) == multi
    assert geometry.set_dimensions(geometry.set_dimensions(multi, 3), 2) == multi
    assert geometry.hull_area([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)]) == 1
    a = geometry.to_wkb((3, [[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]]))
    b = geometry.to_wkb((3, [[(1, 0), (1, 2), (3, 2), (3, 0), (1, 0)]]))
    assert similarity.polygon_iou(a, b) == pytest.approx(1 / 3) and similarity.polygon_iou(a, a) == 1


def test_similarity_limits(spark):
    box = "crown_id long, minx double, miny double, maxx double, maxy double"
    a = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 0.0, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 4.0, 4.0), (4, 0.0, 0.0, 1.0, 1.0), (5, 0.0, 0.0, 1.0, 0.0)], box)
    b = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 5.0, 5.0, 6.0, 6.0), (3, 1.0, 1.0, 2.0, 2.0), (4, 1.0, 0.0, 2.0, 1.0), (5, 0.0, 0.0, 1.0, 1.0)], box)
    got = {r.crown_id: r for r in similarity.analyze(a, b).collect()}
    assert (got[1].iou, got[1].giou, got[1].diou, got[1].ciou, got[1].dice) == pytest.approx((1, 1, 1, 1, 1))
    assert got[2].iou == 0 and got[2].giou < 0 and got[2].diou < 0 and got[2].dice == 0
    assert got[3].iou == pytest.approx(1 / 16) and got[4].iou == 0 and got[5].ciou == got[5].diou


def test_vectors(spark):
    t = spark.createDataFrame([("b", "oak", 0.0, 0.0), ("a", "elm", 0.0, 0.0), ("c", "ash", 9.0, 9.0)], "tree_id string, species string, x double, y double")
    crowns = spark.createDataFrame([(1, None, -1.0, -1.0, 1.5, 1.5), (2, "old", 40.0, 40.0, 41.0, 41.0), (3, None, -0.5, -0.5, 0.5, 0.5)], "crown_id long, species string, minx double, miny double, maxx double, maxy double")
    got = {r.crown_id: r.species for r in vector.label_crowns(crowns, t).collect()}
    assert got == {1: "elm", 2: "old", 3: "elm"}
    assert [tuple(r) for r in vector.assign_tree_ids(crowns, t).collect()] == [(1, "a")]
    with pytest.raises(KeyError):
        vector.prepare_treetops(t.drop("species"), {})
    with pytest.raises(ValueError, match="2 or 3"):
        vector.force_z(t, 4)
    same = vector.prepare_crowns(crowns.withColumn("crown_id", F.col("crown_id").cast("string")), "crown_id")
    assert {r.crown_id for r in same.collect()} == {1, 2, 3}
    ll = spark.createDataFrame([(-70.0, 45.0), (0.0, 0.0), (-69.0, -33.0)], "lon double, lat double")
    m = vector.from_web_mercator(vector.to_web_mercator(ll)).collect()
    assert all(r.lon == pytest.approx(o.lon) and r.lat == pytest.approx(o.lat, abs=1e-9) for r, o in zip(m, ll.collect(), strict=True))
    utm = vector.to_utm(ll.limit(1), 32619).first()
    assert utm.x == pytest.approx(421184.70, abs=0.05) and utm.y == pytest.approx(4983436.77, abs=0.05)
    z = vector.force_z_wkb(spark.createDataFrame([(bytearray(geometry.to_wkb((1, (1.0, 2.0)))),)], "geom binary"), 3).first()
    assert geometry.from_wkb(bytes(z.geom)) == (1, (1.0, 2.0, 0.0))


def test_store(spark, tmp_path):
    store.deploy(spark, "forest", reset=True)
    assert {r.tableName for r in spark.sql("show tables in forest").collect()} == set(store.COLUMNS)
    trees = spark.createDataFrame([("a",), ("b",)], "tree_id string")
    crowns = spark.createDataFrame([("a_MAN", "a", 1), ("b_AUT", "b", 2)], "crown_id string, tree_id string, source_lidar_id long")
    attributes = spark.createDataFrame([(1, "a_MAN"), (2, "b_AUT")], "id long, crown_id string")
    lidar = spark.createDataFrame([(1,), (2,)], "id long")
    left = store.delete_rows({"trees": trees, "crowns": crowns, "spectral_attributes": attributes, "lidar_acquisitions": lidar}, "trees", F.col("tree_id") == "a")
    assert [r.crown_id for r in left["crowns"].collect()] == ["b_AUT"] and [r.id for r in left["spectral_attributes"].collect()] == [2]
    nulled = store.delete_rows({"crowns": crowns, "lidar_acquisitions": lidar}, "lidar_acquisitions", F.col("id") == 1)
    assert {r.crown_id: r.source_lidar_id for r in nulled["crowns"].collect()} == {"a_MAN": None, "b_AUT": 2}
    ids = [r.id for r in store.with_ids(trees, lidar).collect()]
    assert len(set(ids)) == 2 and min(ids) > 2
    with pytest.raises(ValueError, match="DB_USER"):
        store.jdbc_options(env={})
    assert store.jdbc_options(env={"DB_USER": "u", "DB_PASSWORD": "p"})["url"] == "jdbc:postgresql://localhost:5432/forest"
    bad = spark.createDataFrame([("{\"a\": 1.5}",), ("no json",), (None,)], "metrics string")
    assert [r[0] for r in bad.select(store.metric(bad, "$.a")).collect()] == [1.5, None, None]


def test_sources(spark, tmp_path):
    from silvaspark.sources import io

    a = np.random.default_rng(2).random((3, 10, 7)).astype("<f4")
    a[0, 2, 2] = -1
    for order, axes in (("bsq", (0, 1, 2)), ("bil", (1, 0, 2)), ("bip", (1, 2, 0))):
        a.transpose(axes).tofile(tmp_path / f"{order}.dat")
        (tmp_path / f"{order}.hdr").write_text(f"ENVI\nsamples = 7\nlines = 10\nbands = 3\nheader offset = 0\ndata type = 4\ninterleave = {order}\nbyte order = 0\ndata ignore value = -1\nwavelength = {{ 450, 550,\n 650 }}\n")
        got = {(r.row, r.col): r.bands for r in io.read_envi(spark, str(tmp_path / f"{order}.hdr"), 4).collect()}
        assert len(got) == 70 and got[2, 2][0] is None and got[9, 6] == pytest.approx(a[:, 9, 6].tolist())
    io.write_envi(io.read_envi(spark, str(tmp_path / "bsq.hdr")), str(tmp_path / "again"), 7, 10, 3)
    back = io.as_dataframe(spark, str(tmp_path / "again.hdr"))
    assert back.exceptAll(io.read_envi(spark, str(tmp_path / "bsq.hdr"))).isEmpty()
    assert io.envi_header((tmp_path / "bsq.hdr").read_text())["wavelength"] == ["450", "550", "650"]

    record = struct.pack("<3iHBBbBH", 150, 250, 1234, 0, 0b010001, 2, 0, 0, 0)
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, 3)
    struct.pack_into("<3d", head, 131, 0.01, 0.01, 0.001)
    (tmp_path / "p.las").write_bytes(bytes(head) + record * 3)
    got = io.as_dataframe(spark, str(tmp_path / "p.las")).collect()
    assert len(got) == 3 and (got[0].x, got[0].y, got[0].z, got[0].classification, got[0].return_number) == pytest.approx((1.5, 2.5, 1.234, 2, 1))
    with pytest.raises(FileNotFoundError):
        io.read_las(spark, str(tmp_path / "none.las"))

    layer = spark.createDataFrame([(1, bytearray(geometry.to_wkb((3, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]])))), (2, None)], "id long, geom binary")
    io.write_vector(layer, str(tmp_path / "v.geojson"))
    back = io.as_dataframe(spark, str(tmp_path / "v.geojson"))
    assert {r.properties for r in back.collect()} == {'{"id":1}', '{"id":2}'} and back.where("geom is null").count() == 1
    (tmp_path / "fc.json").write_text('{"type": "FeatureCollection",\n "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"a": 1}}]}')
    one = io.as_dataframe(spark, str(tmp_path / "fc.json")).collect()
    assert geometry.from_wkb(bytes(one[0].geom)) == (1, (1.0, 2.0))


def test_streaming(spark, tmp_path):
    from silvaspark.streaming import events

    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    events.ingest(spark, str(tmp_path / "in"), source.schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.count()
    stream = events.counts(events.acquisitions(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))))
    run = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    want = events.counts(events.acquisitions(source)).withColumn("window_start", F.col("window_start").cast("timestamp"))
    assert spark.table("hourly").exceptAll(want).isEmpty() and spark.table("hourly").count() == want.count()


def test_surfaces(spark):
    p = spark.createDataFrame([(0.0, 0.0, 1.0, 2, 1), (0.5, 0.5, 9.0, 5, 1), (1.5, 0.5, 4.0, 5, 1), (2.0, 2.0, 3.0, 2, 1)], "x double, y double, z double, classification int, return_number int")
    s = points.surfaces(p, points.extent(p), 1.0)
    assert {(r.row, r.col): (r.dsm, r.dtm) for r in s.collect()} == {(1, 0): (9.0, None), (1, 1): (4.0, None)}
    box = {"min_x": 0.0, "max_x": 3.0, "min_y": -1.0, "max_y": 2.0}
    assert {(r.row, r.col): r.v for r in points.chm(points.surfaces(p, box, 1.0)).collect()} == {(0, 2): 0.0, (2, 0): 0.0}
    assert points.is_classified(p).first()[0] and not points.is_classified(p.limit(0)).first()[0]
    assert math.isclose(points.dense(points.points_to_grid(p, box, 1.0), 3, 3, -1.0).agg(F.sum("v")).first()[0], 12.0)
    assert points.search_radius(1.0, True) == 35 and points.search_radius(10.0, False) == 10
    assert isinstance(points.extent(p.limit(0)), dict) and points.ground_points(p.limit(0)).count() == 0
    assert pd.Series(dtype=float).empty


def test_dense_moves_only_cells(spark, monkeypatch):
    monkeypatch.setattr(points, "STRIP", 3)
    cells = [(0, 0, 1.0), (0, 6, 2.0), (0, 6, 3.0), (2, 2, None), (2, 3, 4.0), (5, 0, 9.0), (0, 7, 9.0), (-1, 0, 9.0)]
    out = points.dense(spark.createDataFrame(cells, "row int, col int, v double"), 7, 4, -1.0)
    held = {}
    for r, c, v in cells:
        held.setdefault((r, c), []).append(-1.0 if v is None else v)
    wanted = sorted((r, c, v) for r in range(4) for c in range(7) for v in held.get((r, c), [-1.0]))
    assert sorted(map(tuple, out.collect())) == wanted
    assert out.columns == ["row", "col", "v"]
    assert points.dense(spark.createDataFrame([], "row int, col int, v double"), 0, 0).count() == 0
    # cells without a point are made after the exchange
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange") and "Join" not in plan


def test_cloth_rows_that_are_needed(monkeypatch):
    monkeypatch.setattr(kernels, "STRIP", 3)
    rng = np.random.default_rng(5)
    a = np.where(rng.random((23, 9)) < 0.3, rng.normal(50, 20, (23, 9)), np.nan)
    floor, c = np.where(np.isnan(a), -np.inf, a), np.full(a.shape, 90.0)
    for _ in range(6):
        c = np.maximum(c - 0.5, floor)
        near = [[c[y, x] for y, x in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= y < 23 and 0 <= x < 9] for i in range(23) for j in range(9)]
        mean = np.array([sum(n) / len(n) for n in near]).reshape(a.shape)
        c = np.clip(c, mean - 0.1, mean + 0.1)
    assert np.allclose(kernels.cloth(a, 90.0, 6, 0.5, 0.1), c, rtol=0, atol=1e-12)
    assert np.array_equal(kernels.cloth(a, 90.0, 6, 0.5, 0.1, (9, 14))[9:14], kernels.cloth(a, 90.0, 6, 0.5, 0.1)[9:14])
    assert kernels.cloth(np.array([[np.nan]]), 9.0, 4, 0.5, 0.1)[0, 0] == 7.0
