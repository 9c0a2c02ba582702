"""Surface models, warping, polygon zones and loaders against plain NumPy and closed forms."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaspark.functions import crs, geometry, kernels, scalar
from silvaspark.operators import focal, points, raster, store, surface, tiles, vector, warp


def table(spark, a, name="v"):
    rows = [(r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1]) if not np.isnan(a[r, c])]
    return spark.createDataFrame(rows, f"row int, col int, {name} double")


def array(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r.row, r.col] = r[name]
    return out


def cloud(rng, n=900, side=24.0):
    """A slope with trees, a gap, and ground points here and there."""
    x, y = rng.uniform(0, side, n), rng.uniform(0, side, n)
    gap = (np.abs(x - 9) < 2.2) & (np.abs(y - 12) < 2.2)
    x, y = x[~gap], y[~gap]
    ground = 0.1 * x
    high = rng.random(len(x)) < 0.6
    return x, y, ground + np.where(high, 3 + 5 * rng.random(len(x)), 0), np.where(high, 5, 2)


def raw(x, y, z, use, res, box, pick):
    w, h = int((box[1] - box[0]) / res), int((box[3] - box[2]) / res)
    out = np.full((h, w), np.nan)
    for px, py, pz in zip(x[use], y[use], z[use], strict=True):
        c, r = int((px - box[0]) / res), int((box[3] - py) / res)
        if r < h and c < w:
            out[r, c] = pz if np.isnan(out[r, c]) else pick(out[r, c], pz)
    return out


def strict_footprint(valid):
    """5 x 5 closing in a frame of nothing, then holes that the outside does not reach."""
    p = np.pad(valid, 2)
    grown = np.array([[p[r : r + 5, c : c + 5].any() for c in range(valid.shape[1])] for r in range(valid.shape[0])])
    p = np.pad(grown, 2)
    closed = np.array([[p[r : r + 5, c : c + 5].all() for c in range(valid.shape[1])] for r in range(valid.shape[0])])
    out, todo = set(), [(r, c) for r in range(valid.shape[0]) for c in range(valid.shape[1]) if (r in (0, valid.shape[0] - 1) or c in (0, valid.shape[1] - 1)) and not closed[r, c]]
    while todo:
        r, c = todo.pop()
        if (r, c) not in out and 0 <= r < valid.shape[0] and 0 <= c < valid.shape[1] and not closed[r, c]:
            out.add((r, c))
            todo += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
    return np.array([[(r, c) not in out for c in range(valid.shape[1])] for r in range(valid.shape[0])])


@pytest.mark.parametrize("tile", [512, 7])
def test_models_of_a_cloud(spark, monkeypatch, tile):
    monkeypatch.setattr(surface, "TILE", tile)
    x, y, z, k = cloud(np.random.default_rng(1))
    p = spark.createDataFrame([(float(a), float(b), float(c), int(d)) for a, b, c, d in zip(x, y, z, k, strict=True)] + [(None, 1.0, 2.0, 2), (1.0, float("nan"), 2.0, 2)], "x double, y double, z double, classification int")
    box = (x.min(), x.max(), y.min(), y.max())
    dsm, dtm = raw(x, y, z, k > 0, 1.0, box, max), raw(x, y, z, k == 2, 1.0, box, min)
    d, t, inside = kernels.fill(dsm, 20), kernels.fill(dtm, 35), strict_footprint(~np.isnan(dsm))
    assert np.isnan(dsm).any() and inside.any() and not inside.all()
    same = lambda a, b: np.allclose(a, b, equal_nan=True)
    assert same(array(surface.generate_dtm(p, 1.0), dsm.shape), t)
    assert same(array(surface.generate_dsm(p, 1.0), dsm.shape), np.where(inside, d, np.nan))
    chm = np.maximum(d - t, 0)
    views = np.lib.stride_tricks.sliding_window_view(np.pad(chm, 1, mode="symmetric"), (3, 3))
    assert same(array(surface.generate_chm(p, 1.0), dsm.shape), np.where(inside, np.median(views, axis=(2, 3)), np.nan))
    assert same(array(surface.generate_chm(p, 1.0, filter_size=0), dsm.shape), np.where(inside, chm, np.nan))


def test_models_without_classes_use_the_cloth(spark):
    x, y, z, k = cloud(np.random.default_rng(2))
    rows = [(float(a), float(b), float(c), 1, bool(d == 2)) for a, b, c, d in zip(x, y, z, k, strict=True)]
    p = spark.createDataFrame(rows, "x double, y double, z double, classification int, truth boolean")
    found = points.ground_points(p, points.TerrainType.RELIEF.value)
    box = points.extent(p)
    want = array(points.surfaces(found, box, 1.0, F.col("is_ground")).select("row", "col", F.col("dtm").alias("v")), (23, 23))
    got = array(surface.generate_dtm(p, 1.0), (23, 23))
    assert np.allclose(got[~np.isnan(want)], want[~np.isnan(want)])
    chm = array(surface.generate_chm(p, 1.0), (23, 23))
    assert np.nanmin(chm) >= 0 and 3 < np.nanmax(chm) < 9
    for make in (surface.generate_dtm, surface.generate_dsm, surface.generate_chm):
        assert make(p.limit(0), 1.0).count() == 0


def test_points_without_coordinates_stay(spark):
    rows = [(0.75 * i, 0.75 * j, 0.0, 1) for i in range(9) for j in range(5)] + [(None, 1.0, 0.0, 1), (1.0, 1.0, float("nan"), 1)]
    got = points.ground_points(spark.createDataFrame(rows, "x double, y double, z double, classification int")).collect()
    assert len(got) == len(rows) and sum(r.is_ground for r in got) == 45


def test_median_and_closing_with_gaps(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(17, 13))
    a[rng.random(a.shape) < 0.3] = np.nan
    for k in (3, 5):
        views = np.lib.stride_tricks.sliding_window_view(np.pad(a, k // 2, mode="symmetric"), (k, k)).reshape(*a.shape, -1)
        want = np.where(np.isnan(a), np.nan, np.nanmedian(views, axis=2))
        assert np.allclose(array(focal.median(table(spark, a), 13, 17, k, 6), a.shape), want, equal_nan=True)
        whole = array(focal.grey_closing(table(spark, a), k, 64), a.shape)
        assert np.allclose(array(focal.grey_closing(table(spark, a), k, 6), a.shape), whole, equal_nan=True)


def test_coordinates_there_and_back(spark):
    """The length of the meridian, equal scale in all directions, and every system to every other and back."""
    phi, e2 = np.radians(np.linspace(0, 45.5, 100001)), crs.FLATTENING * (2 - crs.FLATTENING)
    arc = crs.RADIUS * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    length = float(((arc[1:] + arc[:-1]) / 2).sum() * (phi[1] - phi[0]))
    assert crs.transform(-69.0, 45.5, 4326, 32619, crs.NUMBERS) == pytest.approx((500000.0, 0.9996 * length), abs=1e-4)
    (x, y), (xe, ye), (xn, yn) = (crs.transform(-67.2 + a, 45.5 + b, 4326, 32619, crs.NUMBERS) for a, b in ((0, 0), (1e-5, 0), (0, 1e-5)))
    east = crs.RADIUS / math.sqrt(1 - e2 * math.sin(math.radians(45.5)) ** 2) * math.cos(math.radians(45.5))
    north = crs.RADIUS * (1 - e2) / (1 - e2 * math.sin(math.radians(45.5)) ** 2) ** 1.5
    assert math.hypot(xe - x, ye - y) / east == pytest.approx(math.hypot(xn - x, yn - y) / north, rel=1e-6)
    assert crs.transform(-69.0, 0.0, 4326, 32619, crs.NUMBERS) == pytest.approx((500000.0, 0.0), abs=1e-6)
    lon, lat = np.array([-70.3, -68.9, -66.1]), np.array([-12.0, 47.2, 60.9])
    for a in (4326, 3857, 32619, 32719):
        there = crs.transform(lon, lat, 4326, a, crs.ARRAYS)
        for b in (4326, 3857, 32619):
            back = crs.transform(*crs.transform(*there, a, b, crs.ARRAYS), b, 4326, crs.ARRAYS)
            assert np.allclose(back, (lon, lat), atol=1e-9)
    layer = spark.createDataFrame([(float(p), float(q)) for p, q in zip(lon, lat, strict=True)], "x double, y double")
    got = [(r.x, r.y) for r in vector.to_crs(layer, 4326, 32619).collect()]
    assert np.allclose(np.array(got).T, crs.transform(lon, lat, 4326, 32619, crs.ARRAYS))
    shape = geometry.to_wkb((3, [[(-69.0, 45.0, 7.0), (-68.0, 45.0, 7.0), (-68.0, 46.0, 7.0), (-69.0, 45.0, 7.0)]]))
    moved = vector.to_crs_wkb(spark.createDataFrame([(bytearray(shape),), (None,)], "geom binary"), 4326, 32619).collect()
    assert geometry.from_wkb(bytes(moved[0].geom))[1][0][1] == pytest.approx((*crs.transform(-68.0, 45.0, 4326, 32619, crs.NUMBERS), 7.0)) and moved[1].geom is None
    with pytest.raises(ValueError, match="27700"):
        crs.transform(0.0, 0.0, 4326, 27700, crs.NUMBERS)


def test_warping_against_plain_loops(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(12, 15))
    a[3:5, 6:9] = np.nan
    own = raster.Affine(0.5, 10.0, -0.5, 50.0)
    for how in ("bilinear", "nearest"):
        out, to, w, h = warp.reproject(table(spark, a), own, 15, 12, 4326, 3857, resampling=how)
        got, want = array(out, (h, w)), np.full((h, w), np.nan)
        assert out.count() == w * h and abs(w / h - 15 / 12 * math.cos(math.radians(47))) < 0.1
        for r in range(h):
            for c in range(w):
                lon, lat = crs.transform(to.a * (c + 0.5) + to.c, to.e * (r + 0.5) + to.f, 3857, 4326, crs.NUMBERS)
                x, y = (lon - 10) / 0.5, (lat - 50) / -0.5
                if not (0 <= x < 15 and 0 <= y < 12):
                    continue
                if how == "nearest":
                    want[r, c] = a[int(y), int(x)]
                    continue
                near = [(i, j, (1 - abs(i + 0.5 - y)) * (1 - abs(j + 0.5 - x))) for i in (math.floor(y - 0.5), math.floor(y - 0.5) + 1) for j in (math.floor(x - 0.5), math.floor(x - 0.5) + 1)]
                near = [(a[i, j], q) for i, j, q in near if 0 <= i < 12 and 0 <= j < 15 and q > 0 and not np.isnan(a[i, j])]
                want[r, c] = sum(v * q for v, q in near) / sum(q for _, q in near) if near else np.nan
        assert np.allclose(got, want, equal_nan=True), how
    _, to, w, h = warp.reproject(table(spark, a), own, 15, 12, 4326, 3857, resolution=100000.0)
    assert to.a == 100000.0 and (w, h) == (8, 10)
    same = warp.align(table(spark, a), own, 15, 12, table(spark, np.zeros(a.shape)), own)
    assert np.allclose(array(same, a.shape), a, equal_nan=True)
    with pytest.raises(ValueError, match="cubic"):
        warp.reproject(table(spark, a), own, 15, 12, 4326, 3857, resampling="cubic")


def test_small_polygons_have_all_pixels_that_they_touch(spark):
    pixels = tiles.kept(warp.grid(spark, 10, 8).withColumn("v", F.lit(1.0)))
    ring = lambda *ps: bytearray(geometry.to_wkb((3, [[*ps, ps[0]]])))
    shapes = [
        (1, ring((2.1, 2.1), (2.4, 2.1), (2.4, 2.4), (2.1, 2.4))),  # within one pixel, off its centre
        (2, ring((0.9, 0.9), (2.6, 1.1), (2.5, 2.6))),  # window of two
        (3, ring((1.0, 1.0), (7.0, 1.0), (7.0, 6.0), (1.0, 6.0))),  # by centres
        (4, ring((3.45, 0.2), (9.05, 5.8), (9.1, 5.75), (3.5, 0.15))),  # a sliver without a centre
        (5, ring((20.0, 20.0), (24.0, 20.0), (24.0, 24.0))),  # outside
        (6, ring((-3.0, -3.0), (1.6, -3.0), (1.6, 1.6), (-3.0, 1.6))),  # cut by the raster's edge
        (7, None),
    ]
    df = spark.createDataFrame(shapes, "crown_id long, geom binary")
    held = {}
    for r in vector.zonal_polygons(pixels, df, 10, 8).collect():
        held.setdefault(r.crown_id, set()).add((r.row, r.col))
    assert held[1] == {(2, 2)} and held[3] == {(r, c) for r in range(1, 6) for c in range(1, 7)}
    assert held[2] == {(0, 0), (0, 1), (1, 0), (1, 1)}  # its window begins at its box's first pixel and is two wide
    assert len(held[4]) > 6 and 5 not in held and 7 not in held and held[6] == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_wavelengths_whatever_follows_the_unit(spark):
    names = ["850nm_red", "band 655.5 nm", "447 NANOMETERS", "12 nanometer", "nm", "B4"]
    got = [r.w for r in spark.createDataFrame([(n,) for n in names], "n string").select(scalar.wavelength(F.col("n")).alias("w")).collect()]
    assert got == [850.0, 655.5, 447.0, 12.0, -1.0, -1.0]


def test_loaders_reproject_and_pack(spark, tmp_path):
    layer = spark.createDataFrame([("t1", "oak", -69.0, 45.0), ("t2", None, -68.0, 46.0)], "tree_id string, species string, x double, y double")
    rows = store.load_trees(layer, {}, 32619, 4326, ewkb=True).orderBy("tree_id").collect()
    assert (rows[0].x, rows[0].y) == pytest.approx(crs.transform(-69.0, 45.0, 4326, 32619, crs.NUMBERS)) and rows[0].srid == 32619
    assert bytes(rows[0].geom)[:9] == geometry.to_wkb((1, (0.0, 0.0, 0.0)), 32619)[:9]
    assert geometry.from_wkb(bytes(rows[0].geom))[1] == pytest.approx((rows[0].x, rows[0].y, 0.0))
    crown = bytearray(geometry.to_wkb((3, [[(0.0, 0.0, 5.0), (4.0, 0.0, 5.0), (4.0, 4.0, 5.0), (0.0, 0.0, 5.0)]])))
    layer = spark.createDataFrame([(1, None, 0.0, 0.0, 4.0, 4.0, crown), (2, "t9", 50.0, 50.0, 51.0, 51.0, crown)], "crown_id long, tree_id string, minx double, miny double, maxx double, maxy double, geom binary")
    trees = spark.createDataFrame([("t5", 2.0, 1.0)], "tree_id string, x double, y double")
    got = {r.crown_id: r for r in store.load_crowns(layer, "Manual", trees=trees, stamp="20240101").collect()}
    assert set(got) == {"t5_MAN", "t9_MAN"}
    assert bytes(got["t5_MAN"].geom) == geometry.to_wkb((3, [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]]), 32619)
    with pytest.raises(KeyError):
        store.load_crowns(layer.drop("tree_id"), "Automated")
    path = f"file://{tmp_path}/trees"
    assert store.append(trees, path) == 1 and store.append(trees.unionAll(trees), path, 1) == 2
    clouds = spark.createDataFrame([("2024-01-01 00:00:00", "drone")], "acquisition_datetime string, sensor_type string")
    lidar = store.register_lidar(clouds)
    assert set(lidar.columns) == set(store.schema("lidar_acquisitions").names) and lidar.collect() == lidar.collect()
    bad = spark.createDataFrame([(1, bytearray(geometry.to_wkb((3, [[(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]))))], "id long, geom binary")
    with pytest.raises(ValueError, match="valid"):
        vector.prepare_crowns(bad, "id", do_validate=True)


@pytest.mark.parametrize("gate", [False, True])
def test_gaps_that_hold_whole_tiles(spark, gate):
    """A ring round tiles without a cell: they are one gap with what is round them, open only through a gate."""
    valid = np.zeros((64, 72), bool)
    valid[9:55, 9:60] = True
    valid[12:52, 12:57] = False
    valid[30:33, 30:33] = True
    if gate:
        valid[20:30, 57:60] = False
    size, halo = 8, 4
    places = spark.createDataFrame([(int(r), int(c)) for r, c in zip(*np.nonzero(valid), strict=True)], "row int, col int")
    found = {(r.tile_r, r.tile_c, r.label) for r in focal.open_gaps(places, 72, 64, size, halo).collect()}
    covered, tiles_there = strict_footprint(valid), 0
    for r in range(0, 64, size):
        for c in range(0, 72, size):
            near = valid[max(0, r - halo) : r + size + halo, max(0, c - halo) : c + size + halo]
            if not near.any():
                continue
            tiles_there += 1
            core = np.zeros(near.shape, bool)
            y, x = r - max(0, r - halo), c - max(0, c - halo)
            core[y : y + size, x : x + size] = True
            closed, *_ = focal.closed_core(near, max(0, r - halo), max(0, c - halo), core, 72, 64)
            labels = kernels.components(~closed)
            out = [label for t, u, label in found if (t, u) == (r // size, c // size)]
            assert np.array_equal(closed | ~np.isin(labels, out), covered[r : r + size, c : c + size])
    assert tiles_there < 72 and covered[40, 20] != gate


def test_many_polygons_are_cut_as_each_alone():
    rng, geoms = np.random.default_rng(3), []
    for i in range(200):
        x, y, s = rng.integers(-10, 70) / 2, rng.integers(-10, 70) / 2, rng.choice([0.05, 0.3, 1.03, 5.03])
        p = [(x + s * rng.normal(), y + s * rng.normal()) for _ in range(5)]
        ring = [(x - s, y), (x, y - s), (x + s, y), (x, y + s), (x - s, y)] if i % 2 else [*p, p[0]]
        geoms.append(geometry.to_wkb((3, [ring])) if i % 7 else geometry.to_wkb((6, [[ring]])))
    for limit in (1 << 20, 30):
        which, rows, cols = geometry.many_window_pixels(geoms, 30, 30, limit)
        for i, g in enumerate(geoms):
            r, c = geometry.window_pixels(geometry.from_wkb(g), 30, 30)
            assert sorted(zip(rows[which == i], cols[which == i], strict=True)) == sorted(zip(r, c, strict=True))


def test_outlines_of_labels_that_batches_cut(spark):
    at = [(i, 2 * i + r, c) for i in range(40) for r in range(2) for c in range(3)] + [(7, 500, 0)]
    labels = spark.createDataFrame(at, "tree_id long, row int, col int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        found = sorted((r.tree_id, len(r.ring), r.ring[0]) for r in focal.label_polygons(labels).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == sorted([(i, 11, [2.0 * i, 0.0]) for i in range(40)] + [(7, 5, [500.0, 0.0])])
    plan = focal.label_polygons(labels)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan


def test_crowns_of_one_file_are_dealt_before_the_join(spark):
    box = "crown_id long, minx double, miny double, maxx double, maxy double"
    crowns = spark.createDataFrame([(i, i - 1.0, -1.0, i + 1.0, 1.0) for i in range(50)], box).coalesce(1)
    trees = spark.createDataFrame([(str(i), float(i), 0.0) for i in range(50)], "tree_id string, x double, y double")
    out = vector.assign_tree_ids(crowns, trees)
    assert "RoundRobinPartitioning" in out._jdf.queryExecution().executedPlan().toString()
    inside = {i: min(str(j) for j in range(50) if abs(i - j) <= 1) for i in range(50)}
    wanted = {t: min(i for i in inside if inside[i] == t) for t in inside.values()}
    assert {r.tree_id: r.crown_id for r in out.collect()} == wanted
