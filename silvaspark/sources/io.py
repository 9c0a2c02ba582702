"""Readers and writers: pixel and point tables as Parquet, vectors as Parquet or GeoJSON, ENVI rasters, LAS point clouds."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.functions import geometry

#: ENVI data type numbers.
ENVI_TYPES = {1: "u1", 2: "i2", 3: "i4", 4: "f4", 5: "f8", 12: "u2", 13: "u4", 14: "i8", 15: "u8"}


def as_dataframe(spark: SparkSession, source: DataFrame | str, **options) -> DataFrame:
    """A DataFrame as it is, a path through the reader of its kind."""
    if isinstance(source, DataFrame):
        return source
    ending = os.path.splitext(source)[1].lower()
    if ending in (".geojson", ".json"):
        return read_geojson(spark, source)
    if ending == ".las":
        return read_las(spark, source)
    if ending == ".hdr" or os.path.exists(os.path.splitext(source)[0] + ".hdr"):
        return read_envi(spark, source, **options)
    return spark.read.parquet(source)


def write_pixels(pixels: DataFrame, path: str, partition_by: str | None = "raster_id", mode: str = "error") -> None:
    writer = pixels.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by and partition_by in pixels.columns else writer).parquet(path)


def write_vector(layer: DataFrame, path: str, mode: str = "error") -> None:
    if path.lower().endswith((".geojson", ".json")):
        attributes = [c for c in layer.columns if c not in ("geom", "srid")]

        def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shapes = [_geojson(g) if g is not None else "null" for g in batch.column(0).to_pylist()]
                lines = [f'{{"type":"Feature","geometry":{g},"properties":{p}}}' for g, p in zip(shapes, batch.column(1).to_pylist(), strict=True)]
                yield pa.record_batch([pa.array(lines, pa.string())], names=["value"])

        shown = layer.select("geom", F.to_json(F.struct(*attributes)).alias("p"))
        shown.mapInArrow(text, "value string").write.mode(mode).text(path)
    else:
        layer.write.mode(mode).parquet(path)


def _geojson(data: bytes) -> str:
    import json

    kind, coordinates = geometry.from_wkb(data)
    return json.dumps({"type": {1: "Point", 3: "Polygon", 6: "MultiPolygon"}[kind], "coordinates": coordinates})


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features as ``geom`` (WKB) and their properties as JSON text in ``properties``.

    Files with one feature a line are read in parallel; a feature collection is one document and is exploded.
    """
    schema = "type string, geometry string, properties string, features array<struct<type: string, geometry: string, properties: string>>"
    lines = spark.read.schema(schema).json(path)
    if lines.where("type is not null").isEmpty():
        lines = spark.read.schema(schema).option("multiLine", "true").json(path)
    each = lines.select(F.explode(F.when(F.col("features").isNotNull(), F.transform("features", lambda f: F.struct(f["geometry"].alias("g"), f["properties"].alias("p")))).otherwise(F.array(F.struct(F.col("geometry").alias("g"), F.col("properties").alias("p"))))).alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        def wkb(text: str | None) -> bytes | None:
            g = json.loads(text) if text else None
            if not g:
                return None
            deep = lambda c: tuple(map(float, c)) if not isinstance(c[0], list) else [deep(x) for x in c]
            return geometry.to_wkb(({"Point": 1, "Polygon": 3, "MultiPolygon": 6}[g["type"]], deep(g["coordinates"])))

        for batch in batches:
            yield pa.record_batch([pa.array([wkb(t) for t in batch.column(0).to_pylist()], pa.binary()), batch.column(1)], names=["geom", "properties"])

    return each.select("f.g", "f.p").mapInArrow(run, "geom binary, properties string")


def envi_header(text: str) -> dict:
    """Fields of an ENVI header; lists in braces become lists."""
    out = {}
    for m in re.finditer(r"^\s*([^=\n]+?)\s*=\s*(\{[^}]*\}|[^\n]*)", text, re.M):
        value = m[2].strip()
        out[m[1].lower()] = [v.strip() for v in value[1:-1].split(",")] if value.startswith("{") else value
    return out


def envi_binary(path: str) -> str:
    """The data file beside a header: the same name without ``.hdr``, bare or with a usual ending."""
    if not path.lower().endswith(".hdr"):
        return path
    stem = path[:-4]
    return next((p for p in (stem, *(f"{stem}.{e}" for e in ("dat", "bin", "img", "raw", "bsq", "bil", "bip"))) if os.path.exists(p)), path)


def read_envi(spark: SparkSession, path: str, rows_per_task: int = 256) -> DataFrame:
    """``row, col, bands`` of an ENVI raster in a folder that all machines see; tasks map their own rows of the file."""
    data = envi_binary(path)
    header = path if path.lower().endswith(".hdr") else next(p for p in (path + ".hdr", os.path.splitext(path)[0] + ".hdr") if os.path.exists(p))
    if not os.path.exists(data):
        raise FileNotFoundError(data)
    with open(header, encoding="latin-1") as f:
        h = envi_header(f.read())
    height, width, count = int(h["lines"]), int(h["samples"]), int(h["bands"])
    dtype = np.dtype(("<" if int(h.get("byte order", 0)) == 0 else ">") + ENVI_TYPES[int(h["data type"])])
    order = h.get("interleave", "bsq").lower()
    shape, axes = {"bsq": ((count, height, width), (1, 2, 0)), "bil": ((height, count, width), (0, 2, 1)), "bip": ((height, width, count), (0, 1, 2))}[order]
    offset, ignore = int(h.get("header offset", 0)), h.get("data ignore value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = np.memmap(data, dtype, "r", offset, shape).transpose(axes)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                part = np.asarray(image[first * rows_per_task : (first + 1) * rows_per_task], float)
                if ignore is not None:
                    part = np.where(part == float(ignore), np.nan, part)
                n = part.shape[0] * width
                r, c = np.divmod(np.arange(n), width)
                flat = pa.array(part.reshape(-1), pa.float64(), from_pandas=True)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * count, count), pa.int32()), flat)
                yield pa.record_batch([pa.array(r + first * rows_per_task, pa.int32()), pa.array(c, pa.int32()), bands], names=["row", "col", "bands"])

    tasks = -(-height // rows_per_task)
    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "row int, col int, bands array<double>")


def write_envi(pixels: DataFrame, path: str, width: int, height: int, count: int, nodata: float = -9999.0) -> None:
    """A float64 BIP file with header; partitions write their own pixels in place."""
    with open(path, "wb") as f:
        f.truncate(width * height * count * 8)
    with open(path + ".hdr", "w") as f:
        f.write(f"ENVI\nsamples = {width}\nlines = {height}\nbands = {count}\nheader offset = 0\ndata type = 5\ninterleave = bip\nbyte order = 0\ndata ignore value = {nodata}\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image = np.memmap(path, "<f8", "r+", 0, (height, width, count))
        n = 0
        for batch in batches:
            values = np.array([[nodata if v is None else v for v in b] for b in batch.column(2).to_pylist()])
            if len(values):
                image[batch.column(0).to_numpy(), batch.column(1).to_numpy()] = values
            n += batch.num_rows
        image.flush()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    pixels.select("row", "col", "bands").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def las_header(data: bytes) -> dict:
    """What reading points needs of a LAS header (versions 1.0 to 1.4)."""
    if data[:4] != b"LASF":
        raise ValueError("no LAS file")
    offset, = struct.unpack_from("<I", data, 96)
    kind, size, n = struct.unpack_from("<BHI", data, 104)
    if data[25] >= 4:
        n = struct.unpack_from("<Q", data, 247)[0] or n
    if kind & 0x80:
        raise ValueError("compressed points cannot be read: no decoder is at hand")
    scale, shift = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    max_x, min_x, max_y, min_y, max_z, min_z = struct.unpack_from("<6d", data, 179)
    return {"offset": offset, "kind": kind, "size": size, "n": n, "scale": scale, "shift": shift, "min_x": min_x, "max_x": max_x, "min_y": min_y, "max_y": max_y, "min_z": min_z, "max_z": max_z}


def read_las(spark: SparkSession, path: str, points_per_task: int = 1_000_000) -> DataFrame:
    """``x, y, z, classification, return_number`` of an uncompressed LAS file in a folder that all machines see."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, "rb") as f:
        h = las_header(f.read(375))
    new = h["kind"] >= 6
    record = np.dtype({"names": ["x", "y", "z", "returns", "class"], "formats": ["<i4", "<i4", "<i4", "u1", "u1"], "offsets": [0, 4, 8, 14, 16 if new else 15], "itemsize": h["size"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.memmap(path, record, "r", h["offset"], (h["n"],))
        for batch in batches:
            for k in batch.column(0).to_pylist():
                p = every[k * points_per_task : (k + 1) * points_per_task]
                xyz = [pa.array(p[a] * h["scale"][i] + h["shift"][i]) for i, a in enumerate("xyz")]
                cls, ret = p["class"] & (0xFF if new else 0x1F), p["returns"] & (0x0F if new else 0x07)
                yield pa.record_batch([*xyz, pa.array(cls.astype("i2")), pa.array(ret.astype("i2"))], names=["x", "y", "z", "classification", "return_number"])

    tasks = max(1, -(-h["n"] // points_per_task))
    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "x double, y double, z double, classification short, return_number short")
