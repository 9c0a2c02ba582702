"""The relational store: seven tables, constraint checks, loaders, acquisitions, metrics as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from silvaspark.functions import geometry
from silvaspark.operators.tiles import kept
from silvaspark.operators.vector import assign_tree_ids, prepare_treetops, to_crs

#: Columns of the tables; NOT NULL as a store would enforce it.
COLUMNS: dict[str, str] = {
    "trees": "objectid bigint not null, tree_id string not null, species string, status string, geom binary, srid int, created_at timestamp",
    "lidar_acquisitions": "id bigint not null, acquisition_datetime timestamp not null, sensor_type string, point_density_m2 double, number_of_returns int",
    "image_acquisitions": "id bigint not null, acquisition_datetime timestamp not null, sensor_type string, gsd_cm double",
    "image_bands": "id bigint not null, image_id bigint not null, band_index int not null, wavelength_nm double not null, band_name string",
    "crowns": "crown_id string not null, tree_id string not null, crown_category string not null, generation_method string, source_lidar_id bigint, source_image_id bigint, geom binary, srid int, created_at timestamp",
    "spectral_attributes": "id bigint not null, crown_id string not null, image_id bigint, metrics string not null, extracted_at timestamp",
    "structural_attributes": "id bigint not null, crown_id string not null, lidar_id bigint, metrics string not null, extracted_at timestamp",
}

#: (table, column, parent table, parent column, what happens to children: cascade or set null)
FOREIGN_KEYS = [
    ("crowns", "tree_id", "trees", "tree_id", "cascade"),
    ("crowns", "source_lidar_id", "lidar_acquisitions", "id", "set null"),
    ("crowns", "source_image_id", "image_acquisitions", "id", "set null"),
    ("image_bands", "image_id", "image_acquisitions", "id", "cascade"),
    ("spectral_attributes", "crown_id", "crowns", "crown_id", "cascade"),
    ("spectral_attributes", "image_id", "image_acquisitions", "id", "set null"),
    ("structural_attributes", "crown_id", "crowns", "crown_id", "cascade"),
    ("structural_attributes", "lidar_id", "lidar_acquisitions", "id", "set null"),
]

#: Checks of the crowns table.
CHECKS = {
    "category": "crown_category in ('Manual', 'Automated')",
    "method": "crown_category <> 'Automated' or generation_method is not null",
    "lineage": "crown_category = 'Manual' or source_lidar_id is not null or source_image_id is not null",
}


def schema(name: str) -> StructType:
    """A table's schema; parsing it takes a session."""
    return StructType.fromDDL(COLUMNS[name])


def deploy(spark: SparkSession, database: str, reset: bool = False) -> None:
    """Create the tables in a database of the catalog; with ``reset`` drop them first, children before parents."""
    spark.sql(f"create database if not exists {database}")
    for name in reversed(COLUMNS) if reset else ():
        spark.sql(f"drop table if exists {database}.{name}")
    for name, ddl in COLUMNS.items():
        columns = ddl.replace(" not null", "")  # files do not enforce it; ``duplicates`` finds missing keys
        spark.sql(f"create table if not exists {database}.{name} ({columns}) using parquet")


def jdbc_options(url: str | None = None, env: dict | None = None, driver: str = "postgresql") -> dict:
    """Options of ``spark.read.jdbc`` from a URL, or from DB_USER, DB_PASSWORD, DB_HOST, DB_PORT and DB_NAME."""
    if url:
        return {"url": url}
    env = env or {}
    if driver == "sqlite":
        return {"url": f"jdbc:sqlite:{env.get('DB_PATH', 'store.db')}"}
    if not env.get("DB_USER") or not env.get("DB_PASSWORD"):
        raise ValueError("DB_USER and DB_PASSWORD are needed")
    return {"url": f"jdbc:{driver}://{env.get('DB_HOST', 'localhost')}:{env.get('DB_PORT', '5432')}/{env.get('DB_NAME', 'forest')}", "user": env["DB_USER"], "password": env["DB_PASSWORD"]}


def duplicates(table: DataFrame, key: str) -> DataFrame:
    """Values of a unique key that are null or repeat."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(f"n > 1 or {key} is null")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of a child whose key no parent has."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias("__k")), F.col(column) == F.col("__k"), "left_anti")


def violations(crowns: DataFrame) -> DataFrame:
    """Rows that break a check, with the check's name."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(F.expr(e), F.lit(True)), F.lit(n)) for n, e in CHECKS.items())), lambda x: x.isNotNull())
    return crowns.withColumn("broken", F.explode(broken))


def delete_rows(tables: dict[str, DataFrame], name: str, gone: Column) -> dict[str, DataFrame]:
    """Delete rows of a table with what hangs on them: children go or lose the reference, as the keys say."""
    out = dict(tables)
    out[name] = tables[name].where(~F.coalesce(gone, F.lit(False)))
    for child, column, parent, key, action in FOREIGN_KEYS:
        if parent == name and child in out:
            lost = tables[name].where(gone).select(F.col(key).alias("__k")).distinct()
            if action == "cascade":
                out = delete_with(out, child, column, lost)
            else:
                marked = out[child].join(lost.withColumn("__gone", F.lit(True)), F.col(column) == F.col("__k"), "left")
                out[child] = marked.withColumn(column, F.when(F.col("__gone"), None).otherwise(F.col(column))).drop("__k", "__gone")
    return out


def delete_with(tables: dict[str, DataFrame], child: str, column: str, lost: DataFrame) -> dict[str, DataFrame]:
    marked = tables[child].join(lost.withColumn("__gone", F.lit(True)), F.col(column) == F.col("__k"), "left").drop("__k")
    out = delete_rows(tables | {child: marked}, child, F.col("__gone"))
    out[child] = out[child].drop("__gone")
    return out


def with_ids(new: DataFrame, existing: DataFrame | None = None, column: str = "id") -> DataFrame:
    """New rows with ids after the largest there is. Ids rise but may leave gaps: numbering without gaps needs one order.

    The rows are kept with their ids, so that children made of them refer to the same ones whatever is run again.
    """
    start = 0 if existing is None else existing.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    return kept(new.withColumn(column, F.monotonically_increasing_id() + start + 1))


def append(rows: DataFrame, path: str, batch_rows: int | None = None) -> int:
    """Append rows to a Parquet table; how many. ``batch_rows``: at most so many in a file."""
    before = rows.sparkSession.read.parquet(path).count() if _exists(rows.sparkSession, path) else 0
    writer = rows.write.mode("append")
    (writer.option("maxRecordsPerFile", batch_rows) if batch_rows else writer).parquet(path)
    return rows.sparkSession.read.parquet(path).count() - before


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def point_wkb(points: DataFrame, x: str = "x", y: str = "y", z: str | None = None, srid: int | None = None) -> DataFrame:
    """``geom``: WKB (with ``srid``: extended WKB) of points, packed for whole batches at once."""
    head = geometry.to_wkb((1, (0.0, 0.0, 0.0) if z else (0.0, 0.0)), srid)
    head, names = head[: -(24 if z else 16)], [x, y, *([z] if z else [])]
    out = StructType([*points.schema.fields]).add("geom", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype("<f8") for n in names], axis=1)
            body = [head + row.tobytes() for row in packed]
            yield pa.record_batch([*batch.columns, pa.array(body, pa.binary())], names=[*batch.schema.names, "geom"])

    return points.mapInArrow(run, out)


def load_trees(layer: DataFrame, mapping: dict[str, str], srid: int = 32619, source_srid: int | None = None, ewkb: bool = False) -> DataFrame:
    """Rows for ``trees``: standard columns, three dimensions, SRID; with ``ewkb`` also ``geom``. Write them with ``append``.

    Coordinates are reprojected from ``source_srid``; without one they are taken to be in ``srid`` already.
    """
    out = prepare_treetops(layer, mapping)
    out = to_crs(out, source_srid, srid) if source_srid not in (None, srid) else out
    z = F.col("z") if "z" in out.columns else F.lit(0.0)
    rows = out.select("tree_id", "species", "status", "x", "y", z.alias("z"), F.lit(srid).alias("srid"))
    return point_wkb(rows, z="z", srid=srid) if ewkb else rows


def reconcile_manual(crowns: DataFrame, trees: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """Manual crowns with a tree each, and the trees that had to be made up.

    A crown's own id stays; else it gets the tree within it; else a tree at its centre with id ``SYN_<stamp>_<crown>``,
    species Manual_Digitization and status Synthetic.
    """
    found = assign_tree_ids(crowns.where("tree_id is null"), trees).select(F.col("crown_id").alias("__c"), F.col("tree_id").alias("__t"))
    joined = crowns.join(found, F.col("crown_id") == F.col("__c"), "left")
    made = F.concat(F.lit(f"SYN_{stamp}_"), F.col("crown_id").cast("string"))
    out = joined.withColumn("synthetic", F.col("tree_id").isNull() & F.col("__t").isNull()).withColumn("tree_id", F.coalesce("tree_id", "__t", made)).drop("__c", "__t")
    new = out.where("synthetic").select("tree_id", F.lit("Manual_Digitization").alias("species"), F.lit("Synthetic").alias("status"), ((F.col("minx") + F.col("maxx")) / 2).alias("x"), ((F.col("miny") + F.col("maxy")) / 2).alias("y"))
    return out.drop("synthetic"), new


def load_crowns(layer: DataFrame, category: str, method: str | None = None, lidar_id: int | None = None, image_id: int | None = None, srid: int = 32619, trees: DataFrame | None = None, stamp: str = "") -> DataFrame:
    """Rows for ``crowns``: ``tree_id`` and the category's first three letters in upper case make the id; polygons only.

    Polygons in ``geom`` come out flat and as extended WKB. With ``trees``, Manual crowns that lack a tree get one first
    (``reconcile_manual``, which also gives the trees to add). Without a ``tree_id`` column, KeyError.
    """
    if category == "Manual" and trees is not None:
        layer, _ = reconcile_manual(layer if "tree_id" in layer.columns else layer.withColumn("tree_id", F.lit(None).cast("string")), trees, stamp)
    if "tree_id" not in layer.columns:
        raise KeyError("tree_id")
    only = layer.where("geom_type = 'Polygon'") if "geom_type" in layer.columns else layer
    key = F.concat_ws("_", F.col("tree_id").cast("string"), F.upper(F.substring(F.lit(category), 1, 3)))
    box = [c for c in ("minx", "miny", "maxx", "maxy", "geom") if c in only.columns]
    rows = only.select(key.alias("crown_id"), F.col("tree_id").cast("string").alias("tree_id"), F.lit(category).alias("crown_category"), F.lit(method).cast("string").alias("generation_method"), F.lit(lidar_id).cast("bigint").alias("source_lidar_id"), F.lit(image_id).cast("bigint").alias("source_image_id"), F.lit(srid).alias("srid"), *box)
    if "geom" not in rows.columns:
        return rows

    @F.pandas_udf("binary")
    def flat(g: pd.Series) -> pd.Series:
        return g.map(lambda b: None if b is None else geometry.to_wkb(geometry.set_dimensions(geometry.from_wkb(b), 2), srid))

    return rows.withColumn("geom", flat("geom"))


def register_lidar(clouds: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Rows for ``lidar_acquisitions`` with ids; missing columns are null."""
    wanted = schema("lidar_acquisitions").fields[1:]
    have = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in clouds.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    return with_ids(clouds.select(*have), existing)


def register_image(images: DataFrame, bands: str = "bands") -> tuple[DataFrame, DataFrame]:
    """Image rows, and a row per entry of their ``bands`` array of ``(band_index, wavelength_nm, band_name)``."""
    parts = images.select(F.col("id").alias("image_id"), F.explode(bands).alias("b")).select("image_id", "b.*")
    return images.drop(bands), parts


def metrics_json(stats: DataFrame, image_id: int | None = None) -> DataFrame:
    """Rows for ``spectral_attributes`` from long statistics: all bands of a crown as one JSON object."""
    names = ("med", "mean", "sd", "min", "max")
    each = F.struct(F.concat(F.lit("b"), F.lpad(F.col("band").cast("string"), 4, "0")).alias("band"), *(F.col(n) for n in names))
    rows = stats.groupBy("crown_id").agg(F.array_sort(F.collect_list(each)).alias("m"))
    return rows.select("crown_id", F.lit(image_id).cast("bigint").alias("image_id"), F.to_json(F.map_from_entries(F.transform("m", lambda x: F.struct(x["band"], F.struct(*(x[n].alias(n) for n in names)))))).alias("metrics"))


def metric(table: DataFrame, path: str, kind: str = "double") -> Column:
    """A value within JSON metrics, by path, NULL where it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json("metrics"), path, kind)


def fetch_trees(spark: SparkSession, source: dict | DataFrame, srid: int = 32619) -> DataFrame:
    """``tree_id, species, status, geom`` of the store, read over JDBC or given; an empty store gives an empty table."""
    table = spark.read.format("jdbc").options(**source).option("dbtable", "trees").load() if isinstance(source, dict) else source
    return table.select("tree_id", "species", "status", *(c for c in ("geom", "x", "y") if c in table.columns)).withColumn("srid", F.lit(srid))


def load_wkb(batch: pd.Series) -> pd.Series:
    return batch.map(lambda b: geometry.from_wkb(bytes(b)) if b is not None else None)
