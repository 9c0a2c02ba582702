"""Helpers shared by the training-data operators: the shared scratch folder, stored stages, small checked sizes."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Where none is named and all runs on one machine (tests), a temporary folder is made once and put in the session; on
    a cluster the setting is needed.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="silvaspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark deletes the shuffle files of a query when it ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows go to Python in batches of at most so many bytes: Spark's 64 MB stand in memory several times for each task.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    Nothing reads the shuffle files of the write again, so Spark deletes them when it is done.
    """
    spark = df.sparkSession
    path, wanted = fresh_path(spark, name), {CLEANED: "true", BATCH[0]: str(BATCH[1])}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


#: Rows that a file of a small table holds at least, and the number of files from which that counts.
ROWS, FILES = 2000, 8


def stored_small(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``stored`` by as few tasks as suit about ``rows`` rows; all that ``df`` is made of must be as small.

    Else each shuffle partition writes a file of its own, however few rows there are; to a local folder Hadoop starts a
    process for each file.
    """
    return stored(df.coalesce(max(FILES, math.ceil(rows / ROWS))), name)


def discard(*tables: DataFrame) -> None:
    """Delete what ``stored`` wrote for tables that nothing will read again."""
    for df in tables:
        fs, p = _at(df.sparkSession, df.stored_at)
        fs.delete(p, True)


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a path, on any file system that Spark knows."""
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.getFileStatus(p).isFile()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
