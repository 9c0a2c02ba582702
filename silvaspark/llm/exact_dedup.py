"""Exact deduplication by a stateful stream; DataFrame functions only.

A structured stream reads the table's files. Its state, kept by RocksDB on disk and without any expiry, has for each
digest the number of rows, the identifier that stays and where that row's content lies (file and row in it). Digests
that were seen more than once are hits: their rows are grouped by digest AND full text, so equality is decided on the
bytes and a collision of digests makes two groups. Hot texts collapse map-side in every aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.llm.common import exists, fresh_path, is_file, stored
from silvaspark.llm.native import bitmap_of, maybe_in

#: State on disk; without files set aside in advance, which cost megabytes in each of very many small stores.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _rows(df: DataFrame, digest) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    place = F.struct(F.col("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select("doc_id", text.alias("text"), place.alias("place"), digest(F.col("text")).alias("digest"))


def digest_state(spark: SparkSession, path: str, digest=sha256, files_per_batch: int = 10_000) -> DataFrame:
    """Run the stream over all files at ``path`` until none is left: ``digest, n, keep`` (identifier and locator)."""
    out, check = fresh_path(spark, "exact-groups"), fresh_path(spark, "exact-state")
    before = {k: spark.conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            spark.conf.set(k, v)
        schema = spark.read.parquet(path).schema
        reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
        folder, _, name = path.rstrip("/").rpartition("/")
        # a stream reads folders: a table that is one file is the only one of its name in its folder
        stream = reader.option("pathGlobFilter", name).parquet(folder) if is_file(spark, path) else reader.parquet(path)
        state = _rows(stream, digest).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("keep"))

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")  # the same batch again replaces itself

        run = state.writeStream.outputMode("update").option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(write).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    place = "struct<doc_id: bigint, file: string, row: bigint>"
    empty = f"digest string, n bigint, keep {place}"
    if not exists(spark, out):
        return spark.createDataFrame([], empty)
    said = spark.read.schema(empty + ", batch int").parquet(out)
    return said.groupBy("digest").agg(F.max("n").alias("n"), F.max("keep").alias("keep"))  # both only ever grow


def exact_dedup(spark: SparkSession, path: str, digest=sha256, files_per_batch: int = 10_000) -> DataFrame:
    """Every row of the Parquet table at ``path`` with its group of equal texts.

    Columns: ``doc_id, keep_id, group_size, kept, text_sha256``. Of equal texts the row with the largest doc_id stays;
    among rows that repeat that doc_id, the last by file and place in it. Null texts count as empty; a null doc_id is
    less than any other; empty tables give no rows; other columns are not read. ``digest`` maps a text column to the
    key of the state; results do not depend on it.
    """
    hits = stored(digest_state(spark, path, digest, files_per_batch).where("n > 1"), "exact-hits")
    rows = _rows(spark.read.parquet(path), digest)
    suspects = rows.where(maybe_in(F.col("digest"), bitmap_of(hits, "digest"))).join(hits.select("digest"), "digest", "left_semi")
    # full bytes: rows that share a digest are one group only if their texts are the same
    groups = suspects.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("keep"))
    checked = stored(groups.select("digest", "n", "keep", F.sha2(F.col("text").cast("binary"), 512).alias("sha512")), "exact-checked")
    split = checked.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("n").alias("n"), F.max("keep").alias("keep"))
    split = stored(split, "exact-split")  # a table of its own, so that a digest with very many rows can be split in the join
    single = split.where("texts = 1").select(F.col("digest").alias("g"), "n", "keep")
    joined = rows.select("doc_id", "place", "digest", sha256(F.col("text")).alias("text_sha256")).join(single, F.col("digest") == F.col("g"), "left")
    clash = split.where("texts > 1").select("digest")
    if clash.isEmpty():
        return _result(joined)
    apart = groups.join(clash, "digest", "left_semi").select("digest", "text", "n", "keep")
    rare = rows.join(clash, "digest", "left_semi").join(apart, ["digest", "text"]).select("doc_id", "place", "digest", sha256(F.col("text")).alias("text_sha256"), "n", "keep")
    return _result(joined.join(clash, "digest", "left_anti").drop("g")).unionByName(_result(rare))


def _result(df: DataFrame) -> DataFrame:
    alone = F.col("n").isNull() | (F.col("n") < 2)
    return df.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("n")).alias("group_size"),
        (alone | (F.col("place") == F.col("keep"))).alias("kept"),
        "text_sha256",
    )
