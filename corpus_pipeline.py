"""Corpus pipeline: raw documents to token records.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet in
the shared folder and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from silvaspark.llm.common import discard, fresh_path, stored, table
from silvaspark.llm.decontaminate import decontaminate
from silvaspark.llm.mixing import mixed
from silvaspark.llm.parity_join import one_of_each
from silvaspark.llm.quality import keep_good
from silvaspark.llm.token_records import read_token_records, write_token_records

END = 2  # id after each document


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null texts score as empty ones, an empty table stays empty."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more: the least doc_id.

    Texts without words and rows without a doc_id stay; rows that repeat a doc_id stay or go together.
    """
    return one_of_each(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents once, twice or not at all; texts without words are never taken."""
    return mixed(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in record files; per document what reading them back gives."""
    import public_tokenizers

    manifest = write_token_records(docs, fresh_path(spark, "pipeline-records"), public_tokenizers.path("byte_bpe_50k.json"), END)
    return read_token_records(spark, manifest)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_records),
]

#: The classifier and the tokenizer are beyond SQL; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        done = stored(stage(spark, docs, sf_dir), "pipeline-" + name.split(" ")[0])
        if k:
            discard(docs)
        docs = done
    return docs
