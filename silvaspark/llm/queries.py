"""Queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from silvaspark.llm.common import fresh_path, table


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from silvaspark.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silvaspark.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silvaspark.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silvaspark.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silvaspark.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silvaspark.llm.exact_dedup import exact_dedup

    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


OP6_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
    sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""


def op7_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silvaspark.llm.parity_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


OP7_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as t from documents),
n as (select doc_id, g, cast(len(g) as bigint) as n_shingles from (select doc_id, case when len(t) = 0 then [] when len(t) < 3 then [array_to_string(t, ' ')]
    else list_distinct([array_to_string(t[i:i + 2], ' ') for i in range(1, len(t) - 1)]) end as g from w)),
e as (select doc_id, n_shingles, unnest(g) as x from n),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n_shingles) as na, any_value(b.n_shingles) as nb from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c where 100 * k >= 90 * (na + nb - k)),
u as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from u union select r.a, u.b from r join u on r.b = u.a)
select n.doc_id, n.n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) as component_id from n left join r on r.a = n.doc_id group by 1, 2
"""


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silvaspark.llm.licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents")).select("doc_id", "licence", "dice", "n_found")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from silvaspark.llm.token_records import read_token_records, write_token_records

    manifest = write_token_records(table(spark, sf_dir, "documents"), fresh_path(spark, "token-records"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_token_records(spark, manifest)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from silvaspark.llm.mixing import mix

    _, per_doc = mix(table(spark, sf_dir, "documents"))
    return per_doc.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_decontamination, op3_token_counts, op4_html_text, op5_quality, op6_exact_dedup, op7_parity_join, op8_licences, op9_token_records, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    from silvaspark.llm.mixing import MIX_SQL

    return {"op6_exact_dedup": OP6_SQL, "op7_parity_join": OP7_SQL, "op10_mixing": MIX_SQL}
