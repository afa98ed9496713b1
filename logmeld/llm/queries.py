"""One query per operator, over the whole tables, and reference SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from logmeld.llm import (
    chunk_dedup, decontaminate as decontamination, line_quality, mix_lm, multi_index, near_dup, packed_ids, page_text, piece_lattice, sharding, token_align,
    token_scan, url_rules,
)
from logmeld.session import written

SHARDS = 16
#: Fixed values of the task: (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in URL_RULES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    docs = table(spark, sf_dir, "documents").select("doc_id", size, F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    return sharding.shard(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_scan.count_document_tokens(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"select * from values {_RULES} as rules(host, path, verdict)")
    return url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontamination.decontaminate(docs, items).drop("text")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality.quality(docs).drop("text", "clean_text")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piece_lattice.encode_documents(docs, drop_text=True)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = multi_index.usable(table(spark, sf_dir, "embeddings"), F.col("vec_id"), label, F.col("embedding"), 256.0)
    return multi_index.mine_negatives(vectors, F.col("id") % 100 == 0)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packed_ids.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_align.align_texts(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256")
    stored = written(aligned.select(*[c for c in aligned.columns if c != "groups"], digest), "aligned")
    return token_align.rate_links(stored)


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filters": op4_url_filters,
    "op5_decontamination": op5_decontamination,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_html_extraction": op8_html_extraction,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_files": op12_token_files,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_url_filters": f"""
        with rest as (
            select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
        parts as (
            select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
        rules(r_host, r_path, r_verdict) as (values {_RULES}),
        fits as (
            select page_id, r_host || r_path as rule, r_verdict,
                   row_number() over (partition by page_id order by length(r_host || r_path) desc, length(r_host) desc) as n
            from parts join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
        select p.page_id, p.host, p.path, f.rule, coalesce(f.r_verdict, 'allow') as verdict
        from parts p left join fits f on f.page_id = p.page_id and f.n = 1""",
    "op11_hard_negatives": """
        with rows as (
            select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select a.id as anchor_id, r.id, a.label = r.label as same, cast(list_dot_product(cast(a.v as double[]), cast(r.v as double[])) as bigint) as score
            from rows a join rows r on a.id % 100 = 0 and a.id <> r.id),
        positives as (
            select anchor_id, id as positive_id, score as positive_score from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
        select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as integer) as rank,
               s.id as negative_id, positive_score, s.score as negative_score
        from positives p join scored s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * s.score and s.score <= positive_score
        qualify row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) <= 5""",
}
