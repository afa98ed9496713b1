"""A corpus in five stages: quality, near duplicates, repeated passages, benchmark passages, pieces.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``docs``; the last adds its pieces. ``run`` stores what a stage
returns before the next reads it.

Defined cases: the operators' own. Texts that become empty stay as rows. A column n_chars follows the text where a stage changes it. Extra columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from logmeld.llm import chunk_dedup, decontaminate, line_quality, near_dup, piece_lattice
from logmeld.session import written

SEED = 0


def _retext(docs: DataFrame, text) -> DataFrame:
    """``docs`` with another text, and n_chars to match."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that failed."""
    judged = line_quality.quality(docs, clean="clean_text")
    # a filter on a computed verdict would be copied below the computation; an observed plan keeps it above
    judged = judged.observe(Observation("quality"), F.count(F.lit(1)).alias("read"), F.count_if("kept").alias("kept"))
    judged = judged.filter("kept").select(*[F.col("clean_text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return _retext(judged, F.col("text"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id."""
    return near_dup.keep_one(docs).select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat stay in the first document that has them."""
    return _retext(chunk_dedup.dedup_substrings(docs), F.col("text")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves alone."""
    judged = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.filter(~F.col("contaminated")).select(*docs.columns)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations, and whether decoding gives the text back."""
    return piece_lattice.encode_documents(docs, seed=SEED)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", substring_stage),
    ("decontamination", decontamination_stage),
    ("pieces", piece_stage),
]

#: Sampled pieces and content-defined chunks are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"corpus-{name}")
    return docs
