"""Corpus preparation: ``documents`` through a fixed list of stages, each stored before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeframe.llm import arrays, bpe, decontaminate, jaccard, lines, quality
from tapeframe.session import staged


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored like any other; equal texts
    share a score; an empty table stays empty."""
    return quality.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words or more that occurred earlier are deleted; a document of which no word is left goes.
    Null, empty and blank texts stay; of repeats the first by doc_id and line stays; an empty table stays empty."""
    had = arrays.free_name(docs.columns, "__had")
    before = docs.withColumn(had, F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    after = lines.clean(before).where(~F.col(had) | F.col("text").rlike(r"\S")).drop(had)
    return after.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word Jaccard similarity of 0.8 or more, the least doc_id stays.
    Texts without words stay, one of each doc_id and text; a null doc_id comes first; an empty table stays empty."""
    return jaccard.clean(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; repeated rows go or stay alike; an empty
    table or benchmark changes nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of what is left, as counts and digests. Null texts are empty; every row
    keeps a row, repeated ones too; an empty table gives none."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", delete_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", drop_benchmark_copies),
    ("byte_bpe", encode_tokens),
]

# SQL cannot express the classifier; the pipeline is tested against a plain single-process version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
