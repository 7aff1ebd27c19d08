"""A corpus pipeline over documents, each stage one operator of shutterlake.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shutterlake.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from shutterlake.llm.common import Scratch, temporary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy corpus-1 keeps; its verdict is computed from each row's own text, so no join is needed."""
    return quality_rules.keep_rows(docs, quality_rules.POLICIES["corpus-1"])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that recur across documents."""
    return line_dedup.deduplicate_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near and exact copies, the smallest doc_id."""
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Power-of-two sequences of the remaining texts, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_jaccard", near_duplicates), ("decontaminate", benchmark), ("pack", pack)]

#: MinHash, CGK walks and the tokenizer have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again. Of what the stages wrote, only the last one's input stays."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        scratch.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
