"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm import bpe, conversation_trie, decontaminate, html_extract, language_id, line_dedup, ngram_join, packing, periodic_runs, personal_data, quality_classifier, quality_rules, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut into power-of-two sequences of at most 1024 ids."""
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


#: The lists of allowed and blocked sites.
URL_RULES = (
    url_filter.Rule("block", "com/en/"),
    url_filter.Rule("allow", "example.com/en/7"),
    url_filter.Rule("allow", "net/de/"),
    url_filter.Rule("block", "example.net/de/8"),
    url_filter.Rule("block", "org/es/"),
)


def op2_url_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's url."""
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of a document that is an item of the benchmark, give or take a fifth of its words."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _spans_of(kind: int) -> Callable[[Column], Column]:
    """Whether a span is of this kind. Of one parameter only: Spark hands a second one the index."""
    return lambda span: span["kind"] == kind


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and digest, and all spans, of each document."""
    found = personal_data.find_personal_data(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _spans_of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(personal_data.BASE_KINDS)]
    digest = F.sha2(personal_data.written(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), personal_data.written(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failed rules as bits, and the verdict of policy corpus-1."""
    rows = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    rows = quality_rules.apply_policy(rows, quality_rules.POLICIES["corpus-1"])
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.BASE).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those whose id is not held out."""
    docs = _table(spark, sf_dir, "documents")
    rest = language_id.remainder(F.col("doc_id"), 4)
    prototypes = language_id.learn(docs.where(rest != 2))  # rows without an id teach nothing
    marked = docs.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "text")
    return language_id.identify(marked, prototypes, ("doc_id", "held_out"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of each document, learned from labels whose id is not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    forest = quality_classifier.learn(docs, labels.where(language_id.remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label")))
    held = F.coalesce(language_id.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = quality_classifier.score(docs.select("doc_id", held.alias("held_out"), "text"), forest, ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after, and a hash of what is kept."""
    rows = line_dedup.deduplicate_lines(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, links and copies of each document."""
    return ngram_join.jaccard_links(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, and the bytes they decode to, as digests."""
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of each document's words, and its text without their repetitions."""
    return periodic_runs.digest(periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), plant=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack_binary, op2_url_model, op3_html_extract, op4_decontaminate, op5_personal_data, op6_quality_ledger, op7_language_id, op8_quality_trees, op9_line_dedup, op10_ngram_jaccard, op11_conversation_trie, op12_byte_bpe, op13_periodic_runs)}
