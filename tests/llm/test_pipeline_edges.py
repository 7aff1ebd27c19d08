"""Each operator and each stage of the pipeline on odd, empty and skewed tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shutterlake.llm import common, decontaminate, language_id, line_dedup, ngram_join, packing, personal_data, quality_classifier, quality_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, odd, name, stage):
    """Nulls, repeats, a long text and columns with names of the operators' own: kept rows are rows of the input."""
    out = stage(spark, odd, SF)
    if name == "pack":
        assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd.collect()}
        return
    assert out.columns == odd.columns
    known = Counter((r.doc_id, r.text or "", r.word, r.h1, r.length) for r in odd.collect())
    got = Counter((r.doc_id, r.text or "", r.word, r.h1, r.length) for r in out.collect())
    assert not got - known
    if name == "quality_rules":
        assert not got  # all are short, but for one of 30,000 different words
    if name == "ngram_jaccard":
        assert sorted(str(k[0]) for k in got) == ["1", "3", "5", "7", "8"]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, odd, name, stage):
    assert stage(spark, odd.limit(0), SF).count() == 0


def test_operators_on_odd_and_empty_tables(spark, odd):
    for df in (odd, odd.limit(0)):
        n = df.count()
        assert personal_data.find_personal_data(df).count() == n
        assert quality_rules.ledger(df).count() == n
        assert line_dedup.deduplicate_lines(df).count() == n
        assert ngram_join.jaccard_links(df).count() == n
        assert packing.pack(df, queries.public_tokenizers.path("byte_bpe_50k.json")).select("doc_id").distinct().count() == df.select("doc_id").distinct().count()
        assert decontaminate.find_leaks(df, df.select(F.col("doc_id").alias("item_id"), "text")).count() >= 0
    learned = language_id.learn(odd.withColumn("lang", F.lit("en")))
    rows = {r.doc_id: r.lang_pred for r in language_id.identify(odd.withColumn("held_out", F.lit(False)), learned, ("doc_id", "held_out")).collect()}
    assert rows[1] == rows[2] == rows[3] == "und" and rows[8] == "en"
    forest = quality_classifier.learn(odd, odd.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label")).distinct())
    assert quality_classifier.score(odd.withColumn("held_out", F.lit(False)), forest, ("doc_id", "held_out")).where("score between 0 and 1").count() == odd.count()


def test_temporary_tables_go(spark, tmp_path, odd):
    with common.temporary():
        scratch = common.Scratch(spark)
        table = scratch.write(odd, "odd")
        assert table.count() == odd.count()
        path = table._scratch_path
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
