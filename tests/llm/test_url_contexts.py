"""The URL models hold every context, however few strings go to every task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shutterlake.llm import queries, url_filter
from shutterlake.llm.common import Scratch


@pytest.mark.parametrize("hot", [0, 40])
def test_scores_do_not_depend_on_what_every_task_has(spark, hot):
    rows = [(i, f"https://{'casino-win' if i % 4 == 0 else 'garden'}{i % 23}.org/{i * 7919:x}/p{i}?q={i % 5}") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    judged = lambda n: {r.page_id: (r.verdict, round(r.score, 9)) for r in url_filter.judge(pages, queries.URL_RULES, hot_rows=n).collect()}
    got = judged(hot)
    assert got == judged(url_filter.HOT_ROWS) and {v for v, _ in got.values()} == {"allow", "block"}


def test_models_keep_every_gram(spark):
    """More grams of one length than a model of 400,000 rows held."""
    grams = spark.range(90_000).select(F.lpad(F.conv("id", 10, 36), 5, "0").alias("gram"), F.lit(1).alias("a0"), F.lit(1).alias("r0"))
    assert url_filter.log_ratios(grams, 1, Scratch(spark))[url_filter.ORDER].count() == 90_000
