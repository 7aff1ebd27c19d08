"""Queries against their SQL on tables whose keys reach further than those of the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from shutterlake.operators import selection
from shutterlake.plans import catalog
from tests.test_queries import SF, normal


@pytest.fixture(scope="module")
def moved(spark, tmp_path_factory):
    """Half of the vectors as they are, half with ids past 4,000: of these, photos without a time have numbers beyond the first part."""
    folder = str(tmp_path_factory.mktemp("moved"))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows.selectExpr("if(vec_id < 250, vec_id, vec_id + 4080) as vec_id", *[c for c in rows.columns if c != "vec_id"]).coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["burst_segments", "burst_winner", "cull_project", "recluster_project"])
def test_bursts_over_parts_by_number(spark, moved, name):
    found = catalog.queries()[name](spark, moved)
    columns = sorted(found.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{moved}/embeddings.parquet/*.parquet'")
    result = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = normal([dict(zip(names, r, strict=True)) for r in result.fetchall()], columns)
    assert normal([r.asDict() for r in found.collect()], columns) == want


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Every vector twice, and once more in a project of its own: ids are those of several photos."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows.unionByName(rows).unionByName(rows.withColumn("label", rows.label + 10)).coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["burst_segments", "burst_winner", "cull_project", "recluster_project"])
def test_bursts_over_repeated_ids(spark, repeated, name):
    found = catalog.queries()[name](spark, repeated)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{repeated}/embeddings.parquet/*.parquet'")
    result = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    want = normal([dict(zip(names, r, strict=True)) for r in result.fetchall()], names)
    assert normal([r.asDict() for r in found.collect()], names) == want


def test_vibrance_at_a_hundredth(spark, tmp_path):
    """A sum of saturation that falls below a whole hundredth if a share is scaled to 255 and back."""
    rows = [(792162, n, p, s) for n, p, s in [(2, 116967, 5920), (3, 113706, 5399), (2, 116591, 5159), (4, 108345, 5756), (3, 108173, 5664), (5, 107934, 5987)]]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()["vibrance"]).fetchall()
    assert [tuple(r) for r in catalog.queries()["vibrance"](spark, str(tmp_path)).collect()] == want


def test_pairs_by_either_key_come_once_without_a_shuffle_of_pairs(spark):
    """Ids with several rows, several common keys, null and empty keys."""
    rows = [[(i % 40, None if i % 11 == 0 else f"m{i * k % 5}" if i % 7 else "", f"p{i * k % 9}" if i % 5 else None) for i in range(60)] for k in (3, 4)]
    left, right = (spark.createDataFrame(r, f"{n} int, mail string, phone string") for r, n in zip(rows, "ab", strict=True))
    found = selection.or_match(left, right, {"mail": "mail", "phone": "phone"}, "a", "b")
    agree = lambda u, v: u is not None and u != "" and u == v
    want = {(a, b) for a, m, p in rows[0] for b, n, q in rows[1] if agree(m, n) or agree(p, q)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Aggregate")  # nothing is aggregated above the pairs
