"""Burst segmentation: a plain loop, the batch form over small parts, and the stream agree."""

from __future__ import annotations

import numpy as np
import pytest

from shutterlake.operators import sequences
from shutterlake.operators.sequences import BurstRules
from shutterlake.streaming import bursts, limits

SCHEMA = "project int, id long, ts double, seq long, filename string, stem string, faces int, dhash long, hist array<double>, feature array<double>"
FIELDS = ("project", "id", "ts", "seq", "filename", "stem", "faces", "dhash", "hist", "feature")


def shoot(seed, n, untimed=0.0):
    """Photos with bursts, pauses, equal stems, crowds and photos without a time or number."""
    rng = np.random.default_rng(seed)
    rows, t = [], 1e6
    for i in range(n):
        t += float(rng.choice([0, 1, 3, 6, 20, 700], p=[0.1, 0.45, 0.2, 0.15, 0.07, 0.03]))
        like = rng.random() < 0.7
        rows.append((i % 3, i, None if rng.random() < untimed else t, int(i * 3 // 2) if rng.random() < 0.95 else None, f"I{i}.JPG", f"img_{i // 4:03d}" if i % 9 < 4 else f"img_{i:04d}", int(rng.choice([0, 1, 4], p=[0.1, 0.8, 0.1])), 5 if like else int(rng.integers(-(2**62), 2**62)), [1.0, 0.1 if like else float(rng.random())], [0.8, 0.6] if like else [float(x) for x in rng.random(2)]))
    return rows


def by_loop(rows, rules):
    """Anchor of each photo: the open burst is the only thing remembered."""
    anchors, state = {}, {}
    for p in sorted((dict(zip(FIELDS, r, strict=True)) for r in rows), key=lambda p: (p["ts"] or 0.0, p["seq"] or 0, p["filename"], p["id"])):
        anchor, previous, n = state.get(p["project"], (None, None, 0))
        if not (0 < n < rules.longest and bursts.joins(anchor, previous, p, rules)):
            anchor, n = p, 0
        state[p["project"]] = (anchor, p, n + 1)
        anchors[p["id"]] = anchor["id"]
    return anchors


@pytest.mark.parametrize("untimed", [0.0, 0.3, 1.0])
def test_batch_over_small_parts_equals_a_loop(spark, monkeypatch, untimed):
    monkeypatch.setattr(sequences, "PART_SECONDS", 7)
    monkeypatch.setattr(sequences, "PART_NUMBERS", 4)
    rows = shoot(3, 240, untimed)
    got = {r.id: r.anchor for r in sequences.burst_segments(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = by_loop(rows, BurstRules())
    assert got == want and 20 < len(set(want.values())) < 240


def test_long_runs_over_parts(spark, monkeypatch):
    """Runs of equal photos start anew every thirteen, wherever parts end."""
    monkeypatch.setattr(sequences, "PART_SECONDS", 5)
    rows = [(p, 1000 * p + i, float(i), i, f"{i:04d}.JPG", f"img_{i:04d}", 1, 0, [1.0], [1.0]) for p in (1, 2) for i in range(100)]
    got = {r.id: r.anchor for r in sequences.burst_segments(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1000 * p + i: 1000 * p + i // 13 * 13 for p in (1, 2) for i in range(100)}
    assert sequences.burst_segments(spark.createDataFrame([], SCHEMA)).count() == 0


def run(spark, photos, tmp_path, delay):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = bursts.burst_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), delay)
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return {r.id: r.anchor for r in spark.read.schema("project int, id long, anchor long").parquet(f"{tmp_path}/out").collect()}


def test_stream_equals_batch(spark, tmp_path):
    """Photos arrive in four files, shuffled in each; a later photo of another project moves the watermark past all."""
    rows = shoot(5, 200)
    rng = np.random.default_rng(0)
    for k in range(4):
        part = [r for r in rows if r[1] // 50 == k]
        rng.shuffle(part)
        part = [tuple(x.item() if isinstance(x, np.generic) else list(x) if isinstance(x, np.ndarray) else x for x in r) for r in part]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(9, 999, 2e6, 1, "z", "z", 0, 0, [1.0], [1.0])], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = run(spark, rows, tmp_path, "2000 seconds")
    got.pop(999, None)
    assert got == {r.id: r.anchor for r in sequences.burst_segments(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_stream_takes_late_photos_until_the_watermark(spark, tmp_path):
    """Photo 4 finds its burst, for nothing after it was folded; photo 7 is behind the watermark."""
    photo = lambda i, t: (1, i, t, i, f"{i}.JPG", f"img_{i:04d}", 1, 0, [1.0], [1.0])
    for part in ([photo(1, 100.0), photo(2, 101.0)], [photo(3, 5000.0)], [photo(4, 102.0)], [photo(5, 9000.0)], [photo(6, 20000.0)], [photo(7, 103.0)], [photo(8, 40000.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = run(spark, None, tmp_path, "10 seconds")
    assert {k: v for k, v in got.items() if k not in (6, 8)} == {1: 1, 2: 1, 4: 1, 3: 3, 5: 5}


def test_window_stream_counts_large_buckets_in_parts(spark, tmp_path, monkeypatch):
    """A bucket with more hits in a window than are returned at a time."""
    monkeypatch.setattr(limits, "_ROWS", 7)
    df = spark.createDataFrame([("b", i, 100 + i // 3) for i in range(90)], "bucket string, id long, t long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = limits.fixed_window_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 5, 12)
    q = stream.writeStream.format("memory").queryName("large").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(100)
    want = {r.id: (r.window_start, r.hits, r.allowed) for r in sequences.fixed_window(df, "bucket", "t", 5, 12).collect()}
    assert {r.id: (r.window_start, r.hits, r.allowed) for r in spark.table("large").collect()} == want
