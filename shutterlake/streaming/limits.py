"""Streaming forms of stateful operators. An extension: the batch forms are the measure."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are returned together at most.
_ROWS = 10_000
_HITS = "bucket string, id long, window_start long, hits int, allowed boolean"


def fixed_window_stream(hits: DataFrame, most: int, seconds: int) -> DataFrame:
    """hits(bucket, id, t in seconds), a stream -> bucket, id, window_start, hits, allowed.

    The state of a bucket is two numbers. Within a micro-batch hits are taken in
    the order of t and id, as two arrays of numbers; results leave window by
    window. A hit older than the state counts in the open window.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        parts = [(b["id"].to_numpy(np.int64), b["t"].to_numpy(np.int64)) for b in batches]
        ids, times = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, times))
        ids, times = ids[order], times[order]
        at = 0
        while at < len(times):  # one window, or a part of a large one, at a time
            if start is None or times[at] - start >= seconds:
                start, n = int(times[at]), 0
            end = min(int(np.searchsorted(times, start + seconds)), at + _ROWS)
            end = max(end, at + 1)
            hit = n + 1 + np.arange(end - at)
            yield pd.DataFrame({"bucket": key[0], "id": ids[at:end], "window_start": start, "hits": hit.astype(np.int32), "allowed": hit <= most})
            n += end - at
            at = end
        state.update((start, n))

    return hits.groupBy("bucket").applyInPandasWithState(step, _HITS, "start long, n int", "append", "NoTimeout")


def selections_stream(changes: DataFrame, keep: str = "7 days") -> DataFrame:
    """changes(photo_id, status, at timestamp), a stream -> the latest status of each photo and the day of its change; later than `keep` is dropped."""
    latest = F.max_by("status", "at").alias("status")
    return changes.withWatermark("at", keep).groupBy("photo_id", F.window("at", "1 day").alias("day")).agg(latest, F.max("at").alias("at")).select("photo_id", F.col("day.start").alias("day"), "status", "at")


def payments_stream(payments: DataFrame, keep: str = "7 days") -> DataFrame:
    """payments(order_id, at timestamp, ...), a stream -> each order's first notice; notices repeated within `keep` are dropped, so fulfilment runs once."""
    return payments.withWatermark("at", keep).dropDuplicatesWithinWatermark(["order_id"])
