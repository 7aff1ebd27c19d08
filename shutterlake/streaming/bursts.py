"""Burst segmentation of photos as they arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from shutterlake.operators.sequences import BurstRules

_PHOTO = ("id", "ts", "seq", "filename", "stem", "faces", "dhash", "hist", "feature")
_PHOTO_SCHEMA = "id long, ts double, seq long, filename string, stem string, faces int, dhash long, hist array<double>, feature array<double>"
_FIELDS = ", ".join(": ".join(f.split(" ", 1)) for f in _PHOTO_SCHEMA.split(", "))
_OUT = "project {key}, id long, anchor long"

Photo = dict[str, Any]


def gap(previous: Photo, current: Photo) -> float:
    """Seconds between two photos; by their numbers where a time is missing."""
    if previous["ts"] is not None and current["ts"] is not None:
        return current["ts"] - previous["ts"]
    if previous["seq"] is None or current["seq"] is None:
        return 999.0
    step = current["seq"] - previous["seq"]
    return 2.0 if 0 < step <= 1 else 5.0 if step <= 2 else 999.0


def likeness(a: Photo, b: Photo) -> tuple[float, float, float]:
    """Cosine of the colours, correlation of the features, and their sum with the hashes' equal bits."""
    x, y = np.asarray(a["hist"], float), np.asarray(b["hist"], float)
    norm = np.sqrt(x @ x) * np.sqrt(y @ y) if len(x) == len(y) else 0.0
    colour = float(x @ y / norm) if norm > 0 else 0.0
    u, v = np.asarray(a["feature"], float), np.asarray(b["feature"], float)
    near = max(0.0, float(u @ v)) if len(u) == len(v) else 0.0
    bits = 999 if a["dhash"] is None or b["dhash"] is None else ((a["dhash"] ^ b["dhash"]) & (1 << 64) - 1).bit_count()
    return colour, near, colour * 0.35 + near * 0.45 + (1 - bits / 64) * 0.20


def _place(photo: Photo) -> tuple[Any, ...]:
    return photo["ts"] or 0.0, photo["seq"] or 0, photo["filename"], photo["id"]


def joins(anchor: Photo, previous: Photo, current: Photo, rules: BurstRules) -> bool:
    """Whether a photo goes on with the burst of the anchor, of which previous is the last photo."""
    if anchor["stem"] is not None and anchor["stem"] == current["stem"] and len(anchor["stem"]) >= 3:
        return True
    seconds = gap(previous, current)
    crowd = {anchor["faces"] or 0, current["faces"] or 0}
    if seconds > rules.slow_gap or (min(crowd) == 0 and max(crowd) >= 4):
        return False
    (colour, near, score), (_, near_anchor, score_anchor) = likeness(previous, current), likeness(anchor, current)
    if seconds <= rules.quick_gap:
        return (max(score, score_anchor) >= rules.quick_any or score >= rules.quick_previous) and colour >= rules.quick_colour and max(near, near_anchor) >= rules.quick_zncc
    return score >= rules.slow_previous and colour >= rules.slow_colour and near >= rules.slow_zncc


def _plain(value: Any) -> Any:
    """A value of pandas or numpy as the state store takes it."""
    if value is None or isinstance(value, float) and np.isnan(value):
        return None
    if isinstance(value, (np.ndarray, list, tuple)):
        return [float(v) for v in value]
    return value.item() if isinstance(value, np.generic) else value


class _Bursts(StatefulProcessor):
    """Per project: the open burst's first and last photo and its length, and the photos that the watermark has not passed."""

    def __init__(self, rules: BurstRules) -> None:
        self.rules = rules

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _PHOTO_SCHEMA)
        self.open = handle.getValueState("open", f"anchor struct<{_FIELDS}>, previous struct<{_FIELDS}>, n int")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        latest = None
        for batch in rows:
            photos = [tuple(_plain(v) for v in r) for r in batch[list(_PHOTO)].itertuples(index=False, name=None)]
            self.waiting.appendList(photos)
            times = [p[1] or 0.0 for p in photos]
            latest = max([*times, latest or 0.0])
        if latest is not None:
            self.handle.registerTimer(int(np.ceil(latest * 1000)))
        yield from self._fold(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._fold(key, timerValues.getCurrentWatermarkInMs())

    def _fold(self, key: Any, watermark: int) -> Iterator[pd.DataFrame]:
        """Takes the photos that the watermark has passed, in order."""
        ready, later = [], []
        for row in self.waiting.get():
            photo = {k: _plain(v) for k, v in zip(_PHOTO, row, strict=True)}
            (ready if (photo["ts"] or 0.0) * 1000 <= watermark else later).append(photo)
        if not ready:
            return
        ready.sort(key=_place)
        anchor, previous, n = None, None, 0
        if self.open.exists():
            first, last, n = self.open.get()
            anchor, previous = ({k: _plain(v) for k, v in zip(_PHOTO, p, strict=True)} for p in (first, last))
        out = []
        for photo in ready:
            if previous is not None and _place(photo) < _place(previous):  # too late: its neighbours are told already
                out.append((key[0], photo["id"], photo["id"]))
                continue
            if not (0 < n < self.rules.longest and joins(anchor, previous, photo, self.rules)):
                anchor, n = photo, 0
            previous, n = photo, n + 1
            out.append((key[0], photo["id"], anchor["id"]))
        if anchor is not None:
            self.open.update((tuple(anchor[k] for k in _PHOTO), tuple(previous[k] for k in _PHOTO), n))
        if later:
            self.waiting.put([tuple(p[k] for k in _PHOTO) for p in later])
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["project", "id", "anchor"])

    def close(self) -> None:
        pass


def burst_stream(photos: DataFrame, delay: str = "10 seconds", rules: BurstRules = BurstRules()) -> DataFrame:  # noqa: B008
    """A stream of photos(project, id, ts, seq, filename, stem, faces, dhash, hist, feature) -> project, id, anchor, as burst_segments gives them.

    Photos may arrive out of order by `delay`: they wait in the state until the
    watermark has passed their time, and are then folded in order. One that comes
    when a later photo was folded stands alone and changes nothing; those behind
    the watermark of the batch before are dropped by Spark. The state of a project is the open burst's
    first and last photo, its length, and what waits. Photos without a time
    count as time 0, so they wait for nothing. Needs the RocksDB state store.
    """
    key = photos.schema["project"].dataType.simpleString()
    timed = photos.select("project", F.col("id").cast("long").alias("id"), F.col("ts").cast("double").alias("ts"), F.col("seq").cast("long").alias("seq"), "filename", "stem", F.col("faces").cast("int").alias("faces"), F.col("dhash").cast("long").alias("dhash"), F.col("hist").cast("array<double>").alias("hist"), F.col("feature").cast("array<double>").alias("feature"), F.timestamp_seconds("ts").alias("at"))
    return timed.withWatermark("at", delay).groupBy("project").transformWithStateInPandas(_Bursts(rules), _OUT.format(key=key), "Append", "EventTime")
