"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from vectorised passes over the bytes and word hashes of whole
texts. Trees are complete and flattened into arrays, so a batch of documents
goes down all trees together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import grams_of, slices, text_buffer, words

#: Labelled rows that a fit takes at most: those of the least hashes of their ids.
SAMPLE_ROWS = 20_000
BINS, DEPTH, TREES, RATE = 64, 4, 80, 0.15

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!?", "|", "#*$%&<>", "\"'`", "()[]{}", "=+-_/\\@:;~^"]
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _k, _g in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _g]] = _k
_CLASS[128:] = len(_GROUPS) + 1
FEATURES = 2 * (len(_GROUPS) + 2) + 9


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[offsets])


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def statistics(column: pa.Array) -> np.ndarray:
    """texts x FEATURES. Null and empty texts have zeros."""
    raw, offsets = text_buffer(column)
    h, start, end, at = words(raw, offsets)
    n_bytes, n_words = np.diff(offsets).astype(float), np.diff(at).astype(float)
    kind = _CLASS[raw]
    counts = [_sums(kind == k, offsets) for k in range(len(_GROUPS) + 2)]
    length = end - start
    distinct, windows = np.zeros(len(column)), np.zeros(len(column))
    three = grams_of(h, 3)
    for i in range(len(column)):
        a, b = at[i], at[i + 1]
        distinct[i] = len(np.unique(h[a:b]))
        if b - a > 2:
            windows[i] = len(np.unique(three[a : b - 2])) / (b - a - 2)
    upper_first = _sums(kind[start] == 1, at) if len(start) else np.zeros(len(column))
    last = kind[end - 1] if len(end) else np.zeros(0, np.uint8)
    return np.column_stack(
        [
            np.log1p(n_bytes), np.log1p(n_words), _ratio(n_bytes, n_words), _ratio(distinct, n_words), windows, _ratio(_sums(length <= 2, at), n_words), _ratio(_sums(length >= 10, at), n_words),
            _ratio(upper_first, n_words), _ratio(_sums(last == 6, at), n_words),
            *[_ratio(c, n_bytes) for c in counts], *[_ratio(c, n_words) for c in counts],
        ]
    )


@dataclass
class Forest:
    """Complete trees: node k has children 2k + 1 and 2k + 2; a row goes right if its feature exceeds the cut."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        tree = np.arange(trees)
        out = np.empty(len(x))
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            node = np.zeros((len(part), trees), np.int64)
            row = np.arange(len(part))[:, None]
            for _ in range(DEPTH):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.cut[tree, node])
            out[a : a + 4096] = self.base + self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE, l2: float = 5.0, least: float = 2.0) -> Forest:
    """Logistic loss, second-order gains over BINS quantile bins. Without rows of both classes the score is their share."""
    share = (y.sum() + 1) / (len(y) + 2)
    base, inner = float(np.log(share / (1 - share))), 2**DEPTH - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    if len(y) == 0 or y.min() == y.max():
        return Forest(feature, cut, leaf, base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, w = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first, width = 2**depth - 1, 2**depth
            local = node - first
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                cell = local * BINS + binned[:, f]
                gs = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                ws = np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gr, wr = gs[:, -1:] - gs, ws[:, -1:] - ws
                gain = gs**2 / (ws + l2) + gr**2 / (wr + l2) - gs[:, -1:] ** 2 / (ws[:, -1:] + l2)
                gain[(ws < least) | (wr < least)] = 0
                gain[:, len(edges[f]) :] = 0
                top = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width), top] > best):
                    best[k] = gain[k, top[k]]
                    feature[t, first + k], cut[t, first + k] = f, edges[f][top[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        local = node - inner
        leaf[t] = -rate * np.bincount(local, g, inner + 1) / (np.bincount(local, w, inner + 1) + l2)
        margin += leaf[t, local]
    return Forest(feature, cut, leaf, base)


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fits on documents(doc_id, text) that labels(doc_id, label) marks 0 or 1, at most sample_rows of them.

    The sample is bounded, so the driver fits it; its rows have the least hashes
    of their ids. Null labels and ids teach nothing.
    """
    marked = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("label").cast("int").alias("__label"))
    sample = marked.orderBy(F.xxhash64("__id"), "__id", "__label").limit(sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(statistics(part.column(1))), pa.list_(pa.float64())), part.column(2)], names=["id", "x", "y"])

    # Broadcast: sample_rows bounds it.
    joined = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "__id").select(F.col("__id").cast("long").alias("id"), "text", "__label")
    rows = joined.mapInArrow(run, "id long, x array<double>, y int").toPandas().sort_values(["id", "y"], kind="stable")
    x = np.array(rows["x"].tolist(), float).reshape(-1, FEATURES)
    return fit(x, rows["y"].to_numpy(float))


def score(docs: DataFrame, forest: Forest, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with score, 0 to 1; null and empty texts are scored by their zeros."""
    narrow = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    schema = narrow.drop("__text").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(forest.score(statistics(part.column(len(carry)))))], names=[*carry, "score"])

    return narrow.mapInArrow(run, schema)
