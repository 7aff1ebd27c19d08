"""Helpers that several operators share: shared storage, Arrow text buffers, word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder serves, but only for a local master:
    on a cluster the executors could not see it.
    """
    global _local_dir
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="shutterlake-")
    return _local_dir


class Scratch:
    """Tables written once in the shared folder, to cut lineage and to read twice without computing twice."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/shutterlake-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[DataFrame] = []
        for scope in _scopes[-1:]:
            scope.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # type: ignore[attr-defined]
        self.tables.append(out)
        return out

    def _delete(self, path: str) -> None:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found, True)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later step reads."""
        for table in tables:
            self._delete(table._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all tables but these."""
        paths = {t._scratch_path for t in tables}
        self.drop(*[t for t in self.tables if t._scratch_path not in paths])
        self.tables = list(tables)

    def clear(self) -> None:
        self._delete(self.root)


_scopes: list[list[Scratch]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Deletes the tables of all Scratches made inside, once the results that read them are written."""
    _scopes.append([])
    try:
        yield
    finally:
        for scratch in _scopes.pop():
            scratch.clear()


#: Bits of a filter: 2^18 words of 64 bits at most (about 10 MB to every task), whatever the number of keys.
FILTER_BITS = 24


def may_match(rows: DataFrame, keys: DataFrame, on: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """rows with __may: false where no row of keys has this row's values of `on`; some others are true too. The bits of the keys' hashes go to every task."""
    place = F.pmod(F.xxhash64(*on), F.lit(1 << FILTER_BITS))
    word, bit = F.shiftright(place, 6), (place % 64).cast("int")
    marks = keys.groupBy(word.alias("__slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("__marks"))
    marked = rows.withColumn("__slot", word).join(F.broadcast(scratch.write(marks, "marks")), "__slot", "left")
    return marked.withColumn("__may", F.getbit(F.coalesce("__marks", F.lit(0).cast("long")), bit) == 1).drop("__slot", "__marks")


# --- text buffers -----------------------------------------------------------

#: ASCII white space, as in [\x20\x09-\x0D]
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True

_SEGMENT = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
    up[1:], down[1:] = _P, inverse
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_POW, _INV = _powers(_SEGMENT + 1)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, end to end, and the n + 1 offsets of the texts in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes the words [^\\x20\\x09-\\x0D]+ of all texts.

    Returns the 64-bit hash, first byte and end byte of each word, and n + 1
    offsets of the texts in these arrays. Works through the buffer in segments
    that end at white space, so memory beside the result stays bounded.
    """
    hashes, starts, ends = [], [], []
    is_first = np.zeros(len(raw) + 1, bool)
    is_first[offsets] = True
    at = 0
    while at < len(raw):
        stop = min(len(raw), at + _SEGMENT)
        if stop < len(raw) and not (_IS_SPACE[raw[stop]] or is_first[stop]):
            back = np.flatnonzero(_IS_SPACE[raw[at:stop]] | is_first[at:stop])
            back = back[back > 0]
            if len(back):
                stop = at + int(back[-1])
            else:  # a word longer than a segment: its end lies further on
                ahead = np.flatnonzero(_IS_SPACE[raw[stop:]] | is_first[stop:-1])
                stop = stop + int(ahead[0]) if len(ahead) else len(raw)
        part = raw[at:stop]
        word = ~_IS_SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1] | is_first[at + 1 : stop]
        s = np.flatnonzero(first)
        if len(s):
            last = word.copy()
            last[:-1] &= ~word[1:] | is_first[at + 1 : stop]
            e = np.flatnonzero(last) + 1
            if len(part) <= _SEGMENT:
                up, down = _POW, _INV
            else:
                up, down = _powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * up[: len(part)], out=sums[1:])
            hashes.append(mix64((sums[e] - sums[s]) * down[s]))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets).astype(np.int64)


def shingles(h: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words and the texts' offsets in them; a text of 1 to n - 1 words has one, of all its words."""
    size = np.diff(offsets)
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    out_offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    if not len(h):
        return np.zeros(0, np.uint64), out_offsets
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(n)]
    total = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for k, f in enumerate(factors):
        total += h[k : len(h) - n + 1 + k] * f if len(total) else np.zeros(0, np.uint64)
    out = np.zeros(out_offsets[-1], np.uint64)
    long = size >= n
    inside = np.zeros(len(h), bool)
    run = np.repeat(long, size)
    inside[:] = run
    position = np.arange(len(h)) - np.repeat(offsets[:-1], size)
    take = inside & (position <= np.repeat(size, size) - n)
    target = np.repeat(out_offsets[:-1], size) + position
    out[target[take]] = total[np.flatnonzero(take)]
    for i in np.flatnonzero(~long & (size > 0)):
        own = h[offsets[i] : offsets[i + 1]]
        out[out_offsets[i]] = np.uint64(len(own)) + (own * np.array(factors[: len(own)], np.uint64)).sum(dtype=np.uint64)
    return mix64(out), out_offsets


def grams_of(h: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all windows of q hashes, across texts too."""
    n = max(len(h) - q + 1, 0)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out += h[k : k + n] * np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
    return out


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that the texts of each part have about most_bytes at most, or are one text."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not len(texts):
        return
    length = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    part = np.cumsum(length) // most_bytes
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        yield batch.slice(a, b - a)
