"""Runs of words that repeat with a period, by the method of Kolpakov and Kucherov.

A run is a stretch of consecutive words with smallest period q, at least four
periods and six words long, that no neighbouring word extends keeping q. In
each text:

1. Words become numbers, over a whole Arrow batch at once.
2. All windows of three words of a run stand three times or more in its text,
   so the text falls into stretches of windows that do. Runs lie within
   stretches, and a stretch holds all that could extend its runs.
3. A suffix automaton of the stretch gives its LZ factorisation: each factor is
   the longest stretch of words that began before, or one new word.
4. Main's algorithm finds the runs that cross or touch each border of two
   factors, from common extensions to both sides for every period.
5. Runs strictly inside a factor are copied from its earlier occurrence.

Texts never meet, so there is no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import SPACES, slices, text_buffer

#: A run has this many periods and words at least, so its windows of WINDOW words stand PERIODS - 1 times or more.
PERIODS, LEAST_WORDS, WINDOW = 4, 6, 3

Run = tuple[int, int, int]  # start, end, period


def word_table(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words [^\\x20\\x09-\\x0D]+ of all texts, the number of each word in them, and the texts' n + 1 offsets in these numbers. Null counts as empty."""
    raw, offsets = text_buffer(column)
    letter = np.ones(len(raw) + 2, bool)
    letter[0] = letter[-1] = False
    letter[1:-1] = ~np.isin(raw, SPACES)
    first = letter[1:-1] & ~letter[:-2]
    last = letter[1:-1] & ~letter[2:]
    borders = offsets[(offsets > 0) & (offsets < len(raw))]
    first[borders] = letter[1:-1][borders]
    last[borders - 1] = letter[1:-1][borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, ends
    at = np.searchsorted(starts, offsets)
    if not len(starts):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64), at
    spans = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw)))
    coded = spans.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), at


def stretches(codes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the maximal stretches whose windows of three words all stand three times or more in their text, if a run can fit."""
    n = len(codes) - WINDOW + 1
    if n < LEAST_WORDS - WINDOW + 1:
        return []
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    whole = text[:n] == text[WINDOW - 1 :]
    number = np.unique(codes[:n] * (codes.max() + 1) + codes[1 : n + 1], return_inverse=True)[1]
    for third in (codes[2 : n + 2], text[:n]):
        number = np.unique(number * (third.max() + 1) + third, return_inverse=True)[1]
    often = np.zeros(n + 2, bool)
    often[1:-1] = whole & (np.bincount(number)[number] >= PERIODS - 1)
    # Windows of two texts are not whole, so no stretch leaves its text.
    starts = np.flatnonzero(often[1:] & ~often[:-1])
    ends = np.flatnonzero(often[:-1] & ~often[1:])
    return [(int(text[a]), int(a), int(b) + WINDOW - 1) for a, b in zip(starts, ends, strict=True) if b - a >= LEAST_WORDS - WINDOW + 1]


def lz_factors(w: list[int]) -> list[tuple[int, int]]:
    """(length, distance to an earlier occurrence, 0 for a new word) of each factor, from a suffix automaton whose states know where they first end."""
    moves: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        state = len(moves)
        moves.append({})
        link.append(0)
        length.append(i + 1)
        first.append(i)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(moves)
                moves.append(moves[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                first.append(first[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    factors, at = [], 0
    while at < len(w):
        state, i, end = 0, at, -1
        while i < len(w):
            state = moves[state][w[i]]
            if first[state] >= i:
                break
            end = first[state]
            i += 1
        factors.append((i - at, i - 1 - end) if i > at else (1, 0))
        at += factors[-1][0]
    return factors


def common_prefixes(s: list[int]) -> list[int]:
    """For each place of s, how many words from there equal those from its start."""
    z = [0] * len(s)
    if s:
        z[0] = len(s)
    left = right = 0
    for i in range(1, len(s)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def runs_at_border(w: list[int], low: int, border: int, high: int) -> Iterator[Run]:
    """Stretches of w[low:high] with four periods or more that hold or touch the border, as far as they extend there."""
    t, u = w[low:border], w[border:high]
    both = t + u
    ahead = common_prefixes([*u, -1, *both])  # u against itself, then against each place of t + u
    back = common_prefixes([*t[::-1], -1, *both[::-1]])
    m, n = len(t), len(u)
    for p in range(1, (m + n) // PERIODS + 1):
        if p <= n:  # a period to the right of the border
            after = ahead[p] if p < n else 0
            before = back[m + 1 + n - p]
            before = min(before, m)
            if before + after + p >= PERIODS * p:
                yield border - before, border + p + after, p
        if p <= m:  # and to the left
            before = back[p] if p < m else 0
            after = min(ahead[n + 1 + m - p], n)
            if before + after + p >= PERIODS * p:
                yield border - p - before, border + after, p


def find_runs(w: list[int]) -> list[Run]:
    """All runs of w by start, then period."""
    factors = lz_factors(w)
    found: dict[tuple[int, int], int] = {}
    by_start: dict[int, list[tuple[int, int]]] = {}

    def add(start: int, end: int, period: int) -> None:
        """The smallest period of a stretch stays; with four periods, any other is a multiple of it."""
        if (start, end) not in found:
            by_start.setdefault(start, []).append((start, end))
        found[start, end] = min(period, found.get((start, end), period))

    border, before = 0, 0
    for size, distance in [*factors, (0, 0)]:
        low, high = max(0, border - 2 * before - size), border + size
        if border and high - low >= LEAST_WORDS:
            for start, end, period in runs_at_border(w, low, border, high):
                # What is cut off by the window reaches another border.
                if (start > low or not low) and (end < high or high == len(w) or w[end] != w[end - period]):
                    add(start, end, period)
        if distance:
            for start in range(border - distance + 1, high - distance):
                for a, b in by_start.get(start, ()):
                    if b + distance < high:
                        add(a + distance, b + distance, found[a, b])
        border, before = high, size
    return sorted((a, b, q) for (a, b), q in found.items() if b - a >= max(LEAST_WORDS, PERIODS * q))


SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.large_string())])


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """Which original word each word becomes, for the ids whose texts are made periodic; null for the others."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, n_words, runs (start, length and period in words), collapsed.

    collapsed: the words that no run holds after its first period, joined by
    one space. A null text has no words. Repeated rows stay apart. With plant,
    the texts of a tenth of the ids are made periodic first (see planted); a
    row without an id is not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _runs_of(part, plant)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _runs_of(part: pa.RecordBatch, plant: bool) -> pa.RecordBatch:
    ids = part.column(0).to_pylist()
    words, codes, offsets = word_table(part.column(1))
    if plant:
        for doc_id, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True):
            order = planted(doc_id, int(b - a)) if doc_id is not None else None
            if order is not None:
                codes[a:b] = codes[a + order]
    starts, lengths, periods, counts = [], [], [], np.zeros(len(ids) + 1, np.int32)
    dropped = np.zeros(len(codes) + 1, np.int64)
    for text, low, high in stretches(codes, offsets):
        for a, b, q in find_runs(codes[low:high].tolist()):
            starts.append(low + a - int(offsets[text]))
            lengths.append(b - a)
            periods.append(q)
            counts[text + 1] += 1
            dropped[low + a + q] += 1
            dropped[low + b] -= 1
    keep = np.cumsum(dropped[:-1]) == 0
    kept = words.take(pa.array(codes[keep])) if len(words) else words
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (starts, lengths, periods)], ["start", "length", "period"])
    lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), kept.cast(pa.large_string()))
    collapsed = pa.compute.binary_join(lists, pa.scalar(" ", pa.large_string()))
    return pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), runs), collapsed], schema=_ARROW)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (ties: least start, then period), and digests of all runs and of the collapsed text."""
    runs = F.col("runs")
    # Of two exponents a/b and c/d, which are exact as a * d and c * b, the greater first.
    best = F.get(F.array_sort(runs, lambda x, y: F.coalesce(F.nullif(F.signum(y["length"] * x["period"] - x["length"] * y["period"]).cast("int"), F.lit(0)), F.nullif(F.signum(x["start"] - y["start"]).cast("int"), F.lit(0)), F.signum(x["period"] - y["period"]).cast("int"))), F.lit(0))
    lines = F.concat_ws("", F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    found = found.withColumn("__best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("__best.start").alias("start"),
        F.col("__best.length").alias("length"),
        F.col("__best.period").alias("period"),
        F.expr("1000 * __best.length div __best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
