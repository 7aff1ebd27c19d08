"""Benchmark decontamination: passages within a small edit distance of an item.

Texts become word hashes, lower-cased and without ASCII punctuation. Item-sized
windows are embedded by CGK random walks, which map edit distance to Hamming
distance; each repetition samples a few coordinates as its key. The number of
repetitions is calibrated until a window with the most edits allowed is found
with the target recall. Candidates pass an exact edit-distance check.

Windows that cannot be within the distance are not embedded: k edits leave at
least one run of q unchanged words of the item, so a window needs a q-gram of
an item near the place where that item has it. This loses nothing.

Items too short for a walk, and lengths at which MOST_REPETITIONS do not reach
the target, go without keys: every place that shares a q-gram with such an item
is checked by exact edit distance.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import grams_of, mix64, slices, text_buffer, words

#: Items of fewer words have no walk.
MIN_WORDS, EDIT_SHARE, TARGET = 6, 0.2, 0.99
SAMPLES, MOST_REPETITIONS = 4, 256
#: Items that a task holds at once (about 100 MB): the documents are read once for each such block.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 8_000_000
_PUNCT = np.zeros(256, bool)
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_STEP = np.uint64(0x9FB21C651E98DF25)


def plain_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without ASCII punctuation, and the texts' offsets in them."""
    raw, offsets = text_buffer(pc.utf8_lower(pc.fill_null(column, "")))
    stay = ~_PUNCT[raw]
    moved = np.concatenate([[0], np.cumsum(stay)])[offsets]
    h, _, _, word_offsets = words(raw[stay], moved)
    return h, word_offsets


def edits_allowed(n: int, share: float = EDIT_SHARE) -> int:
    """How many words of an item of n words may differ."""
    return int(share * n + 1e-9)


def sure_run(n: int, share: float = EDIT_SHARE) -> int:
    """Words of the longest run that as many edits as allowed leave unchanged in an item of n words, whatever they are."""
    k = edits_allowed(n, share)
    return math.ceil((n - k) / (k + 1))


def embed(h: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int, coins: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """Keys (repetitions x windows): the sampled coordinates of each window's CGK walk. A window has size words, or fewer where stop cuts it; beyond it the walk reads zero."""
    reps, steps = coins.shape
    width = size + steps
    inner = np.arange(size)
    at = start[:, None] + inner
    flat = np.zeros((len(start), width), np.uint64)
    flat[:, :size] = np.where(at < np.minimum(start + size, stop)[:, None], h[np.minimum(at, len(h) - 1)], np.uint64(0))
    flat = flat.ravel()
    # Walks end at their last sampled step; those that end late come last.
    last = steps - np.argmax(sampled[:, ::-1], axis=1)
    order = np.argsort(last, kind="stable")
    coins, sampled, last = coins[order], sampled[order], last[order]
    pointer = np.tile(np.arange(len(start), dtype=np.int64) * width, (reps, 1))
    key = np.zeros((reps, len(start)), np.uint64)
    for j in range(steps):
        on = int(np.searchsorted(last, j, "right"))
        if on == reps:
            break
        symbol = flat[pointer[on:]]
        pick = np.flatnonzero(sampled[on:, j])
        if len(pick):
            value = (key[on + pick] + symbol[pick]) * _STEP
            key[on + pick] = value ^ (value >> np.uint64(29))
        symbol *= coins[on:, j : j + 1]
        symbol >>= np.uint64(63)
        pointer[on:] += symbol.view(np.int64)
    out = np.empty_like(key)
    out[order] = key
    return out


@dataclass
class LengthClass:
    """Items whose number of words lies in [size, size * 1.25): their walks read the first `size` words, the exact check all.

    A class without repetitions has no walks: `items` then tells which item has each gram, and `low` where.
    """

    size: int
    q: int
    coins: np.ndarray
    sampled: np.ndarray
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    gram: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    low: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    items: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Index:
    """Searches texts for a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], share: float = EDIT_SHARE, target: float = TARGET) -> None:
        texts = pa.array([t or "" for _, t in items], pa.string())
        h, offsets = plain_words(texts)
        self.share, self.ids = share, [i for i, _ in items]
        self.items = [h[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        by_size: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(self.items):
            if len(x):  # short items: one class for each length
                by_size[len(x) - MIN_WORDS if len(x) < MIN_WORDS else int(math.log(len(x) / MIN_WORDS) / math.log(1.25) + 1e-9)].append(i)
        self.classes = [self._class(min(len(self.items[i]) for i in group), group, target) for group in by_size.values()]
        self.bits: dict[int, np.ndarray] = {}
        for c in self.classes:
            self.bits.setdefault(c.q, np.zeros(1 << 21, bool))[c.gram >> np.uint64(43)] = True

    def _class(self, size: int, group: list[int], target: float) -> LengthClass:
        rng = np.random.default_rng(size)
        steps = max(4, int(1.5 * size))
        q = min(sure_run(len(self.items[i]), self.share) for i in group)

        def draw(reps: int) -> tuple[np.ndarray, np.ndarray]:
            coins = rng.integers(1, 1 << 63, (reps, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            # A repetition samples steps near each other: edits elsewhere do not part them.
            near = max(2 * SAMPLES, steps // 5)
            block = rng.integers(0, max(1, steps - near + 1), (reps, 1))
            inside = (np.arange(steps) >= block) & (np.arange(steps) < block + near)
            order = np.argsort(np.argsort(np.where(inside, rng.random((reps, steps)), 2), axis=1), axis=1)
            return coins, (order < SAMPLES) & inside

        reps = self._repetitions(size, group, target, *draw(128), rng) if size >= MIN_WORDS else 0
        found = LengthClass(size, q, *draw(reps))
        grams = [grams_of(self.items[i], q) for i in group]
        if not reps:
            every = np.concatenate(grams)
            order = np.argsort(every, kind="stable")
            found.gram = every[order]
            found.items = np.repeat(group, [len(g) for g in grams])[order]
            found.low = found.high = np.concatenate([np.arange(len(g)) for g in grams])[order]
            return found
        packed = np.concatenate([self.items[i] for i in group])
        ends = np.cumsum([len(self.items[i]) for i in group])
        starts = ends - [len(self.items[i]) for i in group]
        keys = embed(packed, starts, ends, size, found.coins, found.sampled)
        for row in keys:
            order = np.argsort(row, kind="stable")
            found.keys.append((row[order], np.array(group)[order]))
        # Where an item's gram may lie after the start of a window: its offset, give or take the edits.
        reach: dict[int, list[int]] = {}
        for i, own in zip(group, grams, strict=True):
            k = edits_allowed(len(self.items[i]), self.share)
            for at, g in enumerate(own.tolist()):
                low, high = reach.get(g, (1 << 40, -1))
                reach[g] = [min(low, at - k), max(high, at + k)]
        found.gram = np.array(sorted(reach), np.uint64)
        found.low = np.array([reach[int(g)][0] for g in found.gram], np.int64)
        found.high = np.array([reach[int(g)][1] for g in found.gram], np.int64)
        return found

    def _repetitions(self, size: int, group: list[int], target: float, coins: np.ndarray, sampled: np.ndarray, rng: np.random.Generator) -> int:
        """So many that mean recall over all items of the class, edited as much as allowed, reaches the target; 0 if MOST_REPETITIONS do not."""
        miss: list[np.ndarray] = []
        for at in range(0, len(group), 128):
            rows, pairs = [], []
            for i in group[at : at + 128]:
                item = self.items[i].tolist()
                own = len(rows)
                rows.append(item)
                for kind in range(3):
                    edited = list(item)
                    for _ in range(edits_allowed(len(item), self.share)):
                        place = int(rng.integers(0, len(edited)))
                        if kind == 0:
                            edited[place] = int(rng.integers(1, 1 << 63))
                        elif kind == 1 and len(edited) > 1:
                            del edited[place]
                        else:
                            edited.insert(place, int(rng.integers(1, 1 << 63)))
                    pairs.append((own, len(rows)))
                    rows.append(edited)
            ends = np.cumsum([len(r) for r in rows])
            keys = embed(np.concatenate([np.array(r, np.uint64) for r in rows]), ends - [len(r) for r in rows], ends, size, coins, sampled)
            a, b = np.array(pairs).T
            miss.append(1 - (keys[:, a] == keys[:, b]).mean(axis=0))
        every = np.concatenate(miss)
        for reps in range(4, MOST_REPETITIONS + 1, 4):
            if 1 - (every**reps).mean() >= target:
                return reps
        return 0

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, first word, last word + 1, edit distance) of each passage found; of passages of one item that overlap, the nearest."""
        if not self.classes:
            return
        h, offsets = plain_words(column)
        candidates: set[tuple[int, int, int]] = set()
        for q, bits in self.bits.items():
            if len(h) < q:
                continue
            g = grams_of(h, q)
            hit = np.flatnonzero(bits[g >> np.uint64(43)])
            row = np.searchsorted(offsets, hit, "right") - 1
            inside = hit + q <= offsets[row + 1]
            hit, row = hit[inside], row[inside]
            for c in self.classes:
                if c.q == q and len(hit):
                    (self._walks if c.keys else self._places)(c, h, offsets, hit, row, g[hit], candidates)
        yield from self._verified(h, offsets, candidates)

    def _places(self, c: LengthClass, h: np.ndarray, offsets: np.ndarray, hit: np.ndarray, row: np.ndarray, values: np.ndarray, candidates: set[tuple[int, int, int]]) -> None:
        """Every place where a gram of an item stands."""
        a, b = np.searchsorted(c.gram, values, "left"), np.searchsorted(c.gram, values, "right")
        own = np.repeat(np.arange(len(hit)), b - a)
        entry = np.arange(len(own)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[own]
        start = np.maximum(hit[own] - c.low[entry], offsets[row[own]])
        candidates.update(zip(row[own].tolist(), c.items[entry].tolist(), start.tolist(), strict=True))

    def _walks(self, c: LengthClass, h: np.ndarray, offsets: np.ndarray, hit: np.ndarray, row: np.ndarray, values: np.ndarray, candidates: set[tuple[int, int, int]]) -> None:
        """Windows near a gram of an item that share a key with an item. Equal windows walk once."""
        place = np.minimum(np.searchsorted(c.gram, values), len(c.gram) - 1)
        own = np.flatnonzero(c.gram[place] == values)
        if not len(own):
            return
        place = place[own]
        first = np.maximum(hit[own] - c.high[place], offsets[row[own]])
        last = np.minimum(np.maximum(hit[own] - c.low[place], first), offsets[row[own] + 1] - 1)
        # The windows first..last of all hits, each once.
        opened = np.zeros(len(h) + 1, np.int64)
        np.add.at(opened, first, 1)
        np.add.at(opened, last + 1, -1)
        windows = np.flatnonzero(np.cumsum(opened)[:-1] > 0)
        doc = np.searchsorted(offsets, windows, "right") - 1
        stop = np.minimum(windows + c.size, offsets[doc + 1])
        _, one, same = np.unique(window_hashes(h, windows, stop), return_index=True, return_inverse=True)
        order = np.argsort(same, kind="stable")
        bounds = np.searchsorted(same[order], np.arange(len(one) + 1))
        for at in range(0, len(one), 4096):
            part = one[at : at + 4096]
            keys = embed(h, windows[part], stop[part], c.size, c.coins, c.sampled)
            for found, (sorted_keys, items) in zip(keys, c.keys, strict=True):
                a, b = np.searchsorted(sorted_keys, found, "left"), np.searchsorted(sorted_keys, found, "right")
                for w in np.flatnonzero(b > a):
                    alike = order[bounds[at + w] : bounds[at + w + 1]]
                    for i in items[a[w] : b[w]].tolist():
                        candidates.update(zip(doc[alike].tolist(), [i] * len(alike), windows[alike].tolist(), strict=True))

    def _verified(self, h: np.ndarray, offsets: np.ndarray, candidates: set[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
        held: tuple[int, int, int, int, int] | None = None
        checked: tuple[int, int, int] | None = None
        for doc, item, start in sorted(candidates):
            n = len(self.items[item])
            k = edits_allowed(n, self.share)
            if checked and checked[:2] == (doc, item) and start <= checked[2]:
                continue  # the last region checked holds this window
            low = max(start - k, offsets[doc])
            high = min(start + n + 3 * k + 2, offsets[doc + 1])
            checked = (doc, item, start + k)
            distance, end = nearest(self.items[item].tolist(), h[low:high].tolist())
            if distance > k:
                continue
            end += low
            begin = end - nearest_start(self.items[item].tolist(), h[low:end].tolist(), distance)
            new = (doc, item, int(begin - offsets[doc]), int(end - offsets[doc]), distance)
            if held and held[:2] == new[:2] and new[2] < held[3]:
                held = min(held, new, key=lambda x: x[4])
                continue
            if held:
                yield held
            held = new
        if held:
            yield held


def window_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of the words start..stop of each window."""
    step = 0x9E3779B97F4A7C15
    up, down = np.ones(len(h) + 1, np.uint64), np.ones(len(h) + 1, np.uint64)
    up[1:], down[1:] = np.uint64(step), np.uint64(pow(step, -1, 1 << 64))
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(h) * up[:-1])])
    return mix64((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def nearest(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of the text, and where the first such part ends. Bit-parallel."""
    n = len(pattern)
    full, top = (1 << n) - 1, 1 << (n - 1)
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(pattern):
        where[x] |= 1 << i
    plus, minus, score = full, 0, n
    best, at = n, 0
    for j, x in enumerate(text):
        same = where.get(x, 0)
        v = same | minus
        d = (((same & plus) + plus) ^ plus) | same
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(v | up)), up & v
        if score < best:
            best, at = score, j + 1
    return best, at


def nearest_start(pattern: list[int], text: list[int], distance: int) -> int:
    """How many last words of the text make a part within the distance: the pattern read backwards, ends fixed."""
    n, row = len(pattern), list(range(len(pattern) + 1))
    back, best = pattern[::-1], None
    for j, x in enumerate(reversed(text), 1):
        new = [j]
        for i in range(n):
            new.append(min(row[i] + (back[i] != x), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[n] <= distance:
            best = j if best is None or row[n] < distance else best
            break
    return best if best is not None else min(n, len(text))


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """Items with a text, in blocks of about BLOCK_ITEMS and BLOCK_CHARS: what a task holds does not grow with the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars")).first()
    blocks = max(math.ceil(size.n / BLOCK_ITEMS), math.ceil((size.chars or 0) / BLOCK_CHARS))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield sorted(((r.item_id, r.text) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


LEAKS = "doc_id long, item_id long, first_word long, end_word long, edits long, item_words long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, target: float = TARGET) -> DataFrame:
    """Passages of documents(doc_id, text) within share * words edits of an item of benchmark(item_id, text).

    One row per passage: doc_id, item_id, first_word, end_word (words of the
    document, end exclusive), edits, item_words. Null and empty texts hold
    none; an item without words is in none, one of a single word is wherever
    that word is; equal items are each reported; a benchmark without items gives
    no rows. The documents are read once for each block of items, without a
    shuffle.
    """
    out = None
    for items in item_blocks(benchmark):
        index = Index(items, share, target)

        def scan(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    ids = part.column(0)
                    rows = [(ids[d].as_py(), index.ids[i], a, b, e, len(index.items[i])) for d, i, a, b, e in index.search(part.column(1))]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "item_id", "first_word", "end_word", "edits", "item_words"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, LEAKS)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], LEAKS) if out is None else out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE, target: float = TARGET) -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no passage of find_leaks."""
    at = docs.columns.index("text")
    for items in item_blocks(benchmark):
        index = Index(items, share, target)

        def scan(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    clean = np.ones(part.num_rows, bool)
                    clean[[d for d, *_ in index.search(part.column(at))]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(scan, docs.schema)
    return docs
