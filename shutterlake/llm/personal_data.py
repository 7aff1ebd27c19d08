"""Personal data by bootstrapped contextual extraction.

Base rules find emails, IP addresses, cards and phones: the seeds. Long
hexadecimal keys are weak seeds of a further kind, secret: they teach contexts
but are reported only where a learned context holds them. The words around a
seed, whatever their case, are patterns; any run of identifier-like words in the
same context is an instance. Patterns and instances form a graph that Spark
scores in rounds: a pattern is as good as the share of its occurrences that are
trusted instances, an instance as good as the patterns it stands in. Instances
of patterns with high confidence are reported although no base rule fits them,
and so are plain words (handles, names) in such a context; plain words support
no pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Scratch, mix64, slices, text_buffer, words

#: Kinds of the base rules, and the kind that contexts alone can find.
BASE_KINDS, SECRET = ("email", "ip", "card", "phone"), 4
KINDS = (*BASE_KINDS, "secret")
#: A pattern needs this many different trusted instances, and this share of its occurrences;
#: an instance is trusted, and reported, at this confidence.
MIN_SUPPORT, MIN_PRECISION, MIN_CONFIDENCE = 5, 0.6, 0.8
#: Runs of more words than this are cut at their base spans: several identifiers side by side.
MOST_WORDS = 6

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A weak seed: 32 hexadecimal digits or more, of which some are letters.
_KEY = re.compile(r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])")

Span = tuple[int, int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits; true for an empty text."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Each match has one @, so the runs to its left and right decide, in one pass over the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1) if at > end and text[at - 1] in _LOCAL else None
        if m:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            yield start, 0, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) in code points, by start and then kind; matches of one kind do not overlap."""
    found: list[Span] = list(_emails(text))
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or "0") < 256 for part in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


_STRONG = np.zeros(256, bool)
_STRONG[[*b"0123456789@"]] = True
_INNER = np.zeros(256, bool)
_INNER[[*b"._()[]{}"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True
_ALNUM[128:] = True
_TAGS = np.array([0x51D7B1A7C2F3E945, 0xA3C59AC2F1B7D361, 0x6C8E9CF570932BD5], np.uint64)
_LEFT, _RIGHT = np.uint64(0x9E6C63D0876A9A35), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    return mix64(a * _LEFT + b * _RIGHT + _TAGS[kind])


@dataclass
class Scan:
    """Texts with their base spans, words and runs of identifier-like words."""

    texts: list[str]
    spans: list[list[Span]]
    raw: np.ndarray
    byte_at: np.ndarray
    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_at: np.ndarray
    plain: np.ndarray  # words that belong to no run
    first: np.ndarray  # of each run: first word, last word, text, kind (-1: no base span in it)
    last: np.ndarray
    text: np.ndarray
    kind: np.ndarray

    def bytes_of(self, i: int) -> np.ndarray:
        """Byte offset of each code point of text i, and of its end."""
        own = self.raw[self.byte_at[i] : self.byte_at[i + 1]]
        return np.append(np.flatnonzero((own & 0xC0) != 0x80), len(own))


def scan(column: pa.Array) -> Scan:
    """Base spans, words and runs of each text of a column; null counts as empty. Words that differ in the case of A-Z alone are one word."""
    texts = [t or "" for t in column.to_pylist()]
    spans = [base_spans(t) for t in texts]
    raw, byte_at = text_buffer(column)
    h, start, end, word_at = words(np.where((raw >= 65) & (raw <= 90), raw | 32, raw), byte_at)
    n = len(h)
    inner = np.zeros(len(raw), bool)
    if len(raw) > 2:
        inner[1:-1] = _INNER[raw[1:-1]] & _ALNUM[raw[:-2]] & _ALNUM[raw[2:]]
    sums = np.concatenate([[0], np.cumsum(_STRONG[raw] | inner)])
    like = sums[end] > sums[start] if n else np.zeros(0, bool)
    kind = np.full(n, -1, np.int64)
    opens, keys = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # words where a seed begins or has just ended; where a weak one does
    out = Scan(texts, spans, raw, byte_at, h, start, end, word_at, like, *[np.zeros(0, np.int64)] * 4)
    for i, own in enumerate(spans):
        seeds = [*own, *((m.start(), SECRET, m.end()) for m in _KEY.finditer(texts[i]))]
        if seeds:
            at = out.bytes_of(i) + byte_at[i]
            for s, k, e in reversed(seeds):
                a, b = np.searchsorted(end, at[s], "right"), np.searchsorted(start, at[e], "left")
                kind[a:b] = k
                like[a:b] = True
                opens[a] = opens[b] = True
                if k == SECRET:
                    keys[a] = keys[b] = True
    edge = np.zeros(n + 1, bool)
    edge[word_at] = True
    begins = like.copy()
    begins[1:] &= ~like[:-1] | edge[1:n]
    ends = like.copy()
    ends[:-1] &= ~like[1:] | edge[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    long = np.zeros(n + 1, np.int64)
    many = last - first >= MOST_WORDS
    np.add.at(long, first[many], 1)
    np.add.at(long, last[many] + 1, -1)
    cuts = like & (opens[:n] & (np.cumsum(long)[:n] > 0) | keys[:n])
    begins |= cuts
    ends[:-1] |= cuts[1:] & like[:-1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    out.plain = ~like
    out.first, out.last = first, last
    out.text = np.searchsorted(word_at, first, "right") - 1
    seeded = np.where(kind >= 0, np.arange(n), n)
    nearest = np.minimum.accumulate(seeded[::-1])[::-1] if n else seeded
    hit = nearest[first] if len(first) else first
    out.kind = np.where(hit <= last, kind[np.minimum(hit, max(n - 1, 0))], -1) if len(first) else first
    return out


def contexts(s: Scan, first: np.ndarray, last: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For the two words before, the word on each side, and the two words after: which of the word ranges have them, and their patterns."""
    low, high = s.word_at[text], s.word_at[text + 1]
    for kind, (a, b) in enumerate(((first - 2, first - 1), (first - 1, last + 1), (last + 1, last + 2))):
        has = np.flatnonzero((a >= low) & (b < high))
        yield has, _pair(s.h[a[has]], s.h[b[has]], kind)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64), pa.int64())


_BASE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, k1, k2, text -> the base spans of each row, and a row for each run and pattern around it."""
    names = ["doc_id", "k1", "k2", "spans", "pattern", "instance", "kind", "start", "end"]
    for batch in batches:
        for part in slices(batch, "text"):
            s = scan(part.column(3))
            k1, k2 = np.asarray(part.column(1)), np.asarray(part.column(2))
            n = len(s.texts)
            spans = pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in own] for own in s.spans], _BASE)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], spans, *[pa.nulls(n, pa.int64())] * 2, *[pa.nulls(n, pa.int32())] * 3], names=names)
            if not len(s.first):
                continue
            begin, stop = _trimmed(s, s.first, s.last, s.text, (s.kind < 0) | (s.kind == SECRET))
            instance = _instances(s)
            rows, patterns = [], []
            for has, found in contexts(s, s.first, s.last, s.text):
                rows.append(has)
                patterns.append(found)
            r, p = np.concatenate(rows), np.concatenate(patterns)
            if len(r):
                t = s.text[r]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(r), pa.int64()), pa.array(k1[t]), pa.array(k2[t]), pa.nulls(len(r), _BASE), _signed(p), _signed(instance[r]), pa.array(s.kind[r].astype(np.int32)), pa.array(begin[r].astype(np.int32)), pa.array(stop[r].astype(np.int32))], names=names)


def _instances(s: Scan) -> np.ndarray:
    """A hash of all words of each run, in their order."""
    size = s.last - s.first + 1
    start = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(start, size)
    return mix64(np.add.reduceat(mix64(s.h[np.repeat(s.first, size) + place] + place.astype(np.uint64) * _LEFT), start))


def _trimmed(s: Scan, first: np.ndarray, last: np.ndarray, text: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each wanted range of words in code points of its text, without punctuation at its ends."""
    begin, stop = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    at, known = np.zeros(1, np.int64), -1
    for r in np.flatnonzero(wanted):
        a, b, i = s.start[first[r]], s.end[last[r]], text[r]
        if i != known:
            at, known = s.bytes_of(int(i)), i
        x, y = np.searchsorted(at, (a - s.byte_at[i], b - s.byte_at[i]))
        own = s.texts[i][x:y]
        left = next((k for k, c in enumerate(own) if c.isalnum()), 0)
        right = next((k for k, c in enumerate(reversed(own)) if c.isalnum()), 0)
        begin[r], stop[r] = x + left, y - right
    return begin, stop


_BITS = 20


def _backgrounds(bitmap: np.ndarray):
    """text -> pattern, n: plain words that stand in a context, where the bitmap does not exclude its pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = scan(part.column(0))
                at = np.flatnonzero(s.plain)
                found = [p[bitmap[p >> np.uint64(64 - _BITS)]] for _, p in contexts(s, at, at, np.searchsorted(s.word_at, at, "right") - 1)]
                pattern, count = np.unique(np.concatenate(found), return_counts=True)
                if len(pattern):
                    yield pa.RecordBatch.from_arrays([_signed(pattern), pa.array(count.astype(np.int64))], names=["pattern", "n"])

    return run


def _plain_hits(bitmap: np.ndarray):
    """k1, k2, text -> each plain word in a context whose pattern the bitmap does not exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = scan(part.column(2))
                at = np.flatnonzero(s.plain)
                own = np.searchsorted(s.word_at, at, "right") - 1
                rows, patterns = [], []
                for has, p in contexts(s, at, at, own):
                    hit = bitmap[p >> np.uint64(64 - _BITS)]
                    rows.append(has[hit])
                    patterns.append(p[hit])
                r, p = np.concatenate(rows), np.concatenate(patterns)
                order = np.argsort(r, kind="stable")
                r, p = r[order], p[order]
                if len(r):
                    begin, stop = _trimmed(s, at[r], at[r], own[r], np.ones(len(r), bool))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(own[r])), part.column(1).take(pa.array(own[r])), _signed(p), pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32))], names=["k1", "k2", "pattern", "start", "end"])

    return run


def _bitmap(patterns: DataFrame) -> np.ndarray:
    """Which first bits patterns have. Its size is fixed, 2^20 bits; with very many patterns it lets more rows through, with the same result."""
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[[r[0] for r in patterns.select(F.shiftrightunsigned("pattern", 64 - _BITS).alias("b")).distinct().collect()]] = True
    return bitmap


def _patterns(edges: DataFrame, totals: DataFrame, trusted: DataFrame) -> DataFrame:
    """pattern, kind, precision of the patterns with enough trusted instances of their best kind."""
    support = edges.join(trusted, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support"))
    good = support.where(F.col("support") >= MIN_SUPPORT).join(totals, "pattern").withColumn("precision", F.col("support") / F.col("total")).where(F.col("precision") >= MIN_PRECISION)
    return good.groupBy("pattern").agg(F.max(F.struct("precision", (-F.col("kind")).alias("k"))).alias("b")).select("pattern", (-F.col("b.k")).alias("kind"), F.least("b.precision", F.lit(0.999)).alias("precision"))


def _noisy_or(precision: Column) -> Column:
    return 1 - F.exp(F.sum(F.log1p(-precision)))


def _confident(hits: DataFrame, *key: str) -> DataFrame:
    """key, kind, score: the best kind of each key whose patterns agree on it with MIN_CONFIDENCE."""
    by_kind = hits.groupBy(*key, "kind").agg(_noisy_or(F.col("precision")).alias("score")).where(F.col("score") >= MIN_CONFIDENCE)
    return by_kind.groupBy(*key).agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b")).select(*key, (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans of each row of documents(doc_id, text).

    base and spans: arrays of (start, kind, end), kind an index in KINDS, in
    code points, by start and then kind; spans holds base and what the patterns
    found. Null and empty texts have none. Rows that repeat, and rows without a
    doc_id, have results of their own. No pattern reaches the limits in a table
    without seeds; the base spans are then all.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(5), text, doc_id).alias("k2"), text.alias("text"))
    schema = "doc_id long, k1 long, k2 long, spans array<struct<start:int,kind:int,end:int>>, pattern long, instance long, kind int, start int, end int"
    measured = scratch.write(keyed.mapInArrow(_measure, schema), "measured")
    runs = measured.where(F.col("pattern").isNotNull())
    edges = runs.groupBy("pattern", "instance").agg(F.max("kind").alias("seed"))
    frequent = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"), F.count_if(F.col("seed") >= 0).alias("seeds")).where(F.col("instances") >= MIN_SUPPORT)
    frequent = scratch.write(frequent, "patterns")
    found: DataFrame | None = None
    if frequent.where(F.col("seeds") >= MIN_SUPPORT).limit(1).count():
        background = keyed.select("text").mapInArrow(_backgrounds(_bitmap(frequent)), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
        totals = scratch.write(frequent.join(background, "pattern", "left").select("pattern", (F.col("instances") + F.coalesce("n", F.lit(0))).alias("total")), "totals")
        edges = scratch.write(edges.join(frequent.select("pattern"), "pattern"), "edges")
        seeds = edges.where(F.col("seed") >= 0).groupBy("instance").agg(F.max("seed").alias("kind")).withColumn("score", F.lit(1.0))
        trusted = scratch.write(seeds, "trusted")
        # Until the patterns and their precision stand still; a state that comes again would come for ever.
        states: set[tuple] = set()
        while True:
            patterns = scratch.write(_patterns(edges.select("pattern", "instance"), totals, trusted), "scored")
            scratch.drop(trusted)
            state = tuple(patterns.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("pattern", "kind", F.round("precision", 3)))).first())
            if state in states or not state[0]:
                break
            states.add(state)
            new = edges.where(F.col("seed") < 0).join(patterns, "pattern")
            trusted = scratch.write(seeds.unionByName(_confident(new, "instance")), "trusted")
            scratch.drop(patterns)
        scratch.drop(edges, totals, frequent)
        places = runs.where((F.col("kind") < 0) | (F.col("kind") == SECRET)).select("k1", "k2", "pattern", "start", "end")
        if state[0]:
            places = places.unionByName(keyed.select("k1", "k2", "text").mapInArrow(_plain_hits(_bitmap(patterns)), "k1 long, k2 long, pattern long, start int, end int"))
        hits = places.distinct().join(patterns, "pattern")
        found = _confident(hits, "k1", "k2", "start", "end").where(F.col("start") < F.col("end"))
    out = measured.where(F.col("spans").isNotNull()).select("doc_id", "k1", "k2", F.col("spans").alias("base"))
    if found is None:
        return out.select("doc_id", "base", F.col("base").alias("spans"))
    more = found.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    both = out.join(more, ["k1", "k2"], "left")
    return both.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
