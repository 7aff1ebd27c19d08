"""N-gram Jaccard join of documents with themselves by a MinHash LSH forest.

Texts that are equal share one class, so copies cost one row. Each class has
one label per tree: the low bits of `depth` MinHash values. Sorting the labels
of a tree gives its prefix trie; two classes are candidates if their labels in
any tree share a prefix, and all candidates are verified by the exact Jaccard
coefficient of their shingle sets.

The prefix starts as the whole label. Each link found has a similarity, and with
it the probability that prefixes of this length find such a link; the links
found, each over its probability, and as many as UNSEEN just at the threshold,
estimate how many there are. Prefixes are shortened until the links found reach
the target share of that estimate, or the length at which even a pair just at
the threshold is found with the target probability. UNSEEN stands for what no
found link speaks of: where few links were found, or none, all lengths are
tried. A shorter prefix verifies only what the longer one did not.

Large groups: sorted runs are linked as stars, components of the stars are
cut into blocks of BLOCK classes, or BLOCK_BYTES of shingles, and each pair of
blocks is verified in one task, which returns sums and a spanning forest, never
the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Scratch, may_match, mix64, shingles, slices, text_buffer, words
from shutterlake.llm.components import connected_components, contract

TREES, DEPTH, TARGET = 32, 10, 0.999
BLOCK, BLOCK_BYTES = 512, 64 << 20
#: Links just at the threshold that may be there for all that the links found tell.
UNSEEN = 1000


def choose_depth(threshold: float, target: float = TARGET, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold shares one in some tree with probability target or more."""
    while depth > 1 and found_share(threshold, depth, trees) < target:
        depth -= 1
    return depth


def found_share(similarity: np.ndarray | float, prefix: int, trees: int = TREES) -> np.ndarray | float:
    """The probability that a pair shares a prefix of this length in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def next_prefix(links: dict[int, int], prefix: int, least: int, target: float, threshold: float, trees: int = TREES) -> int | None:
    """The longest shorter prefix, not below the least, that is expected to reach the target; null if this one does. links: how many were found, by percent of similarity."""
    if prefix <= least:
        return None
    at = np.array([threshold, *[min(k / 100 + 0.005, 1.0) for k in sorted(links)]])
    true = np.array([UNSEEN, *[links[k] for k in sorted(links)]]) / np.array([1.0, *found_share(at[1:], prefix, trees)])
    reached = lambda p: (true * found_share(at, p, trees)).sum() / true.sum()
    if reached(prefix) >= target:
        return None
    return next((p for p in range(prefix - 1, least, -1) if reached(p) >= target), least)


def signatures(hashes: np.ndarray, offsets: np.ndarray, values: int) -> np.ndarray:
    """MinHash values of each text, 16 bits each: texts x values. Texts without shingles have zeros."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    rng = np.random.default_rng(77)
    xor = rng.integers(0, 1 << 32, values, dtype=np.uint32)
    times = rng.integers(0, 1 << 32, values, dtype=np.uint32) | np.uint32(1)
    size = np.diff(offsets)
    out = np.zeros((len(size), values), np.uint16)
    full = np.flatnonzero(size > 0)
    at = offsets[:-1][full]
    step = 1 << 16
    firsts = np.searchsorted(at, np.arange(0, len(h) + step, step))
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if a == b:
            continue
        low, high = at[a], at[b] if b < len(at) else len(h)
        part, starts = h[low:high], at[a:b] - low
        for v in range(values):
            least = np.minimum.reduceat((part ^ xor[v]) * times[v], starts)
            out[full[a:b], v] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def _sign(trees: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, _, _, offsets = words(*text_buffer(part.column(2)))
                s, s_offsets = shingles(h, offsets)
                sig = signatures(s, s_offsets, trees * depth)
                raw = sig.astype(">u2").tobytes()
                width = 2 * trees * depth
                body = pa.Array.from_buffers(pa.binary(), len(sig), [None, pa.py_buffer(np.arange(0, width * (len(sig) + 1), width, dtype=np.int32).tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), body, pa.array(np.diff(s_offsets) > 0)], names=["doc_id", "ck", "sig", "filled"])

    return run


def _stars(depth: int, least: int):
    """Over sorted (tree, label, ck): an edge from each class that shares `least` values or more with the one before it.

    With the number of shared values as its prefix length, the edge leads to the
    first class of the run that shares so many; the edges of one length and all
    longer ones join just the runs of that length. For each length the first and
    last run of the partition are given too, with their prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("tree", pa.int32()), ("prefix", pa.binary()), ("a", pa.binary()), ("b", pa.binary()), ("length", pa.int32())])
        lengths = range(least, depth + 1)
        heads: dict[int, bytes] = {}
        last: tuple[int, np.ndarray] | None = None

        def border(tree: int, label: np.ndarray, firsts: dict[int, bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"tree": tree, "prefix": label[:d].tobytes(), "a": firsts[d], "b": None, "length": d} for d in lengths], schema=types)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tree = np.asarray(batch.column(0), np.int64)
            label = text_buffer(batch.column(1))[0].view(">u2").reshape(n, depth)
            ck = batch.column(2)
            same = np.zeros((n, depth), bool)
            same[1:] = (label[1:] == label[:-1]) & (tree[1:] == tree[:-1])[:, None]
            if last is None:
                yield border(int(tree[0]), label[0], dict.fromkeys(lengths, ck[0].as_py()))
            else:
                same[0] = (label[0] == last[1]) & (tree[0] == last[0])
            shared = np.cumprod(same, axis=1).sum(axis=1)
            rows = np.flatnonzero(shared >= least)
            head = np.full(n, -1)
            before = dict(heads)
            for d in lengths:
                start = np.maximum.accumulate(np.where(shared < d, np.arange(n), -1))
                own = shared == d
                head[own] = start[own]
                if start[-1] >= 0:
                    heads[d] = ck[int(start[-1])].as_py()
            if len(rows):
                b = ck.take(pa.array(np.maximum(head[rows], 0))).to_pylist()
                b = [before[int(shared[r])] if head[r] < 0 else x for r, x in zip(rows, b, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), ck.take(pa.array(rows)), pa.array(b, pa.binary()), pa.array(shared[rows].astype(np.int32))], schema=types)
            last = (int(tree[-1]), label[-1].copy())
        if last is not None:
            yield border(*last, heads)

    return run


def _shingle_sets(trees: int, depth: int, least: int):
    """ck, text -> ck, its sorted distinct shingles, and the hashes of each tree's prefixes of `least` to `depth` values, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, _, _, offsets = words(*text_buffer(part.column(1)))
                s, s_offsets = shingles(h, offsets)
                sig = signatures(s, s_offsets, trees * depth)
                keys = np.hstack([tree_keys(sig, trees, depth, p) for p in range(least, depth + 1)])
                sets = [np.unique(s[a:b]).tobytes() for a, b in zip(s_offsets[:-1], s_offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary()), pa.array([k.tobytes() for k in keys], pa.binary())], names=["ck", "sets", "keys"])

    return run


def tree_keys(sig: np.ndarray, trees: int, depth: int, prefix: int) -> np.ndarray:
    """A 32-bit hash of the first `prefix` values of each tree: texts x trees."""
    parts = sig.reshape(len(sig), trees, depth)[:, :, :prefix].astype(np.uint64)
    total = np.zeros((len(sig), trees), np.uint64)
    for k in range(prefix):
        total = mix64(total + parts[:, :, k] + np.uint64(k + 1))
    return (total >> np.uint64(32)).astype(np.uint32)


def verify_block(cks: list[bytes], side: np.ndarray, across: bool, sets: list[np.ndarray], keys: np.ndarray, trees: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """Links of each class in the block, a spanning forest of them, and their number by percent of similarity.

    Pairs are within the block, or across the two sides.
    A pair is a candidate if it shares a prefix in any tree, but for those that
    share one of the longer prefixes, verified before, whose keys come behind.
    """
    n, links = len(cks), np.zeros(len(cks), np.int64)
    size = np.array([len(s) for s in sets], np.int64)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest: list[tuple[int, int]] = []
    percents = np.zeros(101, np.int64)
    for i in range(n):
        others = np.arange(i + 1, n)
        if across:
            others = others[side[others] != side[i]]
        least, most = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
        others = others[least >= threshold * most - 1e-9]
        equal = keys[others] == keys[i]
        others = others[equal[:, :trees].any(axis=1) & ~equal[:, trees:].any(axis=1)]
        if not len(others) or not size[i]:
            continue
        joined = np.concatenate([sets[j] for j in others])
        place = np.minimum(np.searchsorted(sets[i], joined), size[i] - 1)
        both = np.add.reduceat((sets[i][place] == joined).astype(np.int64), np.concatenate([[0], np.cumsum(size[others])[:-1]]))
        union = size[others] + size[i] - both
        linked = both >= threshold * union - 1e-9
        percents += np.bincount(100 * both[linked] // union[linked], minlength=101)
        for j in others[linked]:
            links[i] += 1
            links[j] += 1
            x, y = find(i), find(int(j))
            if x != y:
                root[x] = y
                forest.append((i, int(j)))
    return links, forest, percents


def _verify(trees: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("links", pa.int64()), ("percent", pa.int32())])
        held: list[tuple] = []
        group: tuple | None = None

        def result() -> pa.RecordBatch:
            cks = [r[0] for r in held]
            keys = np.array([np.frombuffer(r[3], np.uint32) for r in held]).reshape(len(held), -1)
            links, forest, percents = verify_block(cks, np.array([r[1] for r in held]), group[1] != group[2], [np.frombuffer(r[2], np.uint64) for r in held], keys, trees, threshold)
            some, alike = np.flatnonzero(links), np.flatnonzero(percents)
            a = [*[cks[i] for i in some], *[cks[i] for i, _ in forest], *[None] * len(alike)]
            b = [*[None] * len(some), *[cks[j] for _, j in forest], *[None] * len(alike)]
            n = [*links[some].tolist(), *[0] * len(forest), *percents[alike].tolist()]
            percent = [*[None] * (len(some) + len(forest)), *alike.tolist()]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64()), pa.array(percent, pa.int32())], schema=types)

        for batch in batches:
            for comp, bi, bj, side, ck, sets, keys in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group != (comp, bi, bj):
                    if len(held) > 1:
                        yield result()
                    held, group = [], (comp, bi, bj)
                held.append((ck, side, sets, keys))
        if len(held) > 1:
            yield result()

    return run


def jaccard_links(docs: DataFrame, threshold: float = 0.8, target: float = TARGET, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, class_id, n_links, n_copies.

    class_id: the smallest doc_id of the document's group, which holds equal
    texts and, over any chain of links, texts whose sets of five-word shingles
    have a Jaccard coefficient of threshold or more. n_links: the number of
    other texts linked to this text. n_copies: rows with this very text. A text
    of one to four words is one shingle; texts without words (and null) are
    equal only to equal texts. A null doc_id gets the class of its text; a group
    without any doc_id has a null class_id.
    """
    signed, classed = _classes(docs, threshold, target, trees, depth, block)
    leaders = classed.groupBy("grp").agg(F.min("least").alias("class_id"))
    table = classed.join(leaders, "grp").select("ck", "class_id", "n_links", "n_copies")
    return signed.select("doc_id", "ck").join(table, "ck").select("doc_id", "class_id", "n_links", "n_copies")


def _classes(docs: DataFrame, threshold: float, target: float = TARGET, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """doc_id, ck of each row, and ck, grp, least (the least doc_id), n_links, n_copies of each text."""
    scratch = Scratch(docs.sparkSession)
    least = choose_depth(threshold, target, trees, depth)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("ck"), text.alias("text"))
    signed = scratch.write(base.mapInArrow(_sign(trees, depth), "doc_id long, ck binary, sig binary, filled boolean"), "signed")

    classes = signed.where("filled").groupBy("ck").agg(F.first("sig").alias("sig"))
    labels = classes.select("ck", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "sig").select("tree", F.substring(F.col("sig"), F.col("tree") * (2 * depth) + 1, F.lit(2 * depth)).alias("label"), "ck")
    labels = scratch.write(labels, "labels")
    runs = scratch.write(labels.repartitionByRange("tree", "label", "ck").sortWithinPartitions("tree", "label", "ck").mapInArrow(_stars(depth, least), "tree int, prefix binary, a binary, b binary, length int"), "runs")
    scratch.drop(labels)
    sets = _sets_of(base, signed, _stars_of(runs, least), scratch, trees, depth, least)

    prefix, done = depth, None
    rounds: list[DataFrame] = []
    while True:
        rounds.append(_verified_links(sets, runs, scratch, prefix, done, trees, least, threshold, block))
        counted = rounds[0] if len(rounds) == 1 else reduce(DataFrame.unionByName, rounds)
        percents = counted.where(F.col("percent").isNotNull()).groupBy("percent").agg(F.sum("links").alias("n")).collect()
        shorter = next_prefix({r.percent: r.n for r in percents}, prefix, least, target, threshold, trees)
        if shorter is None:
            break
        prefix, done = shorter, prefix
    scratch.drop(runs, sets)

    found = counted.where(F.col("percent").isNull())
    links = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("ck")).agg(F.sum("links").alias("n_links"))
    groups = connected_components(found.where(F.col("b").isNotNull()), scratch).select(F.col("node").alias("ck"), F.col("label").alias("grp"))
    copies = signed.groupBy("ck").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"))
    classed = copies.join(groups, "ck", "left").join(links, "ck", "left").withColumn("grp", F.coalesce("grp", "ck"))
    return signed, classed.select("ck", "grp", "least", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "n_copies")


def _stars_of(runs: DataFrame, prefix: int) -> DataFrame:
    """a, b: edges that join the runs of this prefix length, within partitions and across their borders."""
    ends = runs.where(F.col("b").isNull() & (F.col("length") == prefix)).select("tree", "prefix", "a").distinct()
    across = ends.join(ends.groupBy("tree", "prefix").agg(F.min("a").alias("b")), ["tree", "prefix"]).select("a", "b")
    return runs.where(F.col("b").isNotNull() & (F.col("length") >= prefix)).select("a", "b").unionByName(across)


def _sets_of(base: DataFrame, signed: DataFrame, stars: DataFrame, scratch: Scratch, trees: int, depth: int, least: int) -> DataFrame:
    """ck, sets, keys of each class that has an edge. One of its rows is read again: that of its least doc_id, whose text alone is shuffled, but for a few that the filter lets through."""
    apart = stars.where(F.col("a") != F.col("b"))
    nodes = apart.select(F.col("a").alias("ck")).unionByName(apart.select(F.col("b").alias("ck"))).distinct()
    none = F.lit(-(2**63)).cast("long")
    readers = signed.groupBy("ck").agg(F.coalesce(F.min("doc_id"), none).alias("id")).join(nodes, "ck")
    readers = scratch.write(readers, "readers")
    rows = base.select(F.coalesce("doc_id", none).alias("id"), "ck", "text")
    chosen = may_match(rows, readers, ("id", "ck"), scratch).where("__may").groupBy("id", "ck").agg(F.first("text").alias("text"))
    texts = chosen.join(readers, ["id", "ck"]).select("ck", "text")
    return scratch.write(texts.mapInArrow(_shingle_sets(trees, depth, least), "ck binary, sets binary, keys binary"), "sets")


def _verified_links(sets: DataFrame, runs: DataFrame, scratch: Scratch, prefix: int, done: int | None, trees: int, least: int, threshold: float, block: int) -> DataFrame:
    """a, b, links, percent: sums of links (b null), spanning forests (a, b), and links by percent of similarity (percent not null) of the pairs that share a prefix of this length and none of the length done before."""
    # A class stands in at most one run of each tree, so it has few stars.
    near = connected_components(contract(_stars_of(runs, prefix)), scratch).select(F.col("node").alias("ck"), F.col("label").alias("comp"))
    weights = near.join(sets.select("ck", F.octet_length("sets").alias("bytes")).hint("merge"), "ck")
    sizes = weights.groupBy("comp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    keys = F.concat(*[F.substring("keys", (p - least) * 4 * trees + 1, 4 * trees) for p in (prefix, done) if p])
    # Merged whatever the sizes: a table that is small here grows with the corpus.
    members = near.join(sizes, "comp").join(sets.select("ck", "sets", keys.alias("keys")).hint("merge"), "ck")
    own = F.pmod(F.xxhash64("ck"), F.col("blocks")).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("comp", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), F.col("own").alias("side"), "ck", "sets", "keys")
    return scratch.write(spread.repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "ck").mapInArrow(_verify(trees, threshold), "a binary, b binary, links long, percent int"), "found")


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each group of jaccard_links: that of the smallest doc_id, and of its texts the least text key.

    A doc_id may stand on rows with different texts: each is a row of its own
    group. A row without a doc_id stays only if no row of its group has one. Of
    rows that repeat a doc_id and its text, one stays.
    """
    own = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    marked = docs.withColumns({"__ck": F.unhex(F.md5(text.cast("binary"))), "__id": F.coalesce(doc_id, F.lit(0).cast("long")), "__null": doc_id.isNull()})
    _, classed = _classes(docs, threshold)
    first = classed.groupBy("grp").agg(F.min(F.struct(F.col("least").isNull().alias("null"), "least", "ck")).alias("f"))
    keep = first.select(F.col("f.ck").alias("__ck"), F.coalesce("f.least", F.lit(0).cast("long")).alias("__id"), F.col("f.null").alias("__null"))
    keys = ["__ck", "__id", "__null"]
    return marked.join(keep, keys).dropDuplicates(keys).select(*own)
