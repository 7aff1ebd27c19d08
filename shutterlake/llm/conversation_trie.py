"""The prefix trie of conversations, merged family by family.

A family is the conversations whose ids share c - c % 5. Each conversation is
rebuilt from the first turns of its family's base and its own later turns.

1. Turns become digests of fixed size (texts are read once and not shuffled) and
   get their place by a range partition; a conversation of any length spreads
   over ranges, and sums of earlier ranges carry the count on.
2. Families meet by (base, block of depths). A prefix of turns is named by
   running sums of 128-bit hashes of (depth, turn), which blocks of depths add
   up independently; equal prefixes of a family become one family node, with
   its members as bits.
3. Only family nodes are shuffled by prefix, and merge into the trie.
4. Subtree sums need no walk: each node belongs to its smallest member, whose
   nodes form a chain down to where it ends. A node's leaves and savings are
   sums over the members that pass it: their chains' totals, less what its own
   chain holds above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import Scratch

#: Conversations of a family have ids of one multiple of FAMILY; they share at most MOST_SHARED turns.
FAMILY, MOST_SHARED = 5, 8
#: Depths, and conversation ids, that one task or row takes together.
DEPTH_BLOCK, ID_BLOCK = 4096, 512
LANES = ("k1", "k2", "k3", "k4")


def running_sums(rows: DataFrame, key: str, block: str, order: tuple[str, ...], values: tuple[str, ...], family: str | None = None) -> DataFrame:
    """rows with __<value>: the sum of this and all earlier rows of the key.

    Blocks rise with the order. Each is summed by itself, from the total of the
    blocks before it, so a key with very many rows is no single task. With
    family, rows are dealt by (family, block), and stay so. Read rows twice: pass
    a written table.
    """
    by = [family, key] if family else [key]
    totals = rows.groupBy(*by, block).agg(*[F.sum(v).alias(v) for v in values])
    earlier = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    seeds = totals.select(*by, block, *[F.sum(v).over(earlier).alias(v) for v in values]).where(F.col(values[0]).isNotNull())
    both = rows.withColumn("__row", F.lit(True)).unionByName(seeds.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    if family:
        both = both.repartition(family, block)
    so_far = Window.partitionBy(*by, block).orderBy("__row", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumns({f"__{v}": F.sum(v).over(so_far) for v in values}).where("__row").drop("__row")


def shared_turns(conv_id: Column) -> Column:
    """How many turns of its base a conversation starts with."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, base, place (from 1), turn digest and UTF-8 bytes of the text of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).where(F.col("conv_id").isNotNull())
    # Rows that agree in all of these are the same turn twice, in any order.
    ranged = rows.repartitionByRange("conv_id", "turn", "digest").withColumns({"range": F.spark_partition_id(), "n": F.lit(1).cast("long")})
    placed = running_sums(scratch.write(ranged, "turns"), "conv_id", "range", ("turn", "digest"), ("n",))
    return placed.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), F.col("__n").alias("place"), "digest", "bytes")


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """base, conv_id, depth, digest, bytes of each turn of each rebuilt conversation, and a row of depth 0 for each conversation."""
    block = ((F.col("place") - 1) / DEPTH_BLOCK).cast("long")
    turn = F.struct("place", "digest", "bytes")
    heads = turns.where((F.col("conv_id") == F.col("base")) & (F.col("place") <= MOST_SHARED)).groupBy("base").agg(F.array_sort(F.collect_list(turn)).alias("head"))
    starts = turns.where((F.col("place") - 1) % DEPTH_BLOCK == 0).select("base", "conv_id", block.alias("block"), shared_turns(F.col("conv_id")).alias("h"))
    starts = starts.join(heads, "base", "left")
    shared = F.slice(F.coalesce("head", F.array().cast("array<struct<place: bigint, digest: binary, bytes: bigint>>")), F.lit(1), F.col("h"))
    root = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes")))
    first = starts.where("block = 0").select("base", "conv_id", F.explode(F.concat(root, shared)).alias("t"))
    first = first.select("base", "conv_id", F.col("t.place").alias("depth"), "t.digest", "t.bytes")
    # h turns of its own give way to those of the base, of which there may be fewer.
    shift = starts.select("conv_id", "block", "h", (F.size(shared) - F.col("h")).alias("shift"))
    later = turns.withColumn("block", block).join(shift, ["conv_id", "block"]).where("place > h")
    return first.unionByName(later.select("base", "conv_id", (F.col("place") + F.col("shift")).alias("depth"), "digest", "bytes"))


def _named(sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *[s.cast("string") for s in sums]).cast("binary")))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> one row per distinct prefix of the rebuilt conversations.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. Turns are ordered by turn,
    null first, and equal ones by a digest of role and text; a null role or text
    is empty, repeated rows are turns of their own. Rows without a conv_id
    belong to no conversation. An empty table has no trie, so no rows.
    """
    scratch = Scratch(conversations.sparkSession)
    turns = scratch.write(ordered_turns(conversations, scratch), "places")
    hashed = F.md5(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("digest")))
    # 32 bits each, so that sums over two billion turns fit.
    lanes = {k: F.when(F.col("depth") > 0, F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long")).otherwise(F.lit(0).cast("long")) for i, k in enumerate(LANES)}
    rows = rebuilt_turns(turns).withColumns(lanes).withColumn("block", (F.col("depth") / DEPTH_BLOCK).cast("long")).drop("digest")
    rows = scratch.write(rows, "rebuilt")

    summed = running_sums(rows, "conv_id", "block", ("depth",), LANES, family="base")
    key = _named([F.col(f"__{k}") for k in LANES])
    parent = F.when(F.col("depth") > 0, _named([F.col(f"__{k}") - F.col(k) for k in LANES]))
    bit = F.call_function("shiftleft", F.lit(1), (F.col("conv_id") - F.col("base") + FAMILY - 1).cast("int"))
    family = summed.withColumns({"key": key, "parent": parent}).groupBy("base", "block", "depth", "key", "parent", "bytes").agg(F.bit_or(bit).alias("members"), F.min("conv_id").alias("least"))
    family = scratch.write(family, "family")

    nodes = family.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"), F.first("block").alias("block"), F.min("least").alias("conv_id"), F.sum(F.bit_count("members").cast("long")).alias("n_convs")
    )
    nodes = scratch.write(nodes.withColumn("value", (F.col("n_convs") - 1) * F.col("bytes")), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = scratch.write(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")

    # What each member's chain holds, at hand for its family: at most nine ids.
    chains = nodes.groupBy("conv_id").agg(F.sum("value").alias("value"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    place = (F.col("conv_id") % FAMILY + FAMILY - 1).cast("int")
    chains = chains.groupBy((F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")).agg(F.collect_list(F.struct(place.alias("bit"), "value", "leaf")).alias("chains"))
    passing = F.filter("chains", lambda c: F.expr("members").bitwiseAND(F.call_function("shiftleft", F.lit(1), c["bit"])) != 0)
    weighed = family.join(chains, "base").withColumn("passing", passing)
    sums = weighed.select("key", *[F.expr(f"aggregate(passing, 0L, (total, c) -> total + c.{v})").alias(v) for v in ("value", "leaf")])
    sums = sums.groupBy("key").agg(F.sum("value").alias("below"), F.sum("leaf").alias("n_leaves"))

    above = running_sums(nodes, "conv_id", "block", ("depth",), ("value",)).withColumn("above", F.col("__value") - F.col("value"))
    owners = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = above.join(owners, "parent", "left").join(sums, "key").join(ends(rows), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("below") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def ends(rows: DataFrame) -> DataFrame:
    """key, ends_sha256 of the nodes at which conversations end. A node at which very many end reads blocks of ids one after the other."""
    last = rows.groupBy("conv_id").agg(*[F.sum(k).alias(k) for k in LANES]).select(_named([F.col(k) for k in LANES]).alias("key"), "conv_id")
    blocks = last.groupBy("key", F.floor(F.col("conv_id") / ID_BLOCK).alias("block")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for batch in batches:
            keys, digests = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k == key:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    keys.append(key)
                    digests.append(sha.hexdigest())
                key, sha = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

    return blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")
