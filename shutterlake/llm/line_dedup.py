"""Line deduplication over the corpus, with DataFrame functions only.

Hashes of line keys, never the lines, are range-partitioned with a secondary
sort by document and position. One pass over each sorted range tells the first
occurrence of a key from the later ones and counts its documents; the result is,
for each document, a bitmap of dropped lines that stores only the 64-line words
with a bit set.

A key with very many lines would fill one range. Such hot keys are found in a
sample of the hashes (being hot changes no result), counted beforehand with
map-side sums, and sorted under a further key, so that their lines spread over
ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import Scratch, may_match

#: A key is hot if it holds this share of the sampled lines, or HOT_LINES lines: at most 1,000 keys, or one for HOT_LINES
#: lines of the corpus. One line in SAMPLE is sampled.
HOT_SHARE, HOT_LINES, HOT_LEAST, SAMPLE = 1 / 1000, 1_000_000, 64, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.translate(bare, _UPPER, _LOWER)


def _docs(docs: DataFrame) -> DataFrame:
    """doc (long; a null doc_id counts as the smallest), its text's hash, and the text, null as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc, text_hash, pos and the 128-bit hash h1, h2 of each line whose key has min_chars code points or more."""
    lines = _docs(docs).select("doc", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    # the key is no longer than the line, so most lines end here
    keys = lines.where(F.char_length("line") >= min_chars).select("doc", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def hot_keys(hashes: DataFrame) -> DataFrame:
    """h1, h2 of hot keys, few enough to broadcast: no more than 1,000, or than one for HOT_LINES lines."""
    sample = hashes.where(F.pmod(F.xxhash64("doc", "text_hash", "pos"), F.lit(SAMPLE)) == 0)
    least = max(HOT_LEAST, min(HOT_SHARE * sample.count(), HOT_LINES / SAMPLE))
    return sample.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("h1", "h2")


def counted(hashes: DataFrame, keys: DataFrame) -> DataFrame:
    """h1, h2, n_docs, keeper of the given few keys: their documents and the largest. Pairs of key and document are made distinct first, so no key meets in one task."""
    pairs = hashes.join(F.broadcast(keys), ["h1", "h2"]).select("h1", "h2", "doc").distinct()
    return pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("keeper"))


def dropped_lines(hashes: DataFrame, hot: DataFrame, min_docs: int) -> DataFrame:
    """doc, text_hash, pos of the lines whose key is in min_docs documents or more, but for those of the key's first document.

    Ranges are sorted by key, falling document and rising position. The sort
    key of a cold key holds all its lines, so the pass sees its documents; hot
    keys (h1, h2, n_docs, keeper) bring them along, and each of their documents
    has a sort key of its own.
    """
    rows = hashes.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("part", F.when(F.col("keeper").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("doc")))
    key = ["h1", "h2", "part"]
    stream = Window.partitionBy(*key).orderBy(F.desc("doc"), "pos")
    before = F.lag("doc").over(stream)
    passed = rows.repartitionByRange(*key).select(*rows.columns, F.first("doc").over(stream).alias("head"), F.when(before == F.col("doc"), 0).otherwise(1).alias("opens"))
    known = passed.withColumn("docs", F.coalesce("n_docs", F.sum("opens").over(Window.partitionBy(*key))))
    return known.where((F.col("docs") >= min_docs) & (F.col("doc") != F.coalesce("keeper", "head"))).select("doc", "text_hash", "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """doc, text_hash, n_dropped and words: the sorted (word, bits) of a document's dropped lines, 64 lines a word.

    Only documents that lose a line have a row. The first occurrence of a key,
    in the order of falling document and rising position, stays, and with it
    all lines of that key in that document. Rows that repeat a doc_id count as
    one document; where their texts differ, each text has its own bitmap. The
    texts are split once; their hashes are written to the shared folder.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    hashes = scratch.write(line_hashes(docs, min_chars), "lines")
    hot = scratch.write(counted(hashes, hot_keys(hashes)), "hot")
    word = dropped_lines(hashes, hot, min_docs).groupBy("doc", "text_hash", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return word.groupBy("doc", "text_hash").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _dense(words: Column) -> Column:
    """The bits of sorted (word, bits) as an array with one entry for every word up to the last."""
    zero = F.lit(0).cast("long")
    return F.flatten(F.transform(words, lambda w, i: F.concat(F.array_repeat(zero, w["word"] - F.coalesce(F.get(words, i - 1)["word"], F.lit(-1)) - 1), F.array(w["bits"]))))


def without_lines(text: Column, words: Column) -> Column:
    """The text without the lines whose bit is set; the number of steps grows with the lines alone."""
    lines = F.split(text, "\n")
    bit = lambda dense, i: F.getbit(F.coalesce(F.get(dense, F.shiftright(i, 6)), F.lit(0).cast("long")), i % 64)
    return _let(_dense(words), lambda dense: F.array_join(F.filter(lines, lambda _, i: bit(dense, i) == 0), "\n"))


def deduplicate_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """All columns of docs, text without the dropped lines (null and empty: empty), with __n_lines and __n_dropped (long).

    Texts are shuffled only where a filter of fixed size says that the document
    may lose a line; the others pass through.
    """
    own = docs.columns
    scratch = Scratch(docs.sparkSession)
    bitmaps = scratch.write(drop_bitmaps(docs, min_chars, min_docs, scratch), "bitmaps")
    scratch.keep(bitmaps)
    # The row travels as one struct, so that no column of docs clashes with those of the join.
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    left = docs.select(F.struct(*[F.col(c) for c in own]).alias("row"))
    left = left.select("row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("doc"), F.xxhash64(text).alias("text_hash"))
    left = may_match(left, bitmaps, ("doc", "text_hash"), scratch)

    def result(rows: DataFrame, kept: Column, dropped: Column) -> DataFrame:
        n_lines = F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1
        return rows.select(*[kept.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in own], n_lines.cast("long").alias("__n_lines"), dropped.cast("long").alias("__n_dropped"))

    lose = left.where("__may").select("row", "doc", "text_hash").join(bitmaps, ["doc", "text_hash"], "left")
    shortened = result(lose, F.when(F.col("n_dropped").isNull(), text).otherwise(without_lines(text, F.col("words"))), F.coalesce("n_dropped", F.lit(0)))
    return result(left.where("not __may"), text, F.lit(0)).unionByName(shortened)
