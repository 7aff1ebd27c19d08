"""Packing by power-of-two decomposition.

Each document's token ids, with an end id after them, are cut into pieces whose
lengths are the powers of two of the binary form of its length (as many whole
contexts as fit come first). Equal lengths share a bucket, so a training batch
stacks sequences of one length, none needs padding and none holds ids of two
documents.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import slices

#: Fixed value: the split rule of the byte-level BPE vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a worker keeps at hand; when full it starts anew.
CACHE_WORDS = 400_000


def byte_alphabet() -> dict[str, int]:
    """The vocabulary file's letters for the 256 bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(tokenizer_path: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian unsigned 32-bit numbers.

    The ids are those of the byte-level BPE file with special strings taken as
    ordinary text. A text with single spaces only is cut before each space,
    which is always a border of the split rule, so that the ids of a word that
    came before are looked up.
    """
    import tiktoken

    vocabulary = json.loads(Path(tokenizer_path).read_text())["model"]["vocab"]
    letters = byte_alphabet()
    ranks = {bytes(letters[c] for c in word): i for word, i in vocabulary.items() if all(c in letters for c in word)}
    ranks = {word: i for word, i in ranks.items() if word != b"<|endoftext|>"}
    encode = tiktoken.Encoding("bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(text: str) -> bytes:
        return np.array(encode(text), "<u4").tobytes()

    class Cache(dict):
        def __missing__(self, word: str) -> bytes:
            found = ids(" " + word)
            if len(word) < 64:
                self[word] = found
            return found

    cache = Cache()

    def run(text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or text[0] == " " or text[-1] == " ":
            return ids(text)
        if len(cache) > CACHE_WORDS:
            cache.clear()
        first, *rest = text.split(" ")
        return ids(first) + b"".join(map(cache.__getitem__, rest))

    return run


def binary_lengths(n: int, context: int) -> list[int]:
    """Whole contexts first, then the powers of two of the rest, falling."""
    return [context] * (n // context) + [1 << k for k in range(context.bit_length() - 1, -1, -1) if (n % context) >> k & 1]


PIECES = "doc_id long, start long, length long, bucket int, doc_tokens long, ids array<int>, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, context: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece of documents(doc_id, text): doc_id, start, length, bucket (log2 of length), doc_tokens, ids, ids_crc32.

    Null and empty texts are one piece that holds the end id. A null doc_id and
    repeated rows are packed like any other. No shuffle; without with_ids the
    ids column is null.
    """
    if context & (context - 1) or context < 1:
        raise ValueError("context must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bucket", pa.int32()), ("doc_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_crc32", pa.int64())])
        for batch in batches:
            for part in slices(batch, "text"):
                doc, start, length, total, crc, body = [], [], [], [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = encode(text or "") + end
                    n, at = len(data) // 4, 0
                    for k in binary_lengths(n, context):
                        doc.append(i)
                        start.append(at)
                        length.append(k)
                        total.append(n)
                        crc.append(zlib.crc32(data[4 * at : 4 * (at + k)]))
                        at += k
                    if with_ids:
                        body.append(data)
                ends = np.cumsum([0, *length]).astype(np.int32)
                if with_ids:
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(body), "<u4").astype(np.int32)))
                else:
                    ids = pa.nulls(len(doc), pa.list_(pa.int32()))
                size = np.array(length, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(size), pa.array(np.log2(size).round().astype(np.int32)), pa.array(total, pa.int64()), ids, pa.array(crc, pa.int64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, context: int = 1024, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """pieces() with sequence_id and offset: each piece is a sequence of its own, at offset 0, without padding.

    Ids are unique, not dense: they hold the task and the row in it. Writers
    that want a folder for each length partition the output by bucket.
    """
    return pieces(docs, tokenizer_path, context, end_id, with_ids).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
