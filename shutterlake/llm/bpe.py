"""Byte-level BPE encoding and decoding as a tree reduction.

An encoded stretch of text is an element of a monoid: two neighbours join into
the encoding of both. A text is halved until its parts are small, the parts are
encoded, and neighbours join up the tree:

- The split rule cuts text from left to right and never looks back, so the cuts
  of the left part stand but for those near its end, and once a cut of the
  joined text meets one of the right part, all later ones are the same. The
  window that is cut anew grows to the right until they meet.
- Within one word of the rule, ids are what merging the pair of least rank
  gives. A sequence of tokens is that result exactly if each pair of neighbours
  is: if the bytes of the two, encoded alone, give the two (tokens merge across
  a border only if the two at the border do so first). The window that is
  encoded anew grows on both sides until its ends form such pairs with the
  tokens outside, which are then proven final.

Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import slices

#: Longest text, in characters, and longest word, in bytes, encoded in one go.
LEAF_CHARS, LEAF_BYTES = 8192, 48
#: Encoded words that a worker keeps at hand; when full it starts anew.
CACHE_WORDS = 500_000
#: Up to this many bytes a list of pairs is looked through for the least rank, beyond it a heap keeps them in order.
LISTED_BYTES = 32
NO_RANK = 1 << 30
#: Cuts that end this far before the end of a text do not depend on what follows: the longest fixed alternative of the rule has three characters.
CERTAIN = 3


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a file of base64 tokens and ranks."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())}


class _Words(dict):
    """Encoded words of the split rule, by their text."""

    def __init__(self, encode_word: Callable[[bytes], list[int]]) -> None:
        self.encode_word = encode_word

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.encode_word(word.encode()), "<u4").tobytes()
        if len(word) < 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {i: token for token, i in ranks.items()}
        self.cut = regex.compile(pattern).findall
        self.words = _Words(self.encode_word)
        self.single = [bytes([b]) for b in range(256)]
        self.final = lru_cache(1 << 16)(self._final)

    # --- one word ---------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """Ids of a few bytes: the pair of least rank, the leftmost of equal ones, becomes one token until no pair has a rank."""
        ranks, n = self.ranks, len(data)
        if n <= LISTED_BYTES:
            rank_of, parts = ranks.get, [self.single[b] for b in data]
            pairs = [rank_of(x + y, NO_RANK) for x, y in pairwise(parts)]
            while pairs and (least := min(pairs)) < NO_RANK:
                i = pairs.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i < len(pairs):
                    pairs[i] = rank_of(parts[i] + parts[i + 1], NO_RANK)
                if i:
                    pairs[i - 1] = rank_of(parts[i - 1] + parts[i], NO_RANK)
            return [ranks[p] for p in parts]
        end = list(range(1, n + 1))  # where the token that starts here ends
        start = list(range(-1, n))  # where the token that ends here starts
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b = heapq.heappop(heap)
            if not alive[a] or end[a] == n or end[end[a]] != b:
                continue
            alive[end[a]] = False
            end[a], start[b] = b, a
            if b < n and (r := ranks.get(data[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
            if a and (r := ranks.get(data[start[a] : b])) is not None:
                heapq.heappush(heap, (r, start[a], b))
        return [ranks[data[i : end[i]]] for i in range(n) if alive[i]]

    def _final(self, a: int, b: int) -> bool:
        """Whether two tokens stay as they are when they meet."""
        return self.encode_word(self.tokens[a] + self.tokens[b], True) == [a, b]

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of one word from those of its two parts."""
        if not left or not right or self.final(left[-1], right[0]):
            return left + right
        before = after = 1
        while True:
            a, b = max(len(left) - before, 0), min(after, len(right))
            window = self.merge(self.decode(left[a:] + right[:b]))
            open_left = a > 0 and not self.final(left[a - 1], window[0])
            open_right = b < len(right) and not self.final(window[-1], right[b])
            if not open_left and not open_right:
                return left[:a] + window + right[b:]
            before, after = before << open_left, after << open_right

    def encode_word(self, data: bytes, apart: bool = False) -> list[int]:
        """Ids of one word of the split rule. With apart, halves are not used: for the test of two tokens."""
        if data in self.ranks:
            return [self.ranks[data]]
        if apart or len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join_ids(self.encode_word(data[:half]), self.encode_word(data[half:]))

    # --- one text ---------------------------------------------------------------

    def _cut(self, text: str) -> list[str]:
        """The words of the split rule in a text, from its halves."""
        if len(text) <= LEAF_CHARS:
            return self.cut(text)
        half = len(text) // 2
        return self.join_words(self._cut(text[:half]), self._cut(text[half:]))

    def join_words(self, left: list[str], right: list[str]) -> list[str]:
        """The words of a text from those of its two parts."""
        if not left or not right:
            return left + right
        kept, tail = len(left), 0
        while kept and tail <= CERTAIN:  # words that end in the last characters are cut anew, and one before them
            kept -= 1
            tail += len(left[kept])
        head, after = "".join(left[kept:]), 1
        while True:
            after = min(2 * after, len(right))
            window = self.cut(head + "".join(right[:after]))
            if after == len(right):
                return left[:kept] + window
            met = self._meeting(window, right[:after], len(head))
            if met is not None:
                return left[:kept] + window[: met[0]] + right[met[1] :]

    @staticmethod
    def _meeting(window: list[str], right: list[str], head: int) -> tuple[int, int] | None:
        """How many words of the window, and of the right part, end at the first certain cut that both have."""
        ends = np.cumsum([len(w) for w in window])
        others = head + np.cumsum([0, *[len(w) for w in right]])
        common = np.intersect1d(ends, others)
        common = common[(common >= head) & (common <= ends[-1] - CERTAIN)]
        if not len(common):
            return None
        return int(np.searchsorted(ends, common[0])) + 1, int(np.searchsorted(others, common[0]))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.words.__getitem__, self._cut(text)))

    # --- back -------------------------------------------------------------------

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids: those of both halves, end to end."""
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def _coder(path: str, pattern: str) -> Bpe:
    return Bpe(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """documents(doc_id, text) -> doc_id, ids (binary: little-endian unsigned 32-bit ids). Null and empty texts have none. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [coder.encode(text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.large_binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) as encode gives them -> doc_id, bytes. Null ids give no bytes; an id that no token has is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            data = [coder.decode(np.frombuffer(ids or b"", "<u4").tolist()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.large_binary())], names=["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row per row of documents(doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256 (of the bytes that the ids decode to). Null counts as empty; repeated rows stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                size, ids_sha, text_sha = [], [], []
                for text in part.column(1).to_pylist():
                    ids = coder.encode(text or "")
                    size.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(coder.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
