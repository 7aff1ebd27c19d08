"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram's vector binds (by
product) its letters' vectors, the first shifted by two places and the second by
one; a text bundles (adds) the vectors of its trigrams. A language's prototype
bundles the unit vectors of its texts, and texts are compared with prototypes by
cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import slices

DIMENSIONS = 1024
SLOTS = 1024  # letters share a vector where their slots meet; slot 0 is the gap between words


@lru_cache(1)
def letter_slots() -> np.ndarray:
    """The slot of each code point: letters below 512 have one of their own, others one by hash; 0 for all that is no letter."""
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    code = np.arange(0x110000, dtype=np.uint64)
    hashed = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    slot = np.where(code < 512, 1 + code, 513 + hashed % np.uint64(SLOTS - 513))
    return np.where(letter, slot, 0).astype(np.uint32)


@lru_cache(2)
def letter_vectors(dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random vector of +1 and -1 for each slot, permuted twice, once and not at all: by its place in a trigram."""
    base = (np.random.default_rng(11).integers(0, 2, (SLOTS, dimensions), dtype=np.int8) * 2 - 1).astype(np.int8)
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all letter trigrams (words' ends count as a gap) and the texts' offsets in them."""
    joined = "\n".join(f" {t.lower()}" for t in texts) + "\n"
    slot = letter_slots()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.array([len(t.lower()) + 2 for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    keep = slot > 0
    keep[1:] |= slot[:-1] > 0
    keep[begin[:-1]] = True
    doc_at = np.concatenate([[0], np.cumsum(keep)])[begin]
    slot = slot[keep]
    if len(slot) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    code = slot[:-2] << np.uint32(20) | slot[1:-1] << np.uint32(10) | slot[2:]
    inside = np.ones(len(code), bool)
    for back in (1, 2):
        edge = doc_at[1:-1] - back
        inside[edge[(edge >= 0) & (edge < len(code))]] = False
    some = (code & np.uint32(0x3FF)) | (code >> np.uint32(10) & np.uint32(0x3FF)) | (code >> np.uint32(20)) > 0
    inside &= some
    ends = np.concatenate([[0], np.cumsum(inside)])
    return code[inside], ends[np.minimum(doc_at, len(code))]


def text_vectors(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """texts x dimensions (float32); a text without letters has zeros."""
    codes, offsets = trigrams(texts)
    out = np.zeros((len(texts), dimensions), np.float32)
    known = np.unique(codes)
    a, b, c = letter_vectors(dimensions)
    table = (a[known >> np.uint32(20)] * b[known >> np.uint32(10) & np.uint32(0x3FF)] * c[known & np.uint32(0x3FF)]).astype(np.float32)
    place = np.searchsorted(known, codes)
    for i in range(len(texts)):
        own = place[offsets[i] : offsets[i + 1]]
        if len(own):
            which, count = np.unique(own, return_counts=True)
            out[i] = count.astype(np.float32) @ table[which]
    return out


def _units(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Prototypes of the languages of documents(text, lang); rows without lang or letters teach nothing.

    Each task adds up its texts by language, and Spark adds up the tasks: the
    driver gets `dimensions` numbers for each language.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                units = _units(text_vectors(part.column(0).to_pylist(), dimensions))
                langs = np.array(part.column(1).to_pylist(), object)
                for lang in set(langs.tolist()):
                    sums[lang] = sums.get(lang, 0) + units[langs == lang].sum(axis=0, dtype=np.float64)
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)], names=["lang", "at", "value"])

    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    # Whole numbers, so that the order of the sum does not change the result.
    cells = taught.mapInArrow(bundle, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum(F.round(F.col("value") * 1e6).cast("long")).alias("value")).collect()
    found: dict[str, np.ndarray] = {}
    for r in cells:
        found.setdefault(r.lang, np.zeros(dimensions))[r["at"]] = r.value
    return {lang: v for lang, v in sorted(found.items()) if v.any()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with lang_pred and score, the cosine with the nearest prototype (negative: 0).

    Null texts, texts without letters, and all texts if nothing was learned:
    `und` with score 0. Equal cosines go to the first name.
    """
    names = sorted(prototypes)
    dimensions = len(prototypes[names[0]]) if names else DIMENSIONS
    matrix = _units(np.array([prototypes[n] for n in names]).reshape(len(names), dimensions)).astype(np.float32)
    narrow = docs.select(*carry, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    schema = narrow.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                units = _units(text_vectors(part.column(len(carry)).to_pylist(), dimensions))
                if names:
                    cosines = units @ matrix.T
                    best = cosines.argmax(axis=1)
                    score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(np.float64)
                else:
                    best, score = np.zeros(len(units), np.int64), np.zeros(len(units))
                empty = ~units.any(axis=1) if names else np.ones(len(units), bool)
                pred = ["und" if e else names[b] for e, b in zip(empty, best, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array(pred, pa.string()), pa.array(np.where(empty, 0.0, score))], names=[*carry, "lang_pred", "score"])

    return narrow.mapInArrow(run, schema)


def remainder(column: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id gives null."""
    return F.crc32(column.cast("string").cast("binary")) % parts
