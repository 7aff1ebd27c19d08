"""The conversation trie, tree-reduced BPE and periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shutterlake.llm import bpe, conversation_trie, oracles, periodic_runs, queries

SF = "/root/testdata/sf0.01"

# --- op11 ---------------------------------------------------------------------


def trie(rows):
    """The contract by dictionaries of whole prefixes."""

    def digest(role, text):
        return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5 if c >= 0 else c + -c % 5, [])[:h] + v[h:]
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
            leaves[k[:d]] += not children[k]
    ended = {k: ",".join(str(c) for c in m if len(rebuilt[c]) == len(k)) for k, m in members.items()}
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -(10**9), len(m), children[k], leaves[k], saved[k], hashlib.sha256(ended[k].encode()).hexdigest()) for k, m in members.items())


def nodes(df):
    return sorted((r.conv_id, r.depth, -(10**9) if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


TURN = "conv_id long, turn long, role string, text string"


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(queries.op11_conversation_trie(spark, SF)) == trie(rows)


def test_trie_of_odd_rows_over_small_blocks(spark, monkeypatch):
    """Nulls, ties, repeated rows, negative ids, families without a base, turnless and long conversations; columns named like the operator's own."""
    monkeypatch.setattr(conversation_trie, "DEPTH_BLOCK", 4)
    monkeypatch.setattr(conversation_trie, "ID_BLOCK", 3)
    rng = random.Random(3)
    rows = [(None, 1, "u", "x")] * 3 + [(c, i, "u", "x") for c in (200, 205, 206) for i in range(100)] + [(300 + 5 * i, j, "u", "x") for i in range(9) for j in range(3)]
    for c in range(-7, 60):
        if rng.random() > 0.15:
            rows += [(c, rng.choice([None, i, i, 0]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", None, "é"])) for i in range(rng.choice([0, 1, 3, 9, 14, 30]))]
    df = spark.createDataFrame(rows, TURN)
    clashing = df.selectExpr("*", "turn AS key", "role AS block", "turn AS n", "turn AS depth")
    assert nodes(conversation_trie.prefix_trie(clashing)) == trie(rows)
    assert nodes(conversation_trie.prefix_trie(df.limit(0))) == []


def test_trie_sql_on_odd_rows(spark):
    rows = [(c, t, r, x) for c in range(12) for t in (None, 0, 1, 1, 2, 7) for r, x in ((None, None), ("u", "é" * (c % 3)))][: 12 * 11]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = con.sql(f"SELECT {', '.join(names)} FROM ({oracles.OP11})").fetchall()
    assert sorted(tuple(-(10**9) if x is None else x for x in r) for r in found) == trie(rows)


# --- op12 ---------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


PIECES = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "é", "日", "1", "23", "the", "ing", "!", "\t", " the", "'ve", "aaaa", "----", "😀", "\r\n", "　", "\x1c", "<|endoftext|>"]


def test_tree_reduction_equals_the_library(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 16)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 4)
    rng = random.Random(2)
    for k in range(6000):
        s = "".join(rng.choice(PIECES if k % 4 else PIECES[: 1 + k % 9]) for _ in range(rng.randint(0, 120)))
        ids = np.frombuffer(coder.encode(s), "<u4").tolist()
        assert ids == library.encode_ordinary(s), s
        assert coder.decode(ids) == s.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, " " * 30_000, "\n" * 9_999 + "x", "é" * 20_000, "=-" * 9_000, "thethe" * 5_000, "日本" * 8_000, "a b" * 9_000])
def test_long_words_take_linear_windows(coder, library, text):
    assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_joins_at_every_place(coder, library):
    """The join of any two parts of a word is the word's encoding."""
    for word in ("supercalifragilisticexpialidocious", "éèàüßaaaaaaaab", "the" * 8, "____----====____"):
        data = word.encode()
        for at in range(len(data) + 1):
            assert coder.join_ids(coder.encode_word(data[:at]) if at else [], coder.encode_word(data[at:]) if at < len(data) else []) == coder.encode_word(data) == library._encode_single_piece(data)


def test_bpe_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op12_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_encode_and_decode_odd_rows(spark, odd):
    encoded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in back) == sorted((r.doc_id or -1, (r.text or "").encode()) for r in odd.collect())
    assert bpe.round_trip(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# --- op13 ---------------------------------------------------------------------


def all_runs(w):
    """Every run by comparing words q apart, for every q."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


def random_words(rng, k):
    size, letters = rng.randint(0, 60 if k % 5 < 4 else 200), rng.choice([1, 2, 2, 3, 4])
    w = []
    while len(w) < size:
        kind = rng.random()
        if kind < 0.5:
            w += ([rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.randint(1, 8))[: rng.randint(1, 40)]
        elif kind < 0.8 and w:
            i = rng.randrange(len(w))
            w += w[i : i + rng.randint(1, 30)]
        else:
            w.append(rng.randrange(letters))
    return w


def test_runs_of_random_words():
    rng = random.Random(1)
    for k in range(6000):
        w = random_words(rng, k)
        assert periodic_runs.find_runs(w) == all_runs(w), w


def test_factors_are_the_longest_earlier_stretches():
    rng = random.Random(4)
    for k in range(500):
        w = random_words(rng, k)
        at = 0
        for size, distance in periodic_runs.lz_factors(w):
            longest = max((m for s in range(at) for m in [next((m for m in range(len(w) - at) if w[s + m] != w[at + m]), len(w) - at)]), default=0)
            assert size == max(longest, 1) and (distance > 0) == (longest > 0)
            assert not distance or w[at : at + size] == w[at - distance : at - distance + size]
            at += size
        assert at == len(w)


def expected(doc_id, text, plant):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for a, b, q in runs for i in range(a + q, b)}
    best = min(((-(b - a) / q, a, q, b - a) for a, b, q in runs), default=None)
    top = (best[1], best[3], best[2], 1000 * best[3] // best[2]) if best else (None,) * 4
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs)
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def as_tuple(r):
    return (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def test_runs_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts) and sum(r.n_runs > 0 for r in rows) >= 5
    for r in rows:
        assert as_tuple(r) == expected(r.doc_id, texts[r.doc_id], True), r.doc_id


def test_runs_of_odd_rows(spark, odd):
    many = odd.unionByName(odd.sparkSession.createDataFrame([(20, "a b " * 5000 + " x\x0b" + "y\r\n" * 7), (None, "z " * 20), (21, "q" * 100_000)], "doc_id long, text string"), allowMissingColumns=True)
    found = periodic_runs.digest(periodic_runs.periodic_runs(many, plant=True)).collect()
    want = [expected(r.doc_id, r.text, True) if len(r.text or "") < 150_000 else None for r in many.collect()]
    assert len(found) == len(want)
    assert all(w is None or as_tuple(f) == w for f, w in zip(found, want, strict=True))
    assert periodic_runs.periodic_runs(odd.limit(0)).count() == 0
