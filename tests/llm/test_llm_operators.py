"""Each operator against brute force, and on odd rows and empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shutterlake.llm import components, decontaminate, html_extract, language_id, line_dedup, ngram_join, packing, personal_data, quality_classifier, quality_rules, queries, url_filter
from shutterlake.llm.common import Scratch

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- packing ------------------------------------------------------------------


def packed_is_exact(rows, texts):
    encode = Tokenizer.from_file(BPE)
    encode.encode_special_tokens = True
    want = Counter()
    for i, t in texts:
        ids = np.array([*encode.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k in packing.binary_lengths(len(ids), 1024):
            want[i, at, k, zlib.crc32(ids[at : at + k].tobytes()), len(ids)] += 1
            at += k
        assert at == len(ids)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_packing_is_an_exact_round_trip(documents, odd):
    packed_is_exact(packing.pack(documents, BPE, with_ids=False).collect(), [(r.doc_id, r.text) for r in documents.collect()])
    packed_is_exact(packing.pack(odd, BPE).collect(), [(r.doc_id, r.text) for r in odd.collect()])


def test_packing_takes_special_strings_and_double_spaces_as_text(spark):
    rows = [(1, "a <|endoftext|> b"), (2, " a  b \n c  "), (3, "it's 10,000 naïve—words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    packed_is_exact(packing.pack(df, BPE).collect(), rows)
    assert packing.pack(df.limit(0), BPE).count() == 0


# --- URL filter ---------------------------------------------------------------


def test_url_rules_and_model(spark):
    good = [f"https://www.site{i % 7}.example.com/fr/{i}" for i in range(120)]
    bad = [f"http://casino-win{i % 3}.example.com/fr/{i}?x=1" for i in range(40)]
    special = ["HTTP://A.NET/de/1", "http://b.example.net/de/8x", "x://com/en/", "http://example.com/en/7/z", "http://xcom/en/", None, "", "no scheme", "a://", "http://h?q"]
    df = spark.createDataFrame(list(enumerate(good + bad + special)), "page_id long, url string").withColumn("score", F.lit("own"))
    rows = {r.page_id: r for r in url_filter.judge(df, queries.URL_RULES).collect()}
    assert len(rows) == 170
    assert all(rows[i].verdict == "allow" for i in range(120))
    assert all(rows[i].verdict == "block" for i in range(120, 160))
    got = [(rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) for i in range(160, 165)]
    assert got == [("a.net", "/de/1", "net/de/", "allow"), ("b.example.net", "/de/8x", "example.net/de/8", "block"), ("com", "/en/", "com/en/", "block"), ("example.com", "/en/7/z", "example.com/en/7", "allow"), ("xcom", "/en/", None, rows[164].verdict)]
    assert [(rows[i].host, rows[i].path) for i in range(165, 170)] == [("", "")] * 4 + [("h", "")]
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0


# --- HTML ---------------------------------------------------------------------


def page(body, nav="<nav><a>Home</a></nav>"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{nav}{body}<footer>(c)</footer></body></html>"


def test_html_keeps_the_article_only(spark):
    cases = [
        (page("<article><h1>T &amp; U</h1><p>One<br>two <b>three</b></p><p>Four&nbsp;&#8211;\n five</p></article>"), "T & U\n\nOne two three\n\nFour – five"),
        (page("<div class='ad'>Buy</div><main><p>Text<p>More<ul><li>a<li>b</ul></main><section class='comments'><article>me too</article></section>"), "Text\n\nMore\n\na\n\nb"),
        (page("<aside>side</aside><div id='cookie-notice'>ok?</div><form>mail</form><div><p>Body text here</p></div>"), "Body text here"),
        (page('<article><p>a</p><script>x="</p>";</script><!-- <p>no</p> --><p title="a>b">c < d</p>'), "a\n\nc < d"),
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        ("<p>cut <a href='x", "cut"),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.example.com/", h, 1) for i, (h, _) in enumerate(cases)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert [got[i].text for i in range(len(cases))] == [t for _, t in cases]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_removes_what_recurs_on_a_host(spark):
    rows = [(i, "http://s.example.com/", f"<body><div>Our offers today</div><div><p>Story {i} is long enough to be the text</p></div></body>") for i in range(10)]
    rows += [(10, None, "<body><div>Our offers today</div></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (html_extract.BROADCAST_HASHES, 0):
        got = {r.page_id: r.text for r in html_extract.extract(df, broadcast_hashes=most).collect()}
        assert all(got[i] == f"Story {i} is long enough to be the text" for i in range(10))
        assert got[10] == "Our offers today"


def test_html_counts_pages_whatever_the_size_of_the_host(spark):
    rng = np.random.default_rng(4)

    def prose(n):
        return " ".join(f"w{x}" for x in rng.integers(0, 10_000, n))

    bodies = [[prose(30), prose(30), prose(30)] for _ in range(100)]
    pages, want = [], []
    for i, (zero, one, two) in enumerate(bodies):
        end, inside = ("<div>Section offers today</div>", "<p>Read our <a>newsletter</a> every Monday</p>") if i < 12 else ("", "")
        pages += [f"<body><div><p>{zero}</p></div>{end}</body>", f"<article><p>{one} <span>Monday</span> {two}</p>{inside}<p>{two}</p></article>"]
        want += [zero, f"{one} Monday {two}\n\n{two}"]
    shared = [prose(40) for _ in range(5)]  # near copies: what they share is their text
    for i in range(12):
        parts = [f"{p} {prose(1)}" if (k + i) % 3 == 0 else p for k, p in enumerate(shared)]
        pages.append("<article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>")
        want.append("\n\n".join(parts))
    df = spark.createDataFrame([(i, "http://big.example.com/", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    for most in (html_extract.BROADCAST_HASHES, 0):
        got = {r.page_id: r.text for r in html_extract.extract(df, broadcast_hashes=most).collect()}
        assert [got[i] for i in range(len(want))] == want


# --- decontamination ----------------------------------------------------------


def test_leaks_with_and_without_edits(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    item = lambda n: list(rng.choice(vocabulary, n))
    items = [item(int(n)) for n in rng.integers(12, 60, 30)]
    docs, want = [], set()
    for d in range(120):
        words = item(200)
        if d < 90:
            k = d % 30
            part = list(items[k])
            for _ in range(decontaminate.edits_allowed(len(part)) if d >= 30 else 0):
                at = int(rng.integers(0, len(part)))
                kind = int(rng.integers(0, 3))
                if kind == 0:
                    part[at] = "edited"
                elif kind == 1:
                    del part[at]
                else:
                    part.insert(at, "new")
            words[50:50] = part
            want.add((d, k))
        docs.append((d, " ".join(words).capitalize()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = decontaminate.find_leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert {x for x in want if x[0] < 30} <= got
    assert len(want & got) >= 0.95 * len(want)
    assert got <= want
    assert all(r.edits == 0 and r.first_word == 50 for r in rows if r.doc_id < 30)
    kept = {r.doc_id for r in decontaminate.remove_leaks(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0


def test_leaks_on_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (None, None), (3, "")], "item_id long, text string")
    assert sorted(str(r.doc_id) for r in decontaminate.find_leaks(odd, bench).collect()) == ["5", "5", "None"]
    assert decontaminate.remove_leaks(odd, bench).count() == 5


# --- personal data ------------------------------------------------------------

BASE = {
    0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    2: re.compile(r"[0-9]([\x20-]?[0-9])+"),
    3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def base_by_rule(text):
    def fits(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {0: lambda: True, 1: lambda: all(int(p) < 256 for p in m.split(".")), 2: lambda: 12 <= len(digits) <= 19 and personal_data.luhn(digits), 3: lambda: 9 <= len(digits) <= 15}[kind]()

    return sorted((m.start(), k, m.end()) for k, p in BASE.items() for m in p.finditer(text) if fits(k, m[0]))


@pytest.mark.parametrize("text", ["a@b.c@d.e x@y @z.w q@@r.s", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.004", "4111 1111 1111 1111 4111-1111-1111-1112 12", "+1 (743) 555-3824. +12 +", "😀 é a.b+c@ex-ample.co.uk, +44 20 7946 0958)", "9" * 5000 + ".1.1.1"])
def test_base_spans(text):
    if len(text) < 4000:
        assert personal_data.base_spans(text) == base_by_rule(text)
    else:
        assert personal_data.base_spans(text) == []


def test_base_spans_of_documents(documents):
    got = Counter(tuple(tuple(s) for s in r.base) for r in personal_data.find_personal_data(documents).collect())
    assert got == Counter(tuple(base_by_rule(r.text or "")) for r in documents.collect())


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"Some words first. Please call me at +1 (743) 555-{1000 + i} after noon {i}") for i in range(20)]
    rows += [(100, "Été: please call me at 743-555-9999, after work"), (101, "nothing to see at all"), (102, "we met at 10 today"), (103, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k1", F.lit(1))
    got = {r.doc_id: r for r in personal_data.find_personal_data(df).collect()}
    text = rows[20][1]
    assert [text[s.start : s.end] for s in got[100].spans] == ["743-555-9999"]
    assert got[100].base == [] and got[100].spans[0].kind == 3
    assert got[101].spans == got[102].spans == got[103].spans == []
    assert all(got[i].spans == got[i].base and len(got[i].base) == 1 for i in range(20))
    assert personal_data.find_personal_data(df.limit(0)).count() == 0


def test_patterns_find_long_runs_names_and_chains(spark):
    rows = [(i, f"{i} please call me at +1 (743) 555-{1000 + i} after noon") for i in range(20)]
    iban = "FR76 3000 6000 0112 3456 7890 189"
    rows += [(100, f"please call me at {iban} after noon"), (101, "please call me at jane_doe after noon"), (102, "please call me at Rumpelstilz, after noon")]
    rows += [(500 + j, f"please call me at id-{j} after noon") for j in range(7)]
    for k, c in enumerate("abcdefgh"):  # each context shares seven of its ten instances with the one before
        rows += [(1000 + 10 * k + j, f"go to{c} x{c} id-{3 * k + j} now{c} here{c}") for j in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.spans] for r in personal_data.find_personal_data(df).collect()}
    assert [got[i] for i in (100, 101, 102)] == [[iban], ["jane_doe"], ["Rumpelstilz"]]
    assert all(got[1000 + 10 * k + j] == [f"id-{3 * k + j}"] for k in range(8) for j in range(10))


def test_long_runs_are_cut_at_base_spans():
    import pyarrow as pa

    s = personal_data.scan(pa.array(["call +1 (743) 555-2000 +44 20 7946 0958 a1 b2 now", "x " + "12 " * 9 + "y"]))
    assert [(int(a), int(b), int(k)) for a, b, k in zip(s.first, s.last, s.kind)] == [(1, 3, 3), (4, 7, 3), (8, 9, -1), (12, 20, -1)]


# --- quality rules and lines ----------------------------------------------------


def measured_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = {j for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat)


def test_quality_ledger(documents, odd):
    for df in (documents, odd):
        rows = quality_rules.ledger(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((r.doc_id, *measured_by_hand(r.text)) for r in df.collect())
    rows = quality_rules.ledger(documents).collect()
    mask = quality_rules.POLICIES["corpus-1"]
    kept = sum(not r.fail_bits & mask for r in rows)
    for r in quality_rules.ablations(quality_rules.ledger(documents), mask).collect():
        assert r.failed == sum(x.fail_bits >> r.bit & 1 for x in rows)
        assert r.kept_without == kept + r.failed_alone
    assert quality_rules.keep_rows(documents, mask).count() == kept
    assert quality_rules.ledger(documents.limit(0)).count() == 0


def lines_by_hand(rows):
    key = lambda x: re.sub("[A-Z]+", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    found = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                found[key(x)].add(-(2**63) if i is None else i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        own = -(2**63) if i is None else i
        kept = [x for x in lines if len(key(x)) < 40 or len(found[key(x)]) < 5 or max(found[key(x)]) == own]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def test_line_dedup(spark, documents, odd):
    common = "This very common Line has more than forty characters in it"
    rows = [(i, f"first {i}\n {common.upper() if i % 2 else common}\t\n\nlast\n{common}") for i in range(9)] + [(3, f"{common}\nother")]
    for df in (documents, odd, spark.createDataFrame(rows, "doc_id long, text string"), odd.limit(0)):
        got = line_dedup.deduplicate_lines(df).collect()
        assert Counter((r.doc_id, r["__n_lines"], r["__n_dropped"], r.text) for r in got) == lines_by_hand([(r.doc_id, r.text) for r in df.collect()])


# --- language and quality models ------------------------------------------------


def test_language_is_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    rest = language_id.remainder(F.col("doc_id"), 4)
    model = language_id.learn(docs.where(rest != 2))
    rows = language_id.identify(docs.where(rest == 2), model, ("doc_id", "lang")).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_on_odd_rows(odd, documents):
    model = language_id.learn(documents)
    got = [(r.doc_id, r.lang_pred == "und") for r in language_id.identify(odd, model).collect()]
    assert Counter(got) == Counter([(1, True), (2, True), (3, True), (None, False), (5, False), (5, False), (7, False), (8, False)])
    assert {r.lang_pred for r in language_id.identify(odd, language_id.learn(documents.limit(0))).collect()} == {"und"}


def test_quality_model_ranks_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    held = language_id.remainder(F.col("doc_id"), 5) == 0
    forest = quality_classifier.learn(docs, labels.where(~held))
    rows = quality_classifier.score(docs.join(labels, "doc_id").where(held), forest, ("doc_id", "label")).collect()
    good, bad = [r.score for r in rows if r.label == 1], [r.score for r in rows if r.label == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_model_on_odd_rows(odd, documents):
    labels = documents.select("doc_id", F.lit(1).alias("label"))
    forest = quality_classifier.learn(documents, labels.limit(0))
    rows = quality_classifier.score(odd, forest).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows)
    assert quality_classifier.score(odd.limit(0), quality_classifier.learn(documents, labels)).count() == 0


# --- near duplicates ------------------------------------------------------------


def classes_by_hand(rows, threshold=0.8):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, by_text = Counter(), {}
    for i, (_, t) in enumerate(rows):
        root[find(i)] = find(by_text.setdefault(t or "", i))
    texts = list(by_text.items())
    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[texts[a][1]], sets[texts[b][1]]
            if x and y and len(x & y) >= threshold * len(x | y):
                links[texts[a][0]] += 1
                links[texts[b][0]] += 1
                root[find(texts[a][1])] = find(texts[b][1])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, least.get(find(i)), links[t or ""]) for i, (d, t) in enumerate(rows))


def copies(n, edits):
    rng = np.random.default_rng(9)
    base = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.integers(0, 200, edits):
            words[at] = f"e{rng.integers(0, 4)}"
        rows.append((i, " ".join(words)))
    return rows


def test_jaccard_links(spark, documents, odd):
    for df in (documents, odd, spark.createDataFrame(copies(40, 3), "doc_id long, text string"), odd.limit(0)):
        got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_links(df).collect())
        assert got == classes_by_hand([(r.doc_id, r.text) for r in df.collect()])


def test_jaccard_links_over_several_blocks(spark):
    rows = copies(60, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_links(df, block=16).collect())
    assert got == classes_by_hand(rows)


def test_keep_one(odd):
    assert Counter(r.doc_id for r in ngram_join.keep_one(odd).collect()) == Counter([1, 5, 3, 7, 8])


def test_keep_one_with_different_texts_under_one_id(spark):
    def text(name, last="z"):
        return " ".join([*(f"{name}{i}" for i in range(40)), last])

    rows = [(5, text("a")), (5, text("b")), (3, text("c")), (5, text("c")), (7, text("c", "y")), (5, text("b")), (9, text("d")), (9, text("d", "y"))]
    got = Counter(tuple(r) for r in ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    d = min((text("d"), text("d", "y")), key=lambda t: hashlib.md5(t.encode()).digest())
    assert got == Counter([(5, text("a")), (5, text("b")), (3, text("c")), (9, d)])


def test_near_copies_without_an_id(spark):
    near = [t for _, t in copies(3, 1)]
    other = [t.replace("t", "u") for t in near]
    rows = [(4, near[0]), (None, near[1]), (None, near[1]), (6, near[2]), (None, other[0]), (None, other[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in ngram_join.jaccard_links(df).collect())
    assert got == classes_by_hand(rows)
    kept = [tuple(r) for r in ngram_join.keep_one(df).collect()]
    assert len(kept) == 2 and (4, near[0]) in kept and {i for i, _ in kept} == {4, None}


def test_contracted_stars_have_the_same_components(spark):
    rng = np.random.default_rng(1)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))], "a long, b long")
    scratch = Scratch(spark)
    whole = components.connected_components(edges, scratch).collect()
    fewer = components.connected_components(components.contract(edges), scratch).collect()
    assert {tuple(r) for r in whole} == {tuple(r) for r in fewer}


# --- queries and pipeline -------------------------------------------------------


def test_every_query_returns_its_columns(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, query in queries.queries().items():
        rows = query(spark, SF)
        if name.split("_")[0] in ("op5", "op6", "op7", "op8", "op9", "op10", "op12", "op13"):
            assert rows.count() == n, name
            assert rows.select("doc_id").distinct().count() == n, name


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert {r.doc_id for r in docs.collect()} <= {r.doc_id for r in before.collect()}
    assert 0 < docs.count() < len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    packed_is_exact(packed, [(r.doc_id, r.text) for r in docs.collect()])


def test_line_query_hashes_the_kept_text(spark):
    rows = queries.op9_line_dedup(spark, SF).collect()
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in lines_by_hand([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])}
    assert {r.doc_id: r.kept_sha256 for r in rows} == want
