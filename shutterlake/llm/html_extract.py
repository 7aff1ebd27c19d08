"""Main text of HTML pages by site template removal.

Pages are cut into element subtrees, which have two hashes: of their tags and
texts, and of the place they fill (tags, classes and ids from the root down). Both
are counted per host. Subtrees that recur across many pages of the host are
deleted, and outside the main text those too that fill a place which many pages
fill, whatever stands in it today. Lists of tags and roles decide where counts
cannot: on hosts of few pages, and for parts that only some pages have. Pages
that are copies of others do not count: what they share is their text, not their
site's template.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import Scratch, mix64, shingles, slices, text_buffer, words
from shutterlake.llm.url_filter import split_url

#: Fixed values of HTML: elements without content, elements whose content is no markup and is never shown,
#: elements that start a block, and elements that never hold article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe template svg noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp".split())
NEVER = frozenset("head nav header footer aside button select datalist dialog menu annotation annotation-xml".split()) | RAW
#: Elements that are often no text of an article, but may wrap the whole page.
SELDOM = frozenset(["form"])
#: What heads a page's text: a wrapper that holds it and half of the text is no part of the template. One without it must hold MOST_TEXT.
HEADS, MOST_TEXT = frozenset(["h1", "article", "main"]), 0.9
CORE = frozenset(["article", "main"])
#: Elements that carry a text's own wording: inside the article they are text, however often a passage recurs,
#: but for those of APART where they stand as blocks of their own.
WORDING = frozenset("a abbr b blockquote br caption cite code dd dt em figcaption font h1 h2 h3 h4 h5 h6 i li mark p pre q s small span strong sub sup td th u".split())
APART = frozenset("p li span".split())
CLOSES_P = BLOCK - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
ROLE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|sidebar|side-bar|widget|related|recommend\w*|share|sharing|social|comment|comments|disqus|replies|breadcrumbs?|pagination|pager|navbar|navigation|menu|masthead|site-header|page-header|site-footer|page-footer|footer|toolbar|login|signup|search)(?:$|[\s_-])", re.I)
#: Roles of what readers and sponsors add to an article: the only ones that count inside it, and on containers only.
ADDED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|newsletter|subscribe|related|recommend\w*|share|sharing|social|comment|comments|disqus|replies)(?:$|[\s_-])", re.I)
REPLIES = re.compile(r"(?:^|[\s_-])(?:comment|comments|disqus|replies)(?:$|[\s_-])", re.I)
#: Words of a class that say what a layout has, not what it is.
LAYOUT = re.compile(r"\b(?:has|have|no|not|with|without|is|hide|show|above|below|beside)[_-][\w-]*", re.I)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)>""", re.S)
#: For the rest of a page once a quote in a tag has no end: the next > ends each tag.
BARE_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
LIKE_TAG = re.compile(r"</?[a-zA-Z]")
SPACE = re.compile(r"[\s\x00-\x20]+")

#: A subtree is template if it is on this many pages of its host that are no copies, or on as many pages and this
#: share of all. Inside the article it takes CORE_PAGES or CORE_SHARE, for APART CORE_PAGES, and it must be less than half of the article.
MIN_PAGES, CORE_PAGES, MIN_SHARE, CORE_SHARE = 5, 10, 0.2, 0.5
#: A page is no copy if this share of its GRAMS sampled runs of five words are in the sample of no other text of its host.
OWN_SHARE, GRAMS = 1 / 3, 32
#: What a template may delete: subtrees outside the article, inside it, and those of APART inside it.
OUTSIDE, INSIDE, WORDS = 1, 2, 4
#: Template hashes that go to all tasks at most (9 bytes each); more are joined by host and hash, those on
#: HOT_PAGES pages or more by broadcast, so that no key has more rows than that.
BROADCAST_HASHES, HOT_PAGES = 1_000_000, 10_000


@dataclass(slots=True)
class Node:
    tag: str
    never: bool
    parent: int
    core: bool = False
    seldom: float = 0.0
    place: int = 0


@dataclass
class Page:
    nodes: list[Node]
    texts: list[str]
    owners: list[int]
    starts: list[bool]


def parse(source: str) -> Page:
    """The element tree with its text runs in order. Unclosed and stray tags are mended as browsers do in the common cases."""
    nodes, stack = [Node("", False, -1)], [0]
    texts: list[str] = []
    owners: list[int] = []
    starts: list[bool] = []
    fresh = True
    at = 0

    def add(text: str) -> None:
        nonlocal fresh
        if text and (fresh or text.strip() or texts):
            texts.append(text)
            owners.append(stack[-1])
            starts.append(fresh)
            fresh = False

    where: dict[str, list[int]] = defaultdict(list)  # of each tag, its places in the stack

    def close(tag: str, stop: frozenset[str] = frozenset()) -> None:
        """Closes the innermost element of this tag, and what is open in it, unless one of stop is open in it. Each element is closed once, so a page takes linear time."""
        if not where[tag]:
            return
        last = where[tag][-1]
        for t in stop:
            if where[t] and where[t][-1] > last:
                return
        while len(stack) > last:
            where[nodes[stack.pop()].tag].pop()

    n, last_end, form = len(source), source.rfind(">"), TAG
    while at < n:
        less = source.find("<", at)
        if less < 0:
            add(source[at:])
            break
        m = form.match(source, less) if less < last_end or source.startswith("<!--", less) else None
        if m is None and form is TAG and less < last_end and LIKE_TAG.match(source, less):
            form = BARE_TAG
            m = form.match(source, less)
        if m is None:
            if less > last_end and re.match(r"<[a-zA-Z/!?]", source[less : less + 2]):  # a tag that the end of the page cuts
                add(source[at:less])
                break
            add(source[at : less + 1])
            at = less + 1
            continue
        add(source[at:less])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            fresh = True
        if m[1]:
            if tag not in VOID:
                close(tag, frozenset({"table"}) if tag in ("tr", "td", "th", "li") else frozenset())
            continue
        if tag in ("br", "wbr"):
            add("\n" if tag == "br" else "")
            continue
        if tag in CLOSES_P and where["p"]:
            close("p", frozenset({"button", "table", "td", "th"}))
        if tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
            close(tag, frozenset({"ul", "ol", "dl", "menu", "select", "table"}))
            if tag in ("dt", "dd"):
                close("dd" if tag == "dt" else "dt", frozenset({"dl"}))
        if tag in VOID:
            continue
        if tag in RAW or tag == "xmp":
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
            if tag == "xmp":
                add(html.escape(source[at : n if end is None else end.start()]))
                fresh = True
            at = n if end is None else source.find(">", end.start()) + 1 or n
            continue
        attributes, above = m[3], nodes[stack[-1]]
        never, seldom, named = tag in NEVER and not (tag == "header" and above.core), float(MOST_TEXT if tag in SELDOM else 0), ""
        if not never and attributes and tag not in ("html", "body") and (tag not in CORE or above.core):
            said = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            never = "hidden" in re.findall(r"[\w-]+", ATTRIBUTE.sub("", attributes).lower()) or said.get("aria-hidden", "") == "true"
            named = f"{said.get('class', '')} {said.get('id', '')}"
            if not seldom and not (above.core and tag in WORDING):
                # A section of an article may have its subject's name for an id.
                role = LAYOUT.sub(" ", said.get("class", "") if above.core and tag == "section" else named)
                if said.get("role", "") in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu") or (ADDED if above.core else ROLE).search(role):
                    seldom = 2.0 if REPLIES.search(role) else MOST_TEXT
        never |= above.never
        core = above.core or tag in CORE and not never
        place = 0 if core else xxhash.xxh64_intdigest(f"{above.place} {tag} {named}".encode("utf-8", "surrogatepass"))
        nodes.append(Node(tag, never, stack[-1], core, seldom, place))
        where[tag].append(len(stack))
        stack.append(len(nodes) - 1)
    page = Page(nodes, texts, owners, starts)
    if any(node.seldom for node in nodes):
        settle(page)
    return page


def settle(page: Page) -> None:
    """Of the elements that seldom hold article text, those that wrap the text of the page, or of their article, are spared."""
    nodes = page.nodes
    size, heads = [0] * len(nodes), [n.tag in HEADS for n in nodes]
    for text, owner in zip(page.texts, page.owners, strict=True):
        if not nodes[owner].never:
            size[owner] += len(text.strip())
    for k in range(len(nodes) - 1, 0, -1):
        parent = nodes[k].parent
        size[parent] += size[k]
        heads[parent] |= heads[k] and size[k] > 0
    top = [0] * len(nodes)
    for k, node in enumerate(nodes[1:], 1):
        above = nodes[node.parent]
        top[k] = (top[node.parent] if above.core else k) if node.core else 0
        if node.seldom and not node.never:
            whole = size[top[node.parent] if above.core else 0]
            node.never = size[k] < whole * (0.5 if heads[k] else node.seldom) or not size[k]
        node.never |= above.never
        node.core = not node.never and (above.core or node.tag in CORE)


def places(page: Page) -> np.ndarray:
    """The hash of the place that each container outside the article fills; 0 for elements without text, of wording, in the article, or that hold a page's heading."""
    size = lengths(page)
    out = np.zeros(len(page.nodes), np.uint64)
    heads = [n.tag == "h1" and not n.never for n in page.nodes]
    for k in range(len(heads) - 1, 0, -1):
        heads[page.nodes[k].parent] |= heads[k]
    for k, node in enumerate(page.nodes):
        if node.place and size[k] and not heads[k] and node.tag not in WORDING and node.tag not in ("", "html", "body"):
            out[k] = node.place
    return out.view(np.int64)


def main_path(page: Page, size: np.ndarray) -> list[bool]:
    """Whether each element is, holds or is in the page's main text: that of article or main, else of the innermost element with half of the page's text."""
    nodes = page.nodes
    heart = [n.core and not n.never for n in nodes]
    if not any(h and size[k] for k, h in enumerate(heart)):
        best = max((k for k in range(len(nodes)) if 2 * size[k] >= size[0]), default=0)
        heart = [False] * len(nodes)
        heart[best] = True
        for k in range(best + 1, len(nodes)):
            heart[k] = heart[nodes[k].parent]
    for k in range(len(nodes) - 1, 0, -1):
        if heart[k] and size[k]:
            heart[nodes[k].parent] = True
    return heart


def subtree_hashes(page: Page, wanted: list[bool] | None = None) -> np.ndarray:
    """A 64-bit hash of each element's tags and texts, white space folded; 0 for elements without text, and for those not wanted (which hold no wanted one)."""
    parts: list[list[bytes] | None] = [None] * len(page.nodes)

    def add(k: int, part: bytes) -> None:
        own = parts[k]
        if own is None:
            parts[k] = [part]
        else:
            own.append(part)

    for text, owner in zip(page.texts, page.owners, strict=True):
        if wanted is None or wanted[owner]:
            bare = " ".join(text.split())
            if bare:
                add(owner, b"\x01" + bare.encode("utf-8", "surrogatepass"))
    out = np.zeros(len(page.nodes), np.int64)
    for k in range(len(page.nodes) - 1, 0, -1):
        own = parts[k]
        if own is not None:
            node = page.nodes[k]
            digest = xxhash.xxh64_digest(node.tag.encode("utf-8", "surrogatepass") + b"".join(own))
            out[k] = int.from_bytes(digest, "big", signed=True)
            add(node.parent, digest)
    return out


def has_core(page: Page) -> bool:
    """Whether an article or main element holds text that is not dropped by its elements' roles."""
    nodes = page.nodes
    return any(nodes[o].core and not nodes[o].never and t.strip() for t, o in zip(page.texts, page.owners, strict=True))


def live_hashes(page: Page) -> np.ndarray:
    """subtree_hashes of the elements that templates can still delete: those of the article, or all if there is none."""
    return subtree_hashes(page, [n.core for n in page.nodes] if has_core(page) else None)


def lengths(page: Page, dead: list[bool] | None = None) -> np.ndarray:
    """Code points of text below each element, without that of dead ones."""
    out = np.zeros(len(page.nodes), np.int64)
    for text, owner in zip(page.texts, page.owners, strict=True):
        if not dead or not dead[owner]:
            out[owner] += len(text)
    for k in range(len(out) - 1, 0, -1):
        out[page.nodes[k].parent] += out[k]
    return out


def blocks_of_their_own(page: Page) -> np.ndarray:
    """Whether the text below each element makes whole blocks: it starts one, and the text behind it starts another."""
    n = len(page.texts)
    first, last = np.full(len(page.nodes), n), np.full(len(page.nodes), -1)
    for r, owner in enumerate(page.owners):
        first[owner], last[owner] = min(first[owner], r), r
    for k in range(len(first) - 1, 0, -1):
        parent = page.nodes[k].parent
        first[parent], last[parent] = min(first[parent], first[k]), max(last[parent], last[k])
    starts = np.array([*page.starts, True])
    return starts[first] & starts[last + 1]


def text_of(page: Page, marks: dict[int, int], hashes: np.ndarray | None = None, lists: bool = True) -> str:
    """Blocks of article text, decoded, white space folded, joined by an empty line.

    marks: what the host's templates may delete (OUTSIDE, INSIDE, WORDS), by
    subtree hash. If the page has an article or main element with text, only
    their text counts, and a template goes if it is less than half of the
    article; elsewhere if it is less than half of the page and no piece of a
    block of wording. What fills a place
    that recurs goes if it neither is, holds nor is in the main text. hashes:
    live_hashes, if known. Without lists, templates alone decide.
    """
    nodes = page.nodes
    core = has_core(page)
    dead = [(n.never or core and not n.core) if lists else n.tag in RAW or n.tag == "head" for n in nodes]
    if marks:
        filled = [k for k, h in enumerate(places(page).tolist()) if h and marks.get(h, 0) & INSIDE]
        if filled:
            main = main_path(page, lengths(page, dead))
            for k in filled:
                dead[k] |= not main[k]
        found = (live_hashes(page) if hashes is None else hashes).tolist()
        hit = [k for k, h in enumerate(found) if h and not dead[k] and h in marks]
        if hit:
            size, apart = lengths(page), blocks_of_their_own(page)
            top = [0] * len(nodes)
            if core:
                for k, node in enumerate(nodes):
                    if node.core:
                        top[k] = top[node.parent] if nodes[node.parent].core else k
            for k in hit:
                tag = nodes[k].tag
                bit = (0 if tag in WORDING and not apart[k] else OUTSIDE) if not core else (WORDS if apart[k] else 0) if tag in APART else 0 if tag in WORDING else INSIDE
                dead[k] = bool(marks[found[k]] & bit) and 2 * size[k] < size[top[k]]
    for k, node in enumerate(nodes):
        if node.parent >= 0 and dead[node.parent] and not (core and node.core and not nodes[node.parent].core):
            dead[k] = True
    blocks: list[list[str]] = []
    fresh = True
    for text, owner, start in zip(page.texts, page.owners, page.starts, strict=True):
        fresh |= start
        if dead[owner]:
            continue
        if fresh:
            blocks.append([])
            fresh = False
        blocks[-1].append(text)
    joined = (" ".join(html.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(b for b in joined if b)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, html -> host, the text's hash, the least GRAMS hashes of its runs of five words, and the subtrees' hashes."""
    longs = pa.list_(pa.int64())
    for batch in batches:
        for part in slices(batch, "html"):
            pages = list(map(parse, part.column(1).to_pylist()))
            texts = [text_of(p, {}) for p in pages]
            h, _, _, offsets = words(*text_buffer(pa.array(texts, pa.string())))
            s, at = shingles(h, offsets)
            grams = [np.unique(s[a:b])[:GRAMS].view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
            found = [np.unique(x[x != 0]) for x in (np.concatenate([subtree_hashes(p), places(p)]) for p in pages)]
            keys = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys), pa.array(grams, longs), pa.array(found, longs)], names=["host", "key", "grams", "hashes"])


def templates(sketches: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, key, grams, hashes of each page -> host, hash, mark, pages of the templates.

    Pages with one text count once, and pages that share most of their words
    with another text not at all. All counts are sums that start on the map
    side: a host with a third of all pages is no hot spot.
    """
    texts = sketches.groupBy("host", "key").agg(F.first(F.struct("grams", "hashes")).alias("t")).select("host", "key", "t.*")
    grams = texts.select("host", "key", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    # A run of words that one text alone has leads back to that text by its least key.
    own = grams.groupBy("host", "gram").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"), F.min("size").alias("size")).where("n = 1")
    single = own.groupBy("host", "key").agg(F.count(F.lit(1)).alias("own"), F.min("size").alias("size")).where(F.col("own") >= OWN_SHARE * F.col("size"))
    votes = texts.join(single.select("host", "key"), ["host", "key"]).select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    everywhere = F.when(F.col("n") >= max(min_pages, CORE_PAGES), OUTSIDE | INSIDE | WORDS).otherwise(OUTSIDE)
    counts = sketches.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    sizes = sketches.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    shares = counts.join(sizes, "host").withColumn("share", F.col("n") / F.col("pages"))
    marked = shares.select("host", "hash", F.when(F.col("share") >= max(min_share, CORE_SHARE), OUTSIDE | INSIDE).when(F.col("share") >= min_share, OUTSIDE).otherwise(0).alias("mark"), "n")
    both = marked.unionByName(votes.select("host", "hash", everywhere.alias("mark"), "n"))
    return both.groupBy("host", "hash").agg(F.bit_or("mark").cast("int").alias("mark"), F.max("n").alias("pages")).where("mark > 0")


def _host_key(host: str) -> int:
    return xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))


def _texts(carry: int, known: tuple[np.ndarray, np.ndarray] | None):
    """known: sorted keys of host and subtree, and their marks; without it each row brings the hashes and marks of its templates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__html"):
                texts = []
                pages = map(parse, part.column(carry + 1).to_pylist())
                if known is None:
                    for page, hashes, marks in zip(pages, part.column(carry + 2).to_pylist(), part.column(carry + 3).to_pylist(), strict=True):
                        texts.append(text_of(page, dict(zip(hashes, marks, strict=True)) if hashes else {}))
                else:
                    keys, every = known
                    for page, host in zip(pages, part.column(carry).to_pylist(), strict=True):
                        marks, live = {}, None
                        if host and len(keys):
                            live, there = live_hashes(page), places(page)
                            h = np.concatenate([live, there])
                            mine = mix64(h.view(np.uint64) ^ np.uint64(_host_key(host)))
                            place = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                            hit = np.flatnonzero((keys[place] == mine) & (h != 0))
                            marks = dict(zip(h[hit].tolist(), every[place[hit]].tolist(), strict=True))
                        texts.append(text_of(page, marks, live))
                names = part.schema.names[:carry]
                yield pa.RecordBatch.from_arrays([*part.columns[:carry], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return run


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """The carried columns of pages(url, html) with text and n_chars (long).

    Null and empty html give an empty text. A page whose url has no host has no
    template, only the elements that are never article text go. Repeated rows
    are extracted each.
    """
    host, _ = split_url(F.col("url").cast("string"))
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(*carry, host.alias("__host"), source.alias("__html"))
    scratch = Scratch(pages.sparkSession)
    schema = rows.select(*carry).withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    named = rows.where("__host != ''").select(F.col("__host").alias("host"), F.col("__html").alias("html"))
    sketches = scratch.write(named.mapInArrow(_sketch, "host string, key long, grams array<long>, hashes array<long>"), "sketches")
    found = scratch.write(templates(sketches, min_pages, min_share), "templates")
    scratch.drop(sketches)
    if found.count() <= broadcast_hashes:
        table = found.select("host", "hash", "mark").toArrow().combine_chunks()
        hosts = table.column("host").to_pylist()
        keys = mix64(np.asarray(table.column("hash"), np.int64).view(np.uint64) ^ np.array([_host_key(x) for x in hosts], np.uint64))
        order = np.argsort(keys)
        known = keys[order], np.asarray(table.column("mark"), np.int32)[order].astype(np.int8)
        return rows.select(*carry, "__host", "__html").mapInArrow(_texts(len(carry), known), schema)
    k1, k2 = F.xxhash64("__html"), F.xxhash64(F.lit(3), "__html")
    once = rows.where("__host != ''").select(F.col("__host").alias("host"), k1.alias("k1"), k2.alias("k2"), F.col("__html").alias("html")).dropDuplicates(["host", "k1", "k2"])
    own = scratch.write(once.mapInArrow(_own_hashes, "host string, k1 long, k2 long, hash long"), "own")
    hot, cold = found.where(F.col("pages") >= HOT_PAGES), found.where(F.col("pages") < HOT_PAGES)
    hits = own.join(F.broadcast(hot), ["host", "hash"]).unionByName(own.join(cold, ["host", "hash"]))
    sets = hits.groupBy(F.col("host").alias("__host"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.collect_list(F.struct("hash", "mark")).alias("__t"))
    joined = rows.withColumns({"__k1": k1, "__k2": k2}).join(sets, ["__host", "__k1", "__k2"], "left")
    return joined.select(*carry, "__host", "__html", F.col("__t.hash").alias("__hashes"), F.col("__t.mark").alias("__marks")).mapInArrow(_texts(len(carry), None), schema)


def _own_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            pages = map(parse, part.column(3).to_pylist())
            found = [np.unique(h[h != 0]) for h in (np.concatenate([subtree_hashes(p), places(p)]) for p in pages)]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([*[c.take(row) for c in part.columns[:3]], pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], names=["host", "k1", "k2", "hash"])
