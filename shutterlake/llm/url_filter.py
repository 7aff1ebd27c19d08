"""URL filter by a character language-model ratio, with DataFrame functions only.

Two smoothed variable-order Markov models, of accepted and of rejected URLs,
score each character by the log of its likelihoods' ratio, in the longest context
that the models know. A URL's score is the mean over its characters; the cut is
calibrated on URLs that the models did not see.

The models hold every context. The ratios of the most frequent strings, HOT_ROWS
at most, go to every task; the others are found by a shuffle join, so that no
task has the models whole. A list of terms
gives the first rejected examples. What no term is on counts as accepted, but for
sites that stand out from the others towards the rejected ones: the nearer of
them become rejected examples, the rest teach neither model, so that unlisted bad
sites do not vouch for each other.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.llm.common import Scratch

ORDER = 4  # characters of context at most
ALPHABET = 256  # the order below zero: each character alike
PAD = "\x02"
CHUNK = 512

#: Terms that mark a host as rejected when models are learned: the first examples. They judge no URL themselves.
REJECT_TERMS = ("adult", "porn", "xxx", "sex", "escort", "casino", "poker", "bets", "betting", "lottery", "spam", "clickbait", "cheap", "pills", "viagra", "payday", "free-money", "ads-", "adserver", "phish", "malware", "warez")
#: Strings at most whose ratios go to every task (about 40 bytes each: 16 MB); those of all others are joined by a shuffle.
HOT_ROWS = 400_000
#: Scores are counted in bins of this width, from -SPAN to SPAN, to find the cut.
BIN, SPAN = 0.01, 8.0
#: A site is in doubt if its score lies this many deviations above the middle of its class, and this part of the way or more to that of the
#: other; it is taken for rejected from this greater part on.
DEVIATIONS, PART, MOST = 2.0, 1 / 3, 2 / 3
#: Host names in front of a site's own.
FRONT = r"^www?[0-9]*\."


@dataclass(frozen=True)
class Rule:
    """Fits the host and its subdomains where the path starts with this one."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and for URLs without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def whole_url(url: Column) -> Column:
    """What is scored: all behind the scheme, query and fragment too, the host in lower case; empty for null and for URLs without ://."""
    host, _ = split_url(url)
    return F.concat(host, F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*(.*)$", 1))


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. For lists of up to about a thousand rules."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered]
    text = reduce(lambda acc, x: acc.when(x[0], F.lit(x[1].text)), zip(fits, ordered, strict=True), F.when(F.lit(False), F.lit("")))
    verdict = reduce(lambda acc, x: acc.when(x[0], F.lit(x[1].verdict)), zip(fits, ordered, strict=True), F.when(F.lit(False), F.lit("")))
    return text, verdict


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row per character of a URL: the character with ORDER characters before it."""
    padded = F.concat(F.lit(PAD * ORDER), F.col("u"))
    # In pieces of CHUNK characters, so that a long URL takes few steps over it.
    pieces = F.transform(F.sequence(F.lit(1), F.char_length("u"), F.lit(CHUNK)), lambda i: F.substring(padded, i, F.lit(CHUNK + ORDER)))
    windows = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - ORDER), lambda i: F.substring(p, i, F.lit(ORDER + 1)))))
    return urls.where(F.char_length("u") > 0).select(*keep, F.explode(windows).alias("gram"))


def log_ratios(grams: DataFrame, models: int, scratch: Scratch) -> list[DataFrame]:
    """gram(ORDER + 1 characters), a0, r0, a1, r1 ... (counts of accepted and rejected in each model) -> for each length from 1 to ORDER + 1: g, ratio0, ratio1 ...

    A ratio is ln P(rejected) - ln P(accepted), P of the last character of g
    after the others. Witten-Bell smoothing: an order's estimate is mixed with
    that of the next shorter context, weighted by how many different characters
    followed. Every gram of every length stays.
    """
    counts = [f"{x}{m}" for m in range(models) for x in "ar"]
    ends = F.explode(F.transform(F.sequence(F.lit(0), F.lit(ORDER)), lambda k: F.struct(k.alias("k"), F.substring(F.col("gram"), F.lit(ORDER + 1) - k, k + 1).alias("g")))).alias("e")
    orders = scratch.write(grams.select(ends, *counts).groupBy("e.k", "e.g").agg(*[F.sum(c).alias(c) for c in counts]), "orders")
    levels: list[DataFrame] = []
    for k in range(ORDER + 1):
        own = orders.where(F.col("k") == k).drop("k").withColumn("ctx", F.expr(f"substring(g, 1, {k})"))
        followed = [F.sum(c).alias(f"n_{c}") for c in counts] + [F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in counts]
        rows = own.join(own.groupBy("ctx").agg(*followed), "ctx")
        if levels:  # every gram's end is a gram of the length before
            rows = rows.withColumn("s", F.substring("g", 2, k)).join(levels[-1].select(F.col("g").alias("s"), *[f"q_{c}" for c in counts]), "s")
        else:
            rows = rows.withColumns({f"q_{c}": F.lit(1.0 / ALPHABET) for c in counts})
        mixed = [F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"q_{c}")).alias(f"q_{c}") for c in counts]
        levels.append(scratch.write(rows.select("g", *mixed), f"level{k}"))
    scratch.drop(orders)
    return [x.select("g", *[(F.log(f"q_r{m}") - F.log(f"q_a{m}")).alias(f"ratio{m}") for m in range(models)]) for x in levels]


def scored(urls: DataFrame, levels: list[DataFrame], model: Column, scratch: Scratch, hot_rows: int, *keep: str) -> DataFrame:
    """keep, score: the mean ratio over the characters of u by the model of that number, each in the longest context that the models know; 0 where they know none.

    Each different gram of the URLs is looked up once, by joins of any size. The
    most frequent grams, all whose count reaches the least power of two that
    leaves hot_rows, go to every task; the others are too rare to make a heavy
    key and are joined by a shuffle. The driver sees one row per power.
    """
    rows = _grams(urls.withColumn("model", model), "model", *keep)
    seen = rows.groupBy("gram").agg(F.floor(F.log2(F.count(F.lit(1)))).cast("int").alias("power"))
    for k, level in enumerate(levels):
        ratios = F.array(*[F.col(c) for c in level.columns if c != "g"])
        named = level.select(F.col("g").alias(f"g{k}"), ratios.alias(f"r{k}"))
        seen = seen.join(named, F.expr(f"substring(gram, {ORDER + 1 - k}, {k + 1})") == F.col(f"g{k}"), "left")
    found = F.coalesce(*[F.col(f"r{k}") for k in reversed(range(len(levels)))], F.array_repeat(F.lit(0.0), len(levels[0].columns) - 1))
    seen = scratch.write(seen.select("gram", "power", found.alias("ratios")), "seen")
    sizes = {r.power: r.n for r in seen.groupBy("power").agg(F.count(F.lit(1)).alias("n")).collect()}
    least = 0
    while sum(n for p, n in sizes.items() if p >= least) > hot_rows:
        least += 1
    hot, rare = (seen.where(c).select("gram", "ratios") for c in (F.col("power") >= least, F.col("power") < least))
    near = rows.join(F.broadcast(hot), "gram", "left")
    if least:
        near = near.where(F.col("ratios").isNotNull()).unionByName(near.where(F.col("ratios").isNull()).drop("ratios").join(rare, "gram"))
    return near.groupBy(*keep).agg(F.avg(F.get("ratios", F.col("model"))).alias("score"))


def doubtful_sites(urls: DataFrame, scratch: Scratch, hot_rows: int) -> DataFrame:
    """site, near of accepted URLs that look more like rejected ones than the others do; near: so much that they are taken for such.

    Two models, each of half of the sites, score the sites of the other half: no
    site is judged by its own URLs. A site weighs by the logarithm of its URLs.
    The middle and the spread of the accepted ones come from their quartiles, so
    that even many bad sites among them move neither far; there is no limit to
    how many may be in doubt.
    """
    half = F.pmod(F.xxhash64("site"), F.lit(2)).cast("int")
    known = urls.where("label is not null").withColumn("half", half)
    which = {f"{x}{m}": F.count_if((F.col("label") == label) & (F.col("half") != m)) for m in (0, 1) for x, label in (("a", "accepted"), ("r", "rejected"))}
    grams = _grams(known, "label", "half").groupBy("gram").agg(*[c.alias(k) for k, c in which.items()])
    crossed = scored(known, log_ratios(grams, 2, scratch), F.col("half"), scratch, hot_rows, "h1", "h2", "site", "label")
    sites = crossed.groupBy("site", "label").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))
    sites = scratch.write(sites.withColumn("half", half), "sites")
    at = lambda label, share: F.percentile_approx(F.when(F.col("label") == label, F.col("score")), F.lit(share), F.lit(10000))
    weighted = sites.withColumn("label", F.explode(F.array_repeat("label", F.least(F.ceil(F.log2("n") + 1), F.lit(64)).cast("int"))))
    # Each model has a scale of its own; a half without rejected sites takes the way between the classes from the other.
    found = weighted.groupBy("half").agg(at("accepted", 0.5).alias("good"), at("accepted", 0.25).alias("low"), at("accepted", 0.75).alias("high"), at("rejected", 0.5).alias("bad"))
    found = found.withColumn("way", F.coalesce(F.col("bad") - F.col("good"), F.max(F.col("bad") - F.col("good")).over(Window.partitionBy(F.lit(0)))))
    spread, way = (F.col("high") - F.col("low")) / 1.349, F.col("way")  # of a normal distribution: one deviation
    above = F.col("score") - F.col("good")
    doubtful = sites.join(F.broadcast(found), "half").where((F.col("label") == "accepted") & F.col("way").isNotNull() & (above > F.greatest(DEVIATIONS * spread, PART * way)))
    return doubtful.groupBy("site").agg(F.max(above > F.greatest(DEVIATIONS * spread, MOST * way)).alias("near"))


def calibrated(scores: DataFrame, false_blocks: float) -> float:
    """The cut over scores(label, held, score): infinite if a class has no URL, else not below zero.

    The lesser of two: the score above which false_blocks of the held-out
    accepted URLs lie, and that at which the shares of wrong verdicts on both
    held-out classes have the least sum. The second one stays between the
    classes even where many URLs count as accepted only because no term is on
    them. The driver sees counts by bin, never URLs.
    """
    place = F.floor(F.greatest(F.least("score", F.lit(SPAN)), F.lit(-SPAN)) / BIN).cast("int")
    counted = scores.where(F.col("label").isNotNull()).groupBy("label", "held", place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    if {r.label for r in counted} != {"accepted", "rejected"}:
        return float("inf")
    held = [r for r in counted if r.held]
    good, bad = ({r.bin: r.n for r in held if r.label == x} for x in ("accepted", "rejected"))
    n_good, n_bad = max(sum(good.values()), 1), max(sum(bad.values()), 1)
    above, missed, best, quantile = sum(good.values()), 0, (2.0, SPAN), SPAN
    for at in range(int(-SPAN / BIN), int(SPAN / BIN) + 1):  # blocked: bins above `at`
        above -= good.get(at, 0)
        missed += bad.get(at, 0)
        cut = (at + 1) * BIN
        best = min(best, (above / n_good + missed / n_bad, cut))
        if above / n_good <= false_blocks:
            quantile = min(quantile, cut)
    return max(0.0, min(quantile, best[1]))


def judge(pages: DataFrame, rules: tuple[Rule, ...], reject_terms: tuple[str, ...] = REJECT_TERMS, false_blocks: float = 0.005, hot_rows: int = HOT_ROWS) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, score.

    A rule's verdict stands. Other URLs are blocked if their score exceeds the
    cut of calibrated(). To learn, URLs whose host holds a reject term count as
    rejected unless a rule allows them, all others as accepted unless a rule
    blocks them, each different URL once; accepted URLs of doubtful_sites()
    count as rejected or teach nothing. A fifth by hash is held out for the cut. Null and
    malformed URLs have empty host and path, no score, and are allowed; so is
    all else if either class has no URL. Repeated rows are judged each.
    """
    scratch = Scratch(pages.sparkSession)
    url = F.col("url").cast("string")
    host, path = split_url(url)
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"), whole_url(url).alias("u"))
    parsed = parsed.select("page_id", "host", "path", "u", rule.alias("rule"), verdict.alias("ruled"))
    term = reduce(lambda a, b: a | b, [F.col("host").contains(t) for t in reject_terms], F.lit(False))
    ruled = F.coalesce("ruled", F.lit(""))
    label = F.when(term & (ruled != "allow"), "rejected").when(~term & (ruled != "block"), "accepted")
    site = F.substring_index(F.regexp_replace("host", FRONT, ""), ".", -3)
    urls = parsed.where("u != ''").select("u", site.alias("site"), label.alias("label")).groupBy("u").agg(F.max("label").alias("label"), F.max("site").alias("site"))
    urls = scratch.write(urls.withColumns({"h1": F.xxhash64("u"), "h2": F.xxhash64(F.lit(3), "u"), "held": F.pmod(F.xxhash64("u"), F.lit(5)) == 0}), "urls")
    doubt = scratch.write(doubtful_sites(urls, scratch, hot_rows), "doubt")
    sure = F.when(F.col("near").isNull() | (F.col("label") != "accepted"), F.col("label")).when(F.col("near"), "rejected")
    urls = urls.join(doubt, "site", "left").withColumn("label", sure).drop("near", "site")
    counts = _grams(urls.where("label is not null and not held"), "label").groupBy("gram").agg(F.count_if(F.col("label") == "accepted").alias("a0"), F.count_if(F.col("label") == "rejected").alias("r0"))
    scores = scratch.write(scored(urls, log_ratios(counts, 1, scratch), F.lit(0), scratch, hot_rows, "h1", "h2", "label", "held"), "scores")
    scratch.keep(scores)
    cut = calibrated(scores, false_blocks)
    # Rows without a score would all meet under one key: theirs is the page's.
    keys = {"h1": F.xxhash64("u"), "h2": F.when(F.col("u") == "", F.xxhash64("page_id")).otherwise(F.xxhash64(F.lit(3), "u"))}
    judged = parsed.withColumns(keys).join(scores.select("h1", "h2", "score"), ["h1", "h2"], "left")
    by_score = F.when(F.col("score") > cut, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_score).alias("verdict"), "score")
