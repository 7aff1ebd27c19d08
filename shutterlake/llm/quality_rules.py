"""Quality rules as a bitmask ledger, with DataFrame functions only.

ledger() measures each text once and stores the measurements and one bit for
each rule that the text fails. Policies are versioned sets of bits: verdicts and
ablations then need bit operations on the ledger alone, never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more. Windows count by 64-bit hash within a text."""

    def among(h: Column) -> Column:
        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        repeated = _let(
            F.sort_array(marked),
            lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))),
        )
        covered = F.flatten(F.transform(repeated, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.size(F.array_distinct(covered)))

    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(windows, among)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_pipes", "n_bangs", "n_caps4", "n_lines", "n_digits", "n_distinct_words")


def measure(docs: DataFrame, text: str = "text", carry: str = "doc_id") -> DataFrame:
    """docs' doc_id with the columns of MEASURES (long). A null text counts as empty: no words, all zero.

    Repeated rows and null ids are measured like any other; other columns of
    docs are not read. carry names the column that stays beside the measures.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(carry).alias(carry), t.alias("t"))
    arrays = base.select(carry, "t", F.filter(F.split("t", _SPACE), lambda w: w != "").alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    number = {
        "n_words": F.size("words"),
        "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("t", F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _let(F.col("words"), _repeat_words),
        "n_pipes": F.regexp_count("t", F.lit(r"\|")),
        "n_bangs": F.regexp_count("t", F.lit(r"[!?]{2}")),
        "n_caps4": F.regexp_count("t", F.lit(r"\p{Lu}{4}")),
        "n_lines": F.size("lines"),
        "n_digits": F.regexp_count("t", F.lit("[0-9]")),
        "n_distinct_words": F.size(F.array_distinct("words")),
    }
    return arrays.select(carry, *[number[k].cast("long").alias(k) for k in MEASURES])


@dataclass(frozen=True)
class Rule:
    """A rule fails where the condition over the measurements holds. Bits never change their meaning."""

    bit: int
    name: str
    fails: str


#: Ratios are compared as products, so no division by zero and no rounding.
RULES = (
    Rule(0, "short", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 3 * n_words"),
    Rule(3, "table_bars", "5 * n_pipes > n_words"),
    Rule(4, "shouting", "8 * n_caps4 > word_chars"),
    Rule(5, "bangs", "10 * n_bangs > 3 * n_words"),
    Rule(6, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(7, "few_letters", "2 * (n_symbols + n_digits) > word_chars"),
    Rule(8, "word_length", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    Rule(9, "digits", "10 * n_digits > 3 * word_chars"),
)

BASE = 0b11
#: Versioned policies: the bits that reject a text.
POLICIES = {"base-1": BASE, "corpus-1": 0b1111111111}


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", carry: str = "doc_id") -> DataFrame:
    """measure() with fail_bits (long): bit b is set if the rule of bit b fails. An empty text fails only `short` and what its zeros fail."""
    bits = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, text, carry).withColumn("fail_bits", bits)


def apply_policy(ledger_rows: DataFrame, mask: int) -> DataFrame:
    """Adds kept: no bit of the mask is set."""
    return ledger_rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0)


def ablations(ledger_rows: DataFrame, mask: int, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per rule of the policy: texts that fail it, that fail only it, and that the policy keeps without it.

    One pass: the ledger is first counted by its bits, at most 2^rules rows.
    """
    masked = ledger_rows.select(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n"))
    table = F.explode(F.array(*[F.struct(F.lit(r.bit).alias("bit"), F.lit(r.name).alias("rule")) for r in rules if mask >> r.bit & 1]))
    one = F.expr("shiftleft(1L, r.bit)")
    rows = masked.select("bits", "n", table.alias("r")).select("bits", "n", F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit"), one.alias("one"))
    fails = F.col("bits").bitwiseAND(F.col("one")) != 0
    alone = F.col("bits") == F.col("one")
    return rows.groupBy("bit", "rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("kept_without"),
    )


def keep_rows(docs: DataFrame, mask: int) -> DataFrame:
    """The rows of docs, all columns as they are, that the policy keeps. Without a shuffle: the row travels as one struct."""
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    kept = apply_policy(ledger(row, carry="row"), mask).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
