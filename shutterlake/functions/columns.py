"""Scalar functions: text, vectors, dates, money, geometry and JSON, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts(rows: DataFrame, most: int) -> int:
    """How many parts of about `most` rows each."""
    return max(1, -(-rows.count() // most))


# --- text -------------------------------------------------------------------

#: What a stem leaves out, in this order (extension, edit marks, copy marks, counters in brackets),
#: and where a file's number stands.
STEM_NOISE = (r"\.[^.]*$", r"(?i)(_edited)+", r"(?i)(_copy)+", r"[\s_-]*\(\d+\)")
COUNTERS = (r"(\d{3,7})", r"(\d{1,2})(?:\.[^.]*)?$")


def stem(filename: Column) -> Column:
    """Lower-cased name without extension, copy and edit marks and counters in brackets."""
    bare = filename
    for pattern in STEM_NOISE:
        bare = F.regexp_replace(bare, pattern, "")
    return F.lower(F.trim(bare))


def sequence_number(filename: Column) -> Column:
    """The first three to seven digits, else one or two before the extension, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(filename, p, 1), F.lit("")) for p in COUNTERS]).cast("long")


def phone_key(phone: Column) -> Column:
    """The last ten digits, or empty."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise("")


def masked(secret: Column) -> Column:
    """First and last four characters of secrets of eight or more, else stars only."""
    return F.when(F.length(secret) >= 8, F.concat(F.left(secret, F.lit(4)), F.lit("…"), F.right(secret, F.lit(4)))).otherwise("****")


def normal_url(url: Column) -> Column:
    """Without query and fragment, and without slashes at the end; https where no scheme is given."""
    bare = F.rtrim(F.regexp_replace(F.trim(url), r"[?#].*$", ""), F.lit("/"))
    return F.when(F.trim(url) == "", "").when(bare.rlike(r"^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))


def renamed(pattern: str, filename: Column, index: Column) -> Column:
    """{original} and {index} of a rename pattern filled in, as .jpg."""
    base = F.regexp_replace(filename, r"\.[^.]*$", "")
    return F.concat(F.replace(F.replace(F.lit(pattern), F.lit("{original}"), base), F.lit("{index}"), F.lpad(index.cast("string"), 4, "0")), F.lit(".jpg"))


def exif_time(text: Column) -> Column:
    """yyyy:MM:dd HH:mm:ss of the first 19 characters, else null."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss"))


def cache_key(*parts: str) -> Column:
    """Twelve characters that stand for the given columns."""
    return F.left(F.md5(F.concat_ws("|", *parts)), F.lit(12))


def is_key(text: Column) -> Column:
    """Whether the text can be an album's key: 6 to 64 letters, digits, - and _; false for null."""
    return F.coalesce(text.rlike(r"^[a-zA-Z0-9_-]{6,64}$"), F.lit(False))


def one_of(text: Column, words: tuple[str, ...]) -> Column:
    """The word that the text is in any case, else null."""
    return F.when(F.upper(text).isin(*words), F.upper(text))


# --- vectors ----------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, vectors of unequal length and zero vectors."""
    of = let(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), lambda product: F.when(product > 0, dot(a, b) / F.nullif(product, F.lit(0.0))).otherwise(0.0))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), of).otherwise(0.0)


def centred(v: Column) -> Column:
    """The vector less its mean, of length one; zeros if it does not vary."""
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    moved = let(mean, lambda m: F.transform(v, lambda x: x.cast("double") - m))
    return let(moved, lambda u: let(F.sqrt(dot(u, u)), lambda n: F.transform(u, lambda x: F.when(n > 1e-6, x / n).otherwise(0.0))))


def zncc(a: Column, b: Column) -> Column:
    """Correlation of two centred unit vectors, not below 0."""
    return F.greatest(F.lit(0.0), dot(a, b))


def sign_hash(v: Column) -> Column:
    """64 sign bits of a vector of 64 numbers as a long, the first as the highest bit."""
    return F.aggregate(v, F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two longs; 999 if either is null."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(999))


# --- geometry and money -----------------------------------------------------


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes struct(x, y, w, h)."""
    w = F.greatest(F.lit(0.0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0.0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union > 0, w * h / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def discount(base: Column, percent: Column, currency: Column) -> Column:
    """Whole rupees for INR, cents elsewhere."""
    return F.when(currency == "INR", F.round(base * percent / 100)).otherwise(F.round(base * percent / 100, 2))


def rounded(value: Column, places: int) -> Column:
    """Half up in decimal, after eight places, so that the binary form of a number does not decide."""
    return F.round(value.cast("decimal(20,8)"), places).cast("double")


def commission(amount: Column, rate: Column) -> Column:
    return rounded(amount * rate / 100, 2)


def json_or(text: Column, path: str, kind: str, default: object) -> Column:
    """A field of a JSON text; the default where the text is null or malformed, or the field is missing or of another type."""
    return F.coalesce(F.get_json_object(text, path).try_cast(kind), F.lit(default).cast(kind))


# --- colour -----------------------------------------------------------------


def hue_saturation(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Hue in degrees and saturation from 0 to 255 of 8-bit colours; both 0 for greys."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = F.nullif(high - low, F.lit(0))
    hue = F.when(high == r, F.pmod((g - b) * 60.0 / span, F.lit(360.0))).when(high == g, (b - r) * 60.0 / span + 120).otherwise((r - g) * 60.0 / span + 240)
    return F.coalesce(hue, F.lit(0.0)), F.coalesce(255.0 * (high - low) / F.nullif(high, F.lit(0)), F.lit(0.0))


def saturation_share(r: Column, g: Column, b: Column) -> Column:
    """Saturation from 0 to 1, by one division; 0 for black."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.coalesce((high - low) / F.nullif(high, F.lit(0)), F.lit(0.0))


def hsv_histogram(pixels: DataFrame, key: str, hues: int = 8, saturations: int = 4) -> DataFrame:
    """pixels(key, r, g, b) -> key, bin, share: each bin's count from 0 (the least) to 1 (the most). Pixels are counted by bin on the map side."""
    hue, saturation = hue_saturation(F.col("r"), F.col("g"), F.col("b"))
    row, column = F.least(F.floor(hue / (360 / hues)), F.lit(hues - 1)), F.least(F.floor(saturation / (256 / saturations)), F.lit(saturations - 1))
    counts = pixels.groupBy(key, (row * saturations + column).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    size = hues * saturations
    dense = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    full = dense.select(key, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("n"))
    low, high = F.array_min("n"), F.array_max("n")
    rows = full.select(key, low.alias("low"), high.alias("high"), F.posexplode("n").alias("bin", "n"))
    return rows.select(key, "bin", F.round(F.when(F.col("high") > F.col("low"), (F.col("n") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0), 6).alias("share"))
