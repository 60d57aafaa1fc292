"""String expressions of price tags: trimming, prices, key-value codes, data URIs.

All are built-in Spark expressions.  Patterns are Unicode-aware (`(?U)`), so a no-break space
separates like any other, and so do the four separators \\x1c to \\x1f.  A null is an empty text; a
missing value is the empty string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The keys of a tag's code, in lower case, and the column that each one fills.
CODE_KEYS = {
    "qr_code_barcode": ["barcode"],
    "price1_qr": ["price1", "p1"],
    "price2_qr": ["price2", "p2"],
    "price3_qr": ["price3", "p3"],
    "price4_qr": ["price4", "p4"],
    "wholesale_level_1_count": ["wholesale_level_1_count"],
    "wholesale_level_1_price": ["wholesale_level_1_price"],
    "wholesale_level_2_count": ["wholesale_level_2_count"],
    "wholesale_level_2_price": ["wholesale_level_2_price"],
    "action_price_qr": ["actionprice", "ap"],
    "action_code_qr": ["actioncode", "ac"],
}

# A price with two decimals, a stand-alone number, a signed number, one before a percent sign.
DECIMAL_PRICE = r"(?U)(\d{1,6})[.,\s\x1c-\x1f](\d{2})\b"
WHOLE_PRICE = r"(?U)\b(\d{2,6})\b"
SIGNED = r"(?U)(-?\d+)"
PERCENT = r"(?U)(-?\d+)[\s\x1c-\x1f]*%"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def text_of(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    """Without white space of any script at both ends (`trim` removes spaces only)."""
    return F.regexp_replace(text_of(value), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def found(value: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.nullif(F.regexp_extract(text_of(value), pattern, 1), F.lit(""))


def extract_price(value: Column) -> Column:
    """`int.frac` of the first price with decimals, else the first whole number with `.00`, else ''."""
    decimals = F.concat(found(value, DECIMAL_PRICE), F.lit("."), F.regexp_extract(text_of(value), DECIMAL_PRICE, 2))
    return F.coalesce(decimals, F.concat(found(value, WHOLE_PRICE), F.lit(".00")), F.lit(""))


def format_price(value: Column) -> Column:
    return F.replace(strip(value), F.lit("."), F.lit(","))


def assume_kopecks(price: Column) -> Column:
    """A price read without kopecks (`.00`) ends in `.99`."""
    return F.regexp_replace(price, r"\.00$", ".99")


def parse_code(payload: Column, separator: str = ";") -> Column:
    """Struct of the columns of CODE_KEYS: parts `key=value`, the last of each column's keys wins."""
    parts = F.filter(F.split(text_of(payload), re.escape(separator), -1), lambda x: x.contains("="))
    key = lambda x: F.lower(strip(F.substring_index(x, "=", 1)))
    value = lambda x: strip(F.substring(x, F.instr(x, "=") + 1, F.length(x)))
    pairs = F.transform(parts, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")))
    last = lambda found, keys: F.coalesce(F.try_element_at(F.filter(found, lambda p: p["k"].isin(keys)), F.lit(-1))["v"], F.lit(""))
    return let(pairs, lambda found: F.struct(*(last(found, keys).alias(name) for name, keys in CODE_KEYS.items())))


def decoded(raw: Column) -> Column:
    """Bytes as UTF-8 text without those that are no valid UTF-8; '' for null."""
    # what replaces an invalid byte goes; the same character in valid bytes is written as `escape 1` meanwhile, the escape as `escape 0`
    mark, escape = "\ufffd", "\ue000"
    out = raw.cast("string")
    for a, b in ((escape, f"{escape}0"), (mark, f"{escape}1")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.replace(F.make_valid_utf8(out), F.lit(mark), F.lit(""))
    for a, b in ((f"{escape}1", mark), (f"{escape}0", escape)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return text_of(out)


def overlay(payload: Column) -> Column:
    """The start of a code's text that is drawn over its crop."""
    return F.substring(text_of(payload), 1, 20)


def frame_name(ms: Column, sharpness: Column | None = None) -> Column:
    """File name of a frame; a best frame's tells its sharpness, halves rounded to even."""
    if sharpness is None:
        return F.format_string("frame_%06d.png", ms)
    return F.format_string("frame_%06d_quality=%d.png", ms, F.rint(sharpness).cast("long"))


def crop_path(folder: str | Column, ms: Column, place: Column, has_image: Column) -> Column:
    """Path of a tag's crop by its frame's milliseconds and its place in the frame; '' without an image."""
    own = F.lit(folder.rstrip("/")) if isinstance(folder, str) else folder
    return F.when(has_image, F.concat(own, F.format_string("/warped_%d_%d.png", ms, place))).otherwise("")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(text_of(path), "/"), -1)


def placeholder(value: Column) -> Column:
    return F.coalesce(F.nullif(text_of(value), F.lit("")), F.lit("-"))


def data_uri(blob: Column, kind: str = "image/png") -> Column:
    """A data URI in one line; '' without a blob."""
    return F.coalesce(F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(blob), r"\s", "")), F.lit(""))


def escape_html(value: Column) -> Column:
    out = text_of(value)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
