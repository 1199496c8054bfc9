"""Item codes: two sources spell them by two rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: line prefixes of the first source and what they stand for ---------------------
LINE_NAMES = {
    "PC": "Potter's Choice", "PCF": "Potter's Choice Flux", "C": "Celadon", "SM": "Satin Matte", "HF": "High Fire", "SH": "Shino",
    "PG": "Phase Glaze", "CO": "Cosmos", "CR": "Crawls", "DL": "Dipping & Layering", "KI": "Kiln Ice", "LG": "Low Fire Gloss",
    "LM": "Low Fire Matte", "O": "Opalescent", "V": "Velvet Underglaze", "UG": "Underglaze", "LUG": "Liquid Underglaze",
    "TP": "Teacher's Palette", "TPL": "Teacher's Palette Lustre", "F": "Fundamentals",
}
LINE_PREFIXES = list(LINE_NAMES)
# --- fixed value: how a stock number of the second source opens -----------------------------------
STOCK_NUMBER = r"^([A-Za-z]+)-?(\d+)"


def longest_first(words: list[str]) -> str:
    """An alternation that never lets a short word shadow a longer one it begins."""
    return "|".join(sorted((w.lower() for w in words), key=lambda w: (-len(w), w)))


def zero_stripped(prefix: Column, digits: Column) -> Column:
    """A code in the first source's form: capital prefix, dash, number as a number."""
    return F.concat(F.upper(prefix), F.lit("-"), digits.try_cast("bigint").cast("string"))


def zero_kept(prefix: Column, digits: Column) -> Column:
    """A code in the second source's form: capital prefix, dash, digits as they stand."""
    return F.concat(F.upper(prefix), F.lit("-"), digits)


def sku_code(sku: Column) -> Column:
    """The code a stock number opens with; one of another form is kept whole, in capitals."""
    text = F.trim(sku)
    prefix, digits = (F.regexp_extract(text, STOCK_NUMBER, k) for k in (1, 2))
    return F.when(prefix != "", zero_kept(prefix, digits)).otherwise(F.upper(text))


def name_code(name: Column) -> Column:
    """The code a title of the first source opens with (``c-05 charcoal`` -> ``C-5``), else null."""
    pattern = rf"(?i)^\s*({longest_first(LINE_PREFIXES)})[-_ ]?(\d{{1,3}})\b"
    prefix = F.regexp_extract(name, pattern, 1)
    return F.when(prefix != "", zero_stripped(prefix, F.regexp_extract(name, pattern, 2)))


def has_code_shape(slug: Column) -> Column:
    """Does a slug open with a known prefix and a number?"""
    return F.lower(F.trim(slug, F.lit("/"))).rlike(rf"^({longest_first(LINE_PREFIXES)})-\d{{1,3}}(-|$)")


def fold(col: Column) -> Column:
    """Case- and edge-blank-insensitive key."""
    return F.lower(F.trim(col))
