"""Fingerprints of item descriptions by winnowing, in column expressions only.

A run of up to eight characters without blanks is one piece; a longer one gives a piece of eight characters at every
position, so pieces do not depend on where a run starts. Every four pieces in a row give one
rolling hash; of every eight hashes in a row the least is kept, the rightmost of equal ones, with its
position. Two texts that share eleven pieces in a row (18 characters inside runs without blanks) therefore share a fingerprint,
whatever is around them, and its positions say where. A text of fewer than eight hashes keeps its least one.

A text of up to 64 characters, its blanks run together, keeps besides the hash of its four characters at every
position (of all of them, if fewer), so that short texts are compared by what they share too. Positions of these are characters.

Hash and position are packed into one number (32 and 31 bits), so a window's choice is a plain
minimum, found by doubling: three passes over the array. Steps are sealed from each other, so that no array is computed twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.seal import seal

_LAST = (1 << 31) - 1
#: At every character: the short run that starts there, else eight characters of a longer run.
_PIECE = r"(?=((?<!\S)\S{1,8}(?!\S)|\S{8}))\S"
_SHORT, _GRAM = 64, 4


def _later(name: str, by: int) -> Column:
    return F.slice(F.col(name), by + 1, F.greatest(F.size(name) - by, F.lit(0)))


def _paired(name: str, by: int, join) -> Column:
    """``join`` of every element and the one ``by`` places on, where there is one."""
    return F.zip_with(F.slice(F.col(name), 1, F.greatest(F.size(name) - by, F.lit(0))), _later(name, by), join)


def fingerprints(items: DataFrame, text: str = "description", prints: str = "prints") -> DataFrame:
    """All columns of ``items`` and ``prints``: the kept hashes of ``text``, packed with positions, in order.

    A null, empty or blank text has an empty array. Equal texts have equal arrays, so repeated rows do too.
    Columns named ``prints`` or ``__w...`` are replaced.
    """
    def step(df: DataFrame, value: Column) -> DataFrame:
        return seal(df.withColumn("__w", value), "__w")

    low = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    packed = lambda h, i: F.shiftleft(low(h), 31).bitwiseOR(F.lit(_LAST).cast("long") - i)
    none = F.expr("cast(array() as array<bigint>)")
    whole = F.coalesce(F.col(text), F.lit(""))
    df = seal(items.withColumn("__wall", F.regexp_replace(F.regexp_replace(whole, r"\s+", " "), "^ | $", "")), "__wall")
    n = F.char_length("__wall")
    starts = F.sequence(F.lit(0), F.greatest(n - _GRAM, F.lit(0)))
    chars = F.transform(starts, lambda i: packed(F.xxhash64(F.substring(F.col("__wall"), i + 1, F.lit(_GRAM))), i))
    df = seal(df.withColumn("__wall", F.when((n > 0) & (n <= _SHORT), chars).otherwise(none)), "__wall")
    pieces = F.regexp_extract_all(whole, F.lit(_PIECE), 1)
    df = step(df, F.transform(pieces, lambda p: F.xxhash64(p)))
    df = step(df, _paired("__w", 1, lambda a, b: F.xxhash64(a, b)))
    df = step(df, _paired("__w", 2, lambda a, b: F.xxhash64(a, b)))
    df = step(df, F.transform("__w", packed))
    df = seal(df.withColumn("__wmin", F.array_min("__w")).withColumn("__wn", F.size("__w")), "__wmin", "__wn")
    for by in (1, 2, 4):
        df = step(df, _paired("__w", by, lambda a, b: F.least(a, b)))
    kept = F.when(F.col("__wn") >= 8, F.array_distinct("__w")).when(F.col("__wn") > 0, F.array("__wmin")).otherwise(none)
    return df.withColumn(prints, F.concat(kept, "__wall")).drop("__w", "__wall", "__wmin", "__wn")


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: F.shiftright(p, 31)))


def as_text(prints: Column) -> Column:
    """``hash@position`` of every print, eight hexadecimal digits and a decimal, joined by a blank."""
    return F.array_join(F.transform(prints, lambda p: F.concat(F.lower(F.lpad(F.hex(F.shiftright(p, 31)), 8, "0")), F.lit("@"), (F.lit(_LAST) - p.bitwiseAND(F.lit(_LAST))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Shared over united distinct hashes of two fingerprints; 1 when both are empty."""
    shared = F.size(F.array_intersect(hashes(a), hashes(b)))
    united = F.size(hashes(a)) + F.size(hashes(b)) - shared
    return F.when(united > 0, shared / united).otherwise(F.lit(1.0))
