"""Inclusive ordinal ranges with open or unknown ends."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from evidex.vocabulary import HIGHEST_ORDINAL, LOWEST_ORDINAL, OPEN_END


def overlaps(lo: Column, hi: Column, want_lo: Column, want_hi: Column) -> Column:
    """Does ``[lo, hi]`` meet ``[want_lo, want_hi]``? No bound asked for means yes."""
    low, high = F.lit(LOWEST_ORDINAL), F.lit(OPEN_END)
    return (want_lo.isNull() & want_hi.isNull()) | (
        (F.coalesce(lo, low) <= F.coalesce(want_hi, high))
        & (F.coalesce(hi, high) >= F.coalesce(want_lo, low)))


def ordinals(lo: Column, hi: Column) -> Column:
    """Every ordinal of the closed scale a range covers; unknown ends reach the scale's ends."""
    first = F.greatest(F.coalesce(lo, F.lit(LOWEST_ORDINAL)), F.lit(LOWEST_ORDINAL))
    last = F.least(F.coalesce(hi, F.lit(HIGHEST_ORDINAL)), F.lit(HIGHEST_ORDINAL))
    return F.when(first <= last, F.sequence(first, last))


def register_sql(spark: SparkSession) -> None:
    """The same predicate (and the array-to-text helper) for SQL users."""
    spark.sql(f"""
        create or replace temporary function range_overlaps(lo int, hi int, want_lo int, want_hi int)
        returns boolean return (want_lo is null and want_hi is null)
          or (coalesce(lo, {LOWEST_ORDINAL}) <= coalesce(want_hi, {OPEN_END})
              and coalesce(hi, {OPEN_END}) >= coalesce(want_lo, {LOWEST_ORDINAL}))""")
    spark.sql("""create or replace temporary function words_text(words array<string>)
        returns string return array_join(words, ' ')""")
