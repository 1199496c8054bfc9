"""Set comparisons between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows on one side only, labelled ``missing`` (expected only) or ``unexpected``.

    One aggregate over both sides instead of two exceptAll joins: each row is shuffled once, and
    repeats are counted map-side.
    """
    columns = expected.columns
    both = expected.select(*columns, F.lit(1).alias("__d")).unionByName(actual.select(*columns, F.lit(-1).alias("__d")))
    net = both.groupBy(*columns).agg(F.sum("__d").alias("__net")).filter("__net <> 0")
    return net.select(*columns, F.when(F.col("__net") > 0, "missing").otherwise("unexpected").alias("side"), F.abs("__net").alias("copies"))


def drift(left: DataFrame, right: DataFrame, keys: Sequence[str], left_label: str, right_label: str) -> DataFrame:
    """Keys known to one ledger only."""
    both = left.select(*keys, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select(*keys, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    seen = both.groupBy(*keys).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r")).filter("__l <> __r")
    return seen.select(*keys, F.when(F.col("__l") == 1, left_label).otherwise(right_label).alias("side"))


def missing_keys(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Wanted objects that are not stored yet: one set difference, not one look-up per object."""
    return wanted.join(stored.select(key), key, "left_anti")


def orphan_keys(stored: DataFrame, cited: DataFrame, key: str) -> DataFrame:
    """Stored objects nothing cites. Both sides must be read from the same state of the catalog."""
    return stored.join(cited.filter(F.col(key).isNotNull()).select(key), key, "left_anti")
