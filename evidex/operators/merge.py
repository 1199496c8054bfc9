"""Keyed merges as pure DataFrame functions, and the sink that swaps a merged table in.

Parquet tables know no MERGE. A merge is one aggregate over the union of both sides, keyed like the
table: each row is shuffled once, duplicates in the batch settle in the same pass, and running a
batch twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a column behaves when the key exists on both sides.
TAKE_NEW, KEEP_OLD, COALESCE, GREATEST = "take_new", "keep_old", "coalesce", "greatest"


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], policy: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """Merge ``incoming`` into ``existing`` by ``keys``; both have the same columns.

    ``policy`` names every other column: ``take_new`` overwrites (null included), ``keep_old`` is
    written on insert only, ``coalesce`` overwrites unless the new value is null, ``greatest`` keeps the
    larger. Of several incoming rows with one key the last in ``order`` counts.
    """
    columns = [*keys, *policy]
    old = existing.select(*columns, F.lit(0).alias("__side"), *[F.lit(None).cast(incoming.schema[o].dataType).alias(f"__o_{i}") for i, o in enumerate(order)])
    new = incoming.select(*columns, F.lit(1).alias("__side"), *[F.col(o).alias(f"__o_{i}") for i, o in enumerate(order)])
    recency = [F.col(f"__o_{i}") for i in range(len(order))]
    # The row itself ends the order, so equal positions still pick one row for good.
    place = F.struct("__side", *recency, F.to_json(F.struct(*policy)))
    both = old.unionByName(new).withColumn("__place", place)
    latest = both.groupBy(*keys).agg(
        F.max_by(F.struct(*policy), F.when(F.col("__side") == 0, F.col("__place"))).alias("o"),
        F.max_by(F.struct(*policy), F.when(F.col("__side") == 1, F.col("__place"))).alias("n"))
    fresh, held = F.col("n").isNotNull(), F.col("o").isNotNull()
    rules = {
        TAKE_NEW: lambda c: F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")),
        KEEP_OLD: lambda c: F.when(held, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")),
        COALESCE: lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")),
        GREATEST: lambda c: F.greatest(F.col(f"n.{c}"), F.col(f"o.{c}")),
    }
    return latest.select(*keys, *[rules[rule](c).alias(c) for c, rule in policy.items()]).select(*existing.columns)


#: Items: identity and first sight stay, statements of the source replace one another.
ITEM_POLICY = {
    "name": TAKE_NEW, "line": TAKE_NEW, "description": TAKE_NEW, "surface": TAKE_NEW, "opacity": TAKE_NEW, "price": TAKE_NEW,
    "slug": KEEP_OLD, "first_seen_s": KEEP_OLD, "last_seen_s": GREATEST,
}
#: Lines: a range, once stated, is not lost to a batch that states none.
LINE_POLICY = {"name": TAKE_NEW, "line_lo": COALESCE, "line_hi": COALESCE}


def upsert_issues(queue: DataFrame, found: DataFrame) -> DataFrame:
    """Refresh the open issue of (maker, kind, subject) or open one; resolved rows neither change nor block."""
    keys = ["maker_id", "kind", "subject"]
    done = queue.filter("resolved_s is not null")
    open_rows = queue.filter("resolved_s is null")
    merged = upsert(open_rows, found.withColumn("resolved_s", F.lit(None).cast("bigint")).select(*queue.columns), keys,
                    {"opened_s": KEEP_OLD, "seen_s": GREATEST, "detail": TAKE_NEW, "resolved_s": KEEP_OLD}, ["seen_s"])
    return done.unionByName(merged)


def inherit_range(items: DataFrame, lines: DataFrame) -> DataFrame:
    """Items without a range take their line's, and say so. A range once filled is never refreshed."""
    stated = lines.filter("line_lo is not null").select("line", "line_lo", "line_hi")
    joined = items.join(stated, "line", "left")
    take = F.col("lo").isNull() & F.col("line_lo").isNotNull()
    return joined.select(*[c for c in items.columns if c not in ("lo", "hi", "range_source")],
                         F.when(take, F.col("line_lo")).otherwise(F.col("lo")).alias("lo"),
                         F.when(take, F.col("line_hi")).otherwise(F.col("hi")).alias("hi"),
                         F.when(take, "line").otherwise(F.col("range_source") if "range_source" in items.columns else F.when(F.col("lo").isNotNull(), "product").otherwise("unknown")).alias("range_source"))


def publish(merged: DataFrame, root: str) -> DataFrame:
    """Write a merged table as the next version below ``root`` and return it as readers see it from then on.

    A version is a folder of its own and counts once it is named in ``root/finished``, after its writer has ended; one that failed is passed
    over and its number used again. The version before stays for those who read it.
    """
    spark = merged.sparkSession
    number = _newest(spark, root) + 1
    merged.write.mode("overwrite").parquet(f"{root}/version={number}")
    spark.range(number, number + 1).toDF("number").coalesce(1).write.mode("append").parquet(f"{root}/finished")
    return current(spark, root)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest finished version below ``root``."""
    return spark.read.parquet(f"{root}/version={_newest(spark, root)}")


def _newest(spark: SparkSession, root: str) -> int:
    try:
        return spark.read.schema("number long").parquet(f"{root}/finished").agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0]
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of a run by outcome, one row per source."""
    return outcomes.groupBy("maker_id").agg(
        *[F.count_if(F.col("outcome") == name).alias(name) for name in ("stored", "unchanged", "gone", "failed")])
