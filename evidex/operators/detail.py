"""Detail pages: every evidence row of the items that are asked for, with its labels, in display order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidex import vocabulary as V
from evidex.operators.evidence import role_priority
from evidex.operators.filters import exact_lookup
from evidex.operators.ordered import SLICE

_S, _I = T.StringType(), T.IntegerType()
BOX = T.StructType([T.StructField(side, _I) for side in ("left", "top", "right", "bottom")])
#: Frozen output: names, types and order are part of the contract.
DETAIL_ROW = T.StructType([T.StructField(name, kind) for name, kind in (
    ("ev_id", _S), ("source_url", _S), ("storage_path", _S), ("role", _S), ("cone", _S), ("coat_name", _S), ("coat", _I), ("clay_name", _S),
    ("clay_family", _S), ("form", _S), ("base_code", _S), ("base_name", _S), ("hex", _S), ("hex2", _S), ("confidence", _S), ("credit", _S),
    ("crop_box", BOX), ("image_width", _I), ("image_height", _I))])


@dataclass(frozen=True)
class DetailTables:
    """``evidence`` has the columns of ``DETAIL_ROW`` with ``cone_no``, ``clay`` and ``layered_over`` for their labels; ``clays`` (clay, clay_name, clay_family)."""

    items: DataFrame
    makers: DataFrame
    evidence: DataFrame
    clays: DataFrame


def detail_rows(t: DetailTables, refs: DataFrame) -> DataFrame:
    """(ref_id, item_id, place, the columns of ``DETAIL_ROW``): thin coats first, then by role, then by evidence id.

    ``refs`` has (ref_id, maker, code) as people write them. An item is listed once however many references name it and its rows are handed to
    each. A place is a number within the item: rows are counted inside slices of the order (coat, role), so an item with most of the
    evidence is not one task. Whole rows move once, to the slices, and besides only where they name a clay or a base.
    """
    spark = t.items.sparkSession
    asked = exact_lookup(t.items, t.makers, refs).select("ref_id", "item_id")
    base = t.items.select(F.col("item_id").alias("layered_over"), F.col("code").alias("base_code"), F.col("name").alias("base_name"))
    named = _labelled(_labelled(t.evidence.drop("base_code").filter("item_id is not null"), t.clays.select("clay", "clay_name", "clay_family"), "clay"), base, "layered_over")
    rows = named.withColumn(SLICE, F.coalesce("coat", F.lit(9)) * 10 + role_priority(F.col("role"), V.DETAIL_PRIORITY))
    slices = rows.groupBy("item_id", SLICE).agg(F.count(F.lit(1)).alias("__n"))
    ahead = F.sum("__n").over(Window.partitionBy("item_id").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1))
    wanted = asked.join(slices.select("item_id", SLICE, F.coalesce(ahead, F.lit(0)).alias("__ahead")), "item_id")
    inside = Window.partitionBy("item_id", SLICE).orderBy("ev_id", "source_url", "storage_path")
    here = rows.join(wanted.select("item_id", SLICE).distinct(), ["item_id", SLICE], "left_semi").withColumn("__nth", F.row_number().over(inside))
    placed = here.join(wanted, ["item_id", SLICE]).withColumn("place", F.col("__ahead") + F.col("__nth"))
    shown = placed.join(V.coats(spark).select("coat", "coat_name"), "coat", "left").join(V.cones(spark).withColumnRenamed("ordinal", "cone_no"), "cone_no", "left")
    return shown.select("ref_id", "item_id", F.col("place").cast("long").alias("place"), *[F.col(f.name).cast(f.dataType).alias(f.name) for f in DETAIL_ROW])


def _labelled(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """``rows`` with their labels, if any; only rows that have a key are moved to them."""
    keyed = rows.filter(F.col(key).isNotNull()).join(labels, key, "left")
    return keyed.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def lookup_page(items: DataFrame, makers: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_id, item_id, tier, rank): exact look-ups as a page, for the hit projection that searches have."""
    return exact_lookup(items, makers, refs).select("ref_id", "item_id", F.lit("match").alias("tier"), F.lit(1.0).alias("rank"))


def similar_page(similar: DataFrame) -> DataFrame:
    """(anchor_id, position, item_id, tier, rank): similar items as a page; the rank is the score."""
    return similar.select("anchor_id", "position", "item_id", F.lit("near").alias("tier"), F.col("score").cast("double").alias("rank"))
