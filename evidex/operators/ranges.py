"""Range joins over a closed ordinal scale, and cuts of ordered positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.operators.ordered import attach, ordered_scan, top_per_key
from evidex.session import spread
from evidex.vocabulary import HIGHEST_ORDINAL, LOWEST_ORDINAL


def _levels(df: DataFrame, bits: int) -> DataFrame:
    return df.select("*", F.explode(F.array(*[F.lit(k) for k in range(bits + 1)])).alias("level"), (F.lit(1 << (bits + 1)).cast("long")).alias("width"))


def _nodes(df: DataFrame, key: str, bits: int) -> DataFrame:
    """(key, node): the nodes of a binary tree over 0 .. 2^bits - 1 that make up ``lo`` to ``hi``: at most two a level, as ``level * 2^(bits + 1) + number``."""
    left, right = "shiftright(lo + shiftleft(1L, level) - 1, level)", "shiftright(hi + 1, level)"
    ends = [F.expr(f"case when {left} < {right} and {test} % 2 = 1 then level * width + {node} end") for test, node in ((left, left), (right, f"{right} - 1"))]
    return _levels(df.filter("lo <= hi"), bits).select(key, F.explode(F.array(*ends)).alias("node")).filter("node is not null")


def _above(df: DataFrame, key: str, bits: int) -> DataFrame:
    """(key, node): the nodes over the point ``lo``."""
    return _levels(df, bits).select(key, F.expr("level * width + shiftright(lo, level)").alias("node"))


def overlapping(wants: DataFrame, items: DataFrame, want_id: str, item_id: str, lowest: int = LOWEST_ORDINAL, highest: int = HIGHEST_ORDINAL,
                totals: Mapping[str, str] | None = None) -> DataFrame:
    """(want, item) whose [lo, hi] ranges meet on a scale of whole numbers; unknown ends reach the scale's ends.

    A range is at most two nodes a level of a binary tree over the scale, a point stands under one node a level. Two ranges meet
    if the start of one lies in the other: an item's start in the want, or a want's start in the item behind the item's
    own; so each pair is found at one node, on any scale, by equality.

    With ``totals`` (name: ``count``, ``sum``, ``min`` or ``max`` of the items' ids) there is one row per want that meets an item, and no
    pair is made: as a pair is found at one node, the items of a node are one row before wants come to it.

    Nodes are many more than the rows they are made of, which the planner's sizes do not know, so neither side is ever sent to the driver.
    """
    bits = max(1, (highest - lowest).bit_length())

    def placed(df: DataFrame, key: str) -> DataFrame:
        lo = F.greatest(F.coalesce("lo", F.lit(lowest)), F.lit(lowest)).cast("long") - F.lit(lowest).cast("long")
        hi = F.least(F.coalesce("hi", F.lit(highest)), F.lit(highest)).cast("long") - F.lit(lowest).cast("long")
        return df.select(key, lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")

    asked, filed = spread(placed(wants, want_id), want_id), placed(items, item_id)
    behind = filed.withColumn("lo", F.col("lo") + 1)
    nodes = [(_nodes(asked, want_id, bits), _above(filed, item_id, bits)), (_above(asked, want_id, bits), _nodes(behind, item_id, bits))]
    if totals is None:
        return reduce(DataFrame.unionByName, [w.hint("merge").join(i, "node") for w, i in nodes]).select(want_id, item_id)
    first = [_TOTALS[kind][0](item_id).alias(name) for name, kind in totals.items()]
    again = [_TOTALS[kind][1](name).alias(name) for name, kind in totals.items()]
    met = [w.hint("merge").join(i.groupBy("node").agg(*first), "node") for w, i in nodes]
    return reduce(DataFrame.unionByName, met).groupBy(want_id).agg(*again)


#: How a total is made of rows, and of totals.
_TOTALS = {"count": (lambda _: F.count(F.lit(1)), F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def runs(cells: DataFrame, key: str, cell: str, slice_cells: int = 4096) -> DataFrame:
    """Maximal runs of consecutive cells: (key, first, last, length), ``length`` a long.

    Cells are numbered inside slices of the scale, so no window holds a key. A run that touches neither end of its slice is
    whole; of the others, at most two a slice, those that continue one another are joined by a running count of breaks.
    """
    place = F.floor(F.col(cell) / slice_cells)
    numbered = cells.select(key, cell).distinct().withColumn("__slice", place)
    run = F.col(cell) - F.row_number().over(Window.partitionBy(key, "__slice").orderBy(cell))
    found = numbered.withColumn("__run", run).groupBy(key, "__slice", "__run").agg(F.min(cell).alias("first"), F.max(cell).alias("last"))
    edge = (F.col("first") == F.col("__slice") * slice_cells) | (F.col("last") == (F.col("__slice") + 1) * slice_cells - 1)
    order = Window.partitionBy(key).orderBy("first")
    edges = found.filter(edge).withColumn("__new", F.coalesce(F.lag("last").over(order) + 1 != F.col("first"), F.lit(True)).cast("long"))
    joined = edges.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    whole = found.filter(~edge).select(key, "first", "last").unionByName(joined.select(key, "first", "last"))
    return whole.withColumn("length", (F.col("last") - F.col("first") + 1).cast("long"))


def longest_run(found: DataFrame, key: str) -> DataFrame:
    """The longest run of each key (the first of equals)."""
    best = F.max_by(F.struct("first", "last", "length"), F.struct(F.col("length"), -F.col("first")))
    return found.groupBy(key).agg(best.alias("r")).select(key, "r.*")


def cut_at_widest_gaps(positions: DataFrame, keys: Sequence[str], position: str, floor: int, slice_by: Column, cuts: int = 2) -> DataFrame:
    """Split each key's positions at its ``cuts`` widest gaps over ``floor``, or leave one block.

    Equal gaps: the later one first. The gaps come from a sliced scan, the widest of a key from a
    bounded top list, and block numbers from comparing a row with at most ``cuts`` numbers.
    """
    distinct = positions.select(*keys, position).distinct()
    spaced = ordered_scan(distinct, keys, [position], slice_by, {"__next": ("lead", position)})
    wide = spaced.withColumn("__gap", F.col("__next") - F.col(position)).filter(F.col("__gap") > floor)
    top = top_per_key(wide, keys, [F.desc("__gap"), F.desc(position)], cuts, "__rn")
    per_key = (top.groupBy(*keys).agg(F.array_sort(F.collect_list(position)).alias("__cuts"))
               .filter(F.size("__cuts") == cuts))
    rows = attach(distinct, per_key, keys, slice_by)
    block = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col(position))), F.lit(0))
    return (rows.withColumn("block", F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(block))
            .groupBy(*keys, "block").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n")))


def split_or_refuse(blocks: DataFrame, key: str, parts: int = 3, agreement: float = 0.25, min_share: float = 0.04) -> DataFrame:
    """Every group gives ``parts`` boxes or one reason, never something in between.

    ``blocks`` holds (key, first, last) runs. Runs narrower than ``min_share`` of the group's span do
    not count; the counted ones must agree on width.
    """
    span = blocks.groupBy(key).agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    wide = (blocks.join(span, key).withColumn("width", F.col("last") - F.col("first") + 1)
            .withColumn("counted", F.col("width") > (F.col("hi") - F.col("lo") + 1) * min_share))
    per_key = wide.groupBy(key, "lo", "hi").agg(
        F.count_if("counted").alias("n"), F.max(F.when(F.col("counted"), F.col("width"))).alias("widest"),
        F.min(F.when(F.col("counted"), F.col("width"))).alias("narrowest"))
    reason = (F.when(F.col("n") != parts, F.concat(F.lit(f"expected {parts} parts, found "), F.col("n").cast("string")))
              .when(F.col("widest") - F.col("narrowest") > agreement * F.col("widest"), "parts disagree on width"))
    third = F.sequence(F.lit(0), F.lit(parts - 1))
    width = F.col("hi") - F.col("lo") + 1
    boxes = F.transform(third, lambda i: F.struct(
        (F.col("lo") + F.floor(i * width / parts)).cast("bigint").alias("left"),
        (F.col("lo") + F.floor((i + 1) * width / parts)).cast("bigint").alias("right")))
    out = per_key.withColumn("reason", reason)
    return out.select(key, F.col("reason").isNull().alias("ok"), "reason", F.when(F.col("reason").isNull(), boxes).alias("boxes"))
