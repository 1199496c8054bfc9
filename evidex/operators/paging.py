"""Paging over a total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.ordered import placed

#: (tier, rank desc, code, id): the id makes it total.
PAGE_ORDER = ("tier", "rank_desc", "code", "item_id")


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page of one result; negative bounds count as zero."""
    ordered = rows.orderBy("tier", F.desc("rank"), "code", "item_id")
    return ordered.offset(max(offset, 0)).limit(max(limit, 0))


def page_index(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int) -> DataFrame:
    """Number every row of every result and say which page it is on and whether another page follows."""
    numbered = placed(rows, keys, order, "position", "__total")
    page_no = F.floor((F.col("position") - 1) / size)
    return (numbered.withColumn("page_no", page_no)
            .withColumn("has_more", F.col("__total") > (F.col("page_no") + 1) * size)
            .withColumn("next_offset", F.least(F.col("__total"), (F.col("page_no") + 1) * size))
            .drop("__total"))


def after(tier: str, rank: float, code: str, item_id: int) -> Column:
    """Rows after a given one in the page order; directions differ, so it is spelled out."""
    t, r, c, i = F.col("tier"), F.col("rank"), F.col("code"), F.col("item_id")
    return ((t > tier)
            | ((t == tier) & ((r < rank)
               | ((r == rank) & ((c > code) | ((c == code) & (i > item_id)))))))


def keyset_page(rows: DataFrame, limit: int, last: tuple[str, float, str, int] | None = None) -> DataFrame:
    """The page after ``last``; unlike an offset it never reads what it skips."""
    if last is not None:
        rows = rows.filter(after(*last))
    return rows.orderBy("tier", F.desc("rank"), "code", "item_id").limit(max(limit, 0))


def merge_pages(pages: DataFrame) -> DataFrame:
    """First occurrence of an id over fetched pages (result, page_no, tier, position, item_id).

    An aggregate per (result, id), so no result is gathered in one task.
    """
    return pages.groupBy("result", "item_id").agg(
        F.min(F.struct("page_no", "tier", "position")).alias("first")
    ).select("result", "item_id", "first.page_no", "first.tier", "first.position")


def additions(pages: DataFrame, merged: DataFrame) -> DataFrame:
    """New ids per fetched page and whether to go on: a full page that adds nothing ends the list."""
    per_page = pages.groupBy("result", "page_no").agg(F.max("has_more").alias("__more"))
    added = merged.groupBy("result", "page_no").agg(F.count(F.lit(1)).alias("added"))
    return (per_page.join(added, ["result", "page_no"], "left")
            .select("result", "page_no", F.coalesce("added", F.lit(0).cast("bigint")).alias("added"),
                    (F.col("__more") & (F.coalesce("added", F.lit(0)) > 0)).alias("go_on")))
