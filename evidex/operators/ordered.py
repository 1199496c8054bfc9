"""Ordered scans (lag, lead, running values, numbering) that survive a hot key.

A plain window pulls all rows of one key into one task. Here a key's rows are cut into *slices* by
a coarse, monotone function of the order (an hour, a day, a block of positions), so the row-level
window is partitioned by (key, slice). One summary row per slice is scanned by a second, small
window that carries values across slice borders, and is joined back on (key, slice). Rows are
shuffled once; a key with a third of all rows is spread over as many tasks as it has slices.
Slices are computed from values, so a lost executor recomputes exactly the same ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.session import stored

SLICE = "__slice"


def time_slice(micros: str, seconds: int = 86_400) -> Column:
    return F.floor(F.col(micros) / (seconds * 1_000_000))


def _summaries(df: DataFrame, keys: Sequence[str], order: Sequence[str], want: Mapping[str, tuple[str, str]]) -> DataFrame:
    position = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for out, (kind, col) in want.items():
        c = F.col(col) if col else None
        name = f"__s_{out}"
        if kind == "lag":
            aggs.append(F.max_by(F.struct(c.alias("v")), position).alias(name))
        elif kind == "lead":
            aggs.append(F.min_by(F.struct(c.alias("v")), position).alias(name))
        elif kind in ("running_last", "prior_last"):
            aggs.append(F.max_by(c, F.when(c.isNotNull(), position)).alias(name))
        elif kind in ("running_sum", "total_sum"):
            aggs.append(F.sum(c).alias(name))
        elif kind in ("running_max", "total_max", "prior_max"):
            aggs.append(F.max(c).alias(name))
        elif kind == "total_min":
            aggs.append(F.min(c).alias(name))
    return df.groupBy(*keys, SLICE).agg(*aggs)


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column,
                 want: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add columns ``out: (kind, column)`` to every row.

    Kinds: ``row_number``, ``lag``, ``lead``, ``running_last`` (last non-null up to this row), ``prior_last`` (before it),
    ``running_sum``, ``running_max`` (this row included), ``prior_max`` (this row excluded),
    ``total_sum``, ``total_max``, ``total_min`` (whole key). ``order`` is ascending and must be a
    total order within a key; ``slice_by`` must never decrease along it.
    """
    rows = df.withColumn(SLICE, slice_by)
    summary = _summaries(rows, keys, order, want)
    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carries = []
    for out, (kind, _) in want.items():
        s, name = F.col(f"__s_{out}"), f"__c_{out}"
        carry = {
            "row_number": lambda: F.sum("__n").over(before),
            "lag": lambda: F.lag(s).over(by_slice),
            "lead": lambda: F.lead(s).over(by_slice),
            "running_last": lambda: F.last(s, ignorenulls=True).over(before),
            "prior_last": lambda: F.last(s, ignorenulls=True).over(before),
            "running_sum": lambda: F.sum(s).over(before),
            "running_max": lambda: F.max(s).over(before),
            "prior_max": lambda: F.max(s).over(before),
            "total_sum": lambda: F.sum(s).over(whole),
            "total_max": lambda: F.max(s).over(whole),
            "total_min": lambda: F.min(s).over(whole),
        }[kind]() if kind != "row_number" else F.sum("__n").over(before)
        carries.append(carry.alias(name))
    carried = summary.select(*keys, SLICE, *carries)

    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = []
    for out, (kind, col) in want.items():
        name = f"__l_{out}"
        if kind == "row_number":
            local.append(F.row_number().over(inside).alias(name))
        elif kind == "lag":
            local.append(F.lag(F.struct(F.col(col).alias("v"))).over(inside).alias(name))
        elif kind == "lead":
            local.append(F.lead(F.struct(F.col(col).alias("v"))).over(inside).alias(name))
        elif kind == "running_last":
            local.append(F.last(col, ignorenulls=True).over(upto).alias(name))
        elif kind == "prior_last":
            local.append(F.last(col, ignorenulls=True).over(earlier).alias(name))
        elif kind == "running_sum":
            local.append(F.sum(col).over(upto).alias(name))
        elif kind == "running_max":
            local.append(F.max(col).over(upto).alias(name))
        elif kind == "prior_max":
            local.append(F.max(col).over(earlier).alias(name))
    if local:
        rows = rows.select("*", *local)
    joined = rows.join(carried, [*keys, SLICE])
    outs = []
    for out, (kind, _) in want.items():
        mine, carry = F.col(f"__l_{out}"), F.col(f"__c_{out}")
        if kind == "row_number":
            value = mine + F.coalesce(carry, F.lit(0))
        elif kind in ("lag", "lead"):
            value = F.coalesce(mine, carry)["v"]
        elif kind in ("running_last", "prior_last"):
            value = F.coalesce(mine, carry)
        elif kind == "running_sum":
            value = F.when(mine.isNull(), carry).otherwise(mine + F.coalesce(carry, F.lit(0)))
        elif kind in ("running_max", "prior_max"):
            value = F.greatest(mine, carry)
        else:
            value = carry
        outs.append(value.alias(out))
    return joined.select(*df.columns, *outs)


def attach(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], slice_by: Column, how: str = "left") -> DataFrame:
    """Join one row per key onto many rows of a key without sending the key to one task.

    The per-key rows are first spread over the slices that exist, then joined on (key, slice).
    """
    cut = rows.withColumn(SLICE, slice_by)
    slices = cut.select(*keys, SLICE).distinct()
    return cut.join(slices.join(per_key, list(keys)), [*keys, SLICE], how).drop(SLICE)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, number: str = "rn") -> DataFrame:
    """The first ``k`` rows per key in a total order.

    The limit on the row number is pushed below the shuffle, so a task ships at most ``k`` rows of
    a key however hot it is.
    """
    return (df.withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
              .filter(F.col(number) <= k))


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], number: str = "position", total: str = "total") -> DataFrame:
    """Number the rows of every key in a total order, and say how many the key has.

    Rows are dealt to ranges of (keys, order) that are cut by the data itself and stored; where a range starts within a key is a sum over
    the ranges before it. So a key with most of the rows is as many ranges as it needs, whatever its values look like.
    """
    ranged = stored(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    by_part = Window.partitionBy(*keys).orderBy("__part")
    sizes = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n")).select(
        *keys, "__part", F.coalesce(F.sum("__n").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"), F.sum("__n").over(Window.partitionBy(*keys)).alias(total))
    inside = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    return ranged.withColumn("__nth", inside).join(sizes, [*keys, "__part"]).select(*df.columns, (F.col("__nth") + F.col("__ahead")).alias(number), total)
