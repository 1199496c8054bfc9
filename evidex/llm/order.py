"""Neighbours in a global order without a global sort in one task.

Rows are cut into slices at boundary keys. A boundary is a key that exists, so the first row of a slice is
known by its key alone and is copied into the slice before; then the row after every row stands in its
own slice, and one window per slice finds it. Rows are shuffled once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled keys per slice, and slices per shuffle partition (more than one evens out the partitions).
_OVERSAMPLE, _SLICES = 16, 4


def boundaries(rows: DataFrame, key: str) -> list:
    """About evenly spread keys, ascending: every 16th of a sample of distinct keys. What reaches the driver follows the
    number of shuffle partitions, neither the rows nor the tasks that read them: of the keys one in so many is taken, by hash."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * _SLICES * _OVERSAMPLE
    keys = rows.select(key).filter(F.col(key).isNotNull())
    one_in = max(1, keys.count() // n)
    sample = keys.filter(F.pmod(F.xxhash64(key), F.lit(one_in)) == 0).distinct().collect()
    return sorted(r[0] for r in sample)[_OVERSAMPLE // 2::_OVERSAMPLE]


def _slice(key: Column, bounds: list) -> Column:
    """How many boundaries are at or below the key, found in two short scans."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[k:k + width] for k in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(g[0]) for g in groups])
    nested = F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups])
    group = F.size(F.filter(heads, lambda b: b <= key))
    inside = F.size(F.filter(F.try_element_at(nested, group), lambda b: b <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * width + inside)


def with_next(rows: DataFrame, key: str, tie: list[Column], fields: list[str], out: str = "next", wrap: bool = False, before: str | None = None,
              keys: DataFrame | None = None) -> DataFrame:
    """``rows`` with a struct ``out`` of ``fields`` of the row that follows in the order of ``key`` and ``tie``.

    With ``wrap`` the first row follows the last one; else the last has a null. With ``before`` a struct of
    the row ahead is added too. A null key comes first. Rows equal in key and tie follow each other in any order.
    ``keys`` has the same keys at less cost, for the boundaries.
    """
    keys = rows if keys is None else keys
    bounds = boundaries(keys, key)
    least = keys.agg(F.min(key)).first()[0] if wrap else None
    nothing = wrap and not keys.filter(F.col(key).isNull()).isEmpty()
    k = F.col(key)
    cut = rows.withColumn("__s", F.coalesce(_slice(k, bounds), F.lit(0)).cast("int"))
    at_border = (F.col("__s") > 0) & (k == F.try_element_at(F.array(*[F.lit(b) for b in bounds]), F.col("__s"))) if bounds else F.lit(False)
    first = k.isNull() if nothing else (k == F.lit(least)) if wrap and least is not None else F.lit(False)
    homes = [F.struct(F.col("__s").alias("s"), F.lit(0).alias("g")), F.when(at_border, F.struct((F.col("__s") - 1).alias("s"), F.lit(1).alias("g")))]
    if wrap:
        homes.append(F.when(first, F.struct(F.lit(len(bounds)).alias("s"), F.lit(2).alias("g"))))
    if before:  # the row ahead of a border is the last of the slice before: its rows look on from there
        homes.append(F.when(F.col("__last"), F.struct((F.col("__s") + 1).alias("s"), F.lit(-1).alias("g"))))
        last = Window.partitionBy("__s").orderBy(k.desc_nulls_last(), *[t.desc() for t in tie])
        cut = cut.withColumn("__last", F.row_number().over(last) == 1)
    spread = cut.select("*", F.explode(F.filter(F.array(*homes), lambda h: h.isNotNull())).alias("__h")).withColumns({"__s": F.col("__h.s"), "__g": F.col("__h.g")}).drop("__h", "__last")
    window = Window.partitionBy("__s").orderBy("__g", F.col(key).asc_nulls_first(), *tie)
    found = spread.withColumn(out, F.lead(F.struct(*fields)).over(window))
    if before:
        found = found.withColumn(before, F.lag(F.struct(*fields)).over(window))
    return found.filter("__g = 0").drop("__s", "__g")
