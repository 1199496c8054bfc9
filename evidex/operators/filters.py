"""Facet, interval, identity and evidence filters.

Single-search filters take plain Python values and emit only the predicates in force, so they reach
the Parquet scan. Batch filters take a table of searches whose filter columns are arrays (null or
empty: no restriction).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.codes import fold
from evidex.functions.intervals import overlaps


def facets(items: DataFrame, wanted: Mapping[str, Sequence | None]) -> DataFrame:
    """OR within a facet, AND across; a null or empty list restricts nothing."""
    for column, values in wanted.items():
        if values:
            items = items.filter(F.col(column).isin(list(values)))
    return items


def tristate(items: DataFrame, column: str, wanted: bool | None, stated: bool = True) -> DataFrame:
    """Rows whose flag equals ``wanted``; with ``stated=False`` null is a value one can ask for."""
    if wanted is None and stated:
        return items
    return items.filter(F.col(column).eqNullSafe(F.lit(wanted).cast("boolean")))


def exact_lookup(items: DataFrame, makers: DataFrame, refs: DataFrame) -> DataFrame:
    """Items named by (maker key, code) references, ignoring case and edge blanks; a miss is no row."""
    keyed = items.join(makers, "maker_id").withColumns({"__m": fold(F.col("maker_key")), "__c": fold(F.col("code"))})
    wanted = refs.select(F.col("ref_id"), fold(F.col("maker")).alias("__m"), fold(F.col("code")).alias("__c"))
    return keyed.join(wanted, ["__m", "__c"]).drop("__m", "__c")


def paired_refs(lists: DataFrame, codes: str = "codes", makers: str = "makers", keep: Sequence[str] = ()) -> DataFrame:
    """Parallel arrays to (maker, code) rows; the shorter one is padded with null and null never matches."""
    return (lists.select(*keep, F.inline(F.arrays_zip(F.col(codes).alias("code"), F.col(makers).alias("maker"))))
            .select(*keep, fold(F.col("maker")).alias("maker_key"), fold(F.col("code")).alias("code_key"))
            .filter("maker_key is not null and code_key is not null"))


def paired(items: DataFrame, makers: DataFrame, refs: DataFrame | None) -> DataFrame:
    """Items in an identity list: ``None`` restricts nothing, an empty list matches nothing."""
    if refs is None:
        return items
    keyed = items.join(makers, "maker_id").withColumn("code_key", fold(F.col("code")))
    return keyed.join(refs.distinct(), ["maker_key", "code_key"], "left_semi").drop("code_key")


def with_evidence(items: DataFrame, evidence: DataFrame) -> DataFrame:
    """Items that have a matching evidence row."""
    return items.join(evidence.select("item_id"), "item_id", "left_semi")


def under_path(categories: Column, path: str, excluded: Sequence[str]) -> Column:
    """Is a product filed under ``path``, and in none of the ``excluded`` categories? Unreadable means no."""
    inside = F.exists(categories, lambda c: F.coalesce(F.contains(c["link"], F.lit(path)), F.lit(False)))
    barred = F.exists(categories, lambda c: F.coalesce(c["slug"].isin(list(excluded)), F.lit(False)))
    return F.coalesce(inside & ~barred, F.lit(False))


def discovered(listing: DataFrame, allowed: DataFrame, since: Column | None = None) -> DataFrame:
    """Listed URLs whose slug is allowed; pruned only when known to be no newer than ``since``."""
    kept = listing.join(allowed.select("slug"), "slug", "left_semi")
    if since is None:
        return kept
    return kept.filter(F.col("lastmod").isNull() | (F.col("lastmod") > since))


def _unrestricted(column: Column) -> Column:
    return column.isNull() | (F.size(column) == 0)


def row_passes(searches: str = "") -> Column:
    """Per-row filters of a joined (search, item) pair: facets, flag and interval."""
    def allowed(array: str, column: str) -> Column:
        return _unrestricted(F.col(array)) | F.coalesce(F.array_contains(F.col(array), F.col(column)), F.lit(False))

    return (allowed("makers", "maker_id") & allowed("lines", "line") & allowed("surfaces", "surface")
            & allowed("opacities", "opacity")
            & (F.col("want_flag").isNull() | F.col("flag").eqNullSafe(F.col("want_flag")))
            & overlaps(F.col("lo"), F.col("hi"), F.col("want_lo"), F.col("want_hi")))


def prune_scoped(searches: DataFrame, children: DataFrame, makers: str, child_array: str) -> DataFrame:
    """Drop chosen children (lines, clays) that the chosen makers rule out; no maker chosen rules out nothing.

    ``children`` has one row (child, maker_id) per vocabulary entry.
    """
    free = searches.filter(_unrestricted(F.col(makers)) | _unrestricted(F.col(child_array)))
    bound = searches.filter(~(_unrestricted(F.col(makers)) | _unrestricted(F.col(child_array))))
    kept = (bound.select("qid", makers, F.explode(child_array).alias("child"))
            .join(children, "child")
            .filter(F.array_contains(F.col(makers), F.col("maker_id")))
            .groupBy("qid").agg(F.array_sort(F.collect_set("child")).alias(child_array)))
    return free.unionByName(bound.drop(child_array).join(kept, "qid", "left").select(*searches.columns))


def clamp_range(lo: Column, hi: Column, last_set: Column) -> tuple[Column, Column]:
    """The end chosen last wins; a crossed other end follows it."""
    crossed = lo > hi
    new_hi = F.when(crossed & (last_set == "lo"), lo).otherwise(hi)
    new_lo = F.when(crossed & (last_set == "hi"), hi).otherwise(lo)
    return new_lo, new_hi


def active_count(arrays: Sequence[str], lo: str, hi: str, flag: str) -> Column:
    """How many kinds of constraint a search holds (not how many values)."""
    parts = [(~_unrestricted(F.col(a))).cast("int") for a in arrays]
    parts.append((F.col(lo).isNotNull() | F.col(hi).isNotNull()).cast("int"))
    parts.append(F.coalesce(F.col(flag), F.lit(False)).cast("int"))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def request_key(text: Column, limit: Column, arrays: Sequence[Column], scalars: Sequence[Column]) -> Column:
    """The meaning of a request as one string: sets sorted, blanks trimmed, null and blank text and empty and absent sets equal.

    The parts stand in a JSON object by place, so different requests never share a key.
    """
    def canon(a: Column) -> Column:
        return F.when(~_unrestricted(a), F.array_sort(F.array_distinct(a)))

    parts = [F.coalesce(F.trim(text), F.lit("")), limit, *[canon(a) for a in arrays], *scalars]
    return F.to_json(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(parts)]))
