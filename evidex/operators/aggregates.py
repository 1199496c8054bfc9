"""Counts, facets, spans, mining and colour summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex import vocabulary as V
from evidex.functions.text import tokens
from evidex.operators.ordered import top_per_key


def facet_counts(items: DataFrame, facets: Sequence[str]) -> DataFrame:
    """(facet, value, n) of several facets in one scan; a choice nothing backs never appears.

    Each facet is one grouping set, so the shuffle carries one partial row per value and task.
    """
    sets = [[F.col(f)] for f in facets]
    grouped = items.groupingSets(sets, *facets).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__set"))
    # grouping_id marks the columns that are NOT in the set
    full = (1 << len(facets)) - 1
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, f in enumerate(facets):
        mine = F.col("__set") == F.lit(full & ~(1 << (len(facets) - 1 - i)))
        name = F.when(mine, F.lit(f)).otherwise(name)
        value = F.when(mine, F.col(f).cast("string")).otherwise(value)
    return grouped.select(name.alias("facet"), value.alias("value"), "n").filter("value is not null")


def facet_options(items: DataFrame, makers: DataFrame, evidence: DataFrame, clays: DataFrame) -> DataFrame:
    """(facet, value, label, maker, n, place): every choice that an item backs, as it is shown.

    Lines and clays belong to makers and stand under them, by the maker's name and then their own; a clay counts the items it is shown on.
    All counts are combined before they are shuffled, and labels are joined to counts, never to items.
    """
    spark = items.sparkSession
    counted = items.groupingSets([[F.col("maker_id")], [F.col("maker_id"), F.col("line")], [F.col("surface")], [F.col("opacity")]], "maker_id", "line", "surface", "opacity").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("__set"))
    named = makers.select("maker_id", F.col("maker_key").alias("maker"))
    nothing = F.lit(None).cast("string")

    def rows(df: DataFrame, facet: str, value: Column, label: Column, maker: Column) -> DataFrame:
        return df.select(F.lit(facet).alias("facet"), value.cast("string").alias("value"), label.alias("label"), maker.alias("maker"), "n")

    def of(bits: int) -> DataFrame:
        return counted.filter(F.col("__set") == bits)

    shown = evidence.filter("clay is not null").select("clay", "item_id").distinct().groupBy("clay").agg(F.count(F.lit(1)).alias("n"))
    every = [rows(of(0b0111).join(named, "maker_id"), "maker", F.col("maker_id"), F.col("maker"), nothing),
             rows(of(0b0011).filter("line is not null").join(named, "maker_id"), "line", F.col("line"), F.col("line"), F.col("maker")),
             rows(of(0b1101).join(V.surfaces(spark), "surface"), "surface", F.col("surface"), F.col("surface_name"), nothing),
             rows(of(0b1110).join(V.opacities(spark), "opacity"), "opacity", F.col("opacity"), F.col("opacity_name"), nothing),
             rows(shown.join(clays, "clay").join(named, "maker_id"), "clay", F.col("clay"), F.col("clay_name"), F.col("maker"))]
    order = Window.partitionBy("facet").orderBy(F.asc_nulls_first("maker"), "label", "value")
    return reduce(DataFrame.unionByName, every).withColumn("place", F.row_number().over(order).cast("long"))


def report(items: DataFrame, evidence: DataFrame, issues: DataFrame) -> DataFrame:
    """Catalog totals as (metric, n): one pass per table."""
    def long(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
        row = df.agg(*[agg.alias(name) for name, agg in metrics.items()])
        pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).cast("bigint").alias("n")) for name in metrics])
        return row.select(F.inline(pairs))

    return (long(items, {"items": F.count(F.lit(1)), "items_with_range": F.count("lo"), "items_priced": F.count("price")})
            .unionByName(long(evidence, {"evidence": F.count(F.lit(1)), "with_clay": F.count("clay"), "layered": F.count("layered_over")}))
            .unionByName(long(issues, {"open_issues": F.count_if(F.col("resolved_s").isNull())})))


def token_support(docs: DataFrame, doc_id: str, group: str, text: str, share: float = 0.5) -> DataFrame:
    """Tokens at least ``share`` of a group's documents contain.

    Documents yield their distinct tokens in place; the shuffle carries one partial count per
    (group, token) and task.
    """
    sizes = docs.groupBy(group).agg(F.count_distinct(doc_id).alias("n_docs"))
    support = (docs.select(group, F.explode(F.array_distinct(tokens(F.col(text)))).alias("token"))
               .groupBy(group, "token").agg(F.count(F.lit(1)).alias("n_with")))
    return support.join(sizes, group).filter(F.col("n_with") >= share * F.col("n_docs"))


def shared_assets(assets: DataFrame, name: str, owner: str) -> DataFrame:
    """Assets cited by more than one owner."""
    return (assets.select(name, owner).distinct().groupBy(name).agg(F.count(F.lit(1)).alias("owners"))
            .filter("owners > 1"))


def reuse(rows: DataFrame, key: Column, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct(key, 0.01) if approximate else F.count_distinct(key)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), distinct.alias("n_distinct"))


def code_collisions(items: DataFrame, raw: str, code: Column, keys: Sequence[str]) -> DataFrame:
    """Codes several raw spellings normalise to, within ``keys``."""
    pairs = items.select(*keys, raw, code.alias("code")).distinct()
    return pairs.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("spellings")).filter("spellings > 1")


def last_stated(rows: DataFrame, key: str, value: Column, order: Column, out: str) -> DataFrame:
    """The last value that was stated at all."""
    return rows.groupBy(key).agg(F.max_by(value, F.when(value.isNotNull(), order)).alias(out))


def item_words(readings: DataFrame, owner: str, words: str) -> DataFrame:
    """Sorted set of the words of all an item's readings."""
    return (readings.select(owner, F.explode(words).alias("word")).distinct()
            .groupBy(owner).agg(F.array_sort(F.collect_list("word")).alias("words")))


def dominant_colors(pixels: DataFrame, image: str, bits: int = 3, background: int = 235, min_kept: int = 32) -> DataFrame:
    """The two largest colour bins of every image, with their mean colour.

    Pixels are binned on the leading bits of each channel and counted map-side; an image is at most
    2^(3*bits) bins however many pixels it has. Near-white pixels are left out when at least
    ``min_kept`` others remain.
    """
    shift = 8 - bits
    light = F.least("r", "g", "b") >= background
    binned = (pixels.withColumn("light", light)
              .groupBy(image, "light", *[F.shiftright(c, shift).alias(f"q{c}") for c in "rgb"])
              .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in "rgb"]))
    dark = F.sum(F.when(~F.col("light"), F.col("n"))).over(Window.partitionBy(image))
    kept = binned.withColumn("__dark", F.coalesce(dark, F.lit(0))).filter(
        (F.col("__dark") < min_kept) | ~F.col("light"))
    merged = kept.groupBy(image, "qr", "qg", "qb").agg(F.sum("n").alias("n"), *[F.sum(f"s{c}").alias(f"s{c}") for c in "rgb"])
    ranked = top_per_key(merged, [image], [F.desc("n"), F.col("qr"), F.col("qg"), F.col("qb")], 2, "place")
    return ranked.select(image, "place", "n", *[(F.col(f"s{c}") / F.col("n")).alias(c) for c in "rgb"])


def two_means(pixels: DataFrame, image: str, rounds: int = 10) -> DataFrame:
    """Two colour centres per image by Lloyd's iterations over its colour bins.

    Pixels are first merged to (image, colour) counts, so an image is a bounded group; the numeric
    loop runs in Arrow batches inside the tasks.
    """
    counted = pixels.groupBy(image, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    # 2^15 coarse cells bound the group whatever the image size.
    cells = counted.groupBy(image, *[F.shiftright(c, 3).alias(f"q{c}") for c in "rgb"]).agg(
        F.sum("n").alias("n"), *[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"])

    def centres(key, frame):
        import numpy as np
        import pandas as pd

        points = frame[["r", "g", "b"]].to_numpy(float)
        weights = frame["n"].to_numpy(float)
        order = np.lexsort((points[:, 2], points[:, 1], points[:, 0]))
        points, weights = points[order], weights[order]
        light = points.sum(axis=1)
        centre = np.stack([points[light.argmin()], points[light.argmax()]])
        label = np.zeros(len(points), int)
        for _ in range(rounds):
            label = ((points[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            for j in (0, 1):
                if weights[label == j].sum():
                    centre[j] = np.average(points[label == j], axis=0, weights=weights[label == j])
        size = [weights[label == j].sum() for j in (0, 1)]
        rank = sorted((0, 1), key=lambda j: -size[j])
        rows = [(key[0], place, int(size[j]), *centre[j]) for place, j in enumerate(rank, 1) if size[j]]
        return pd.DataFrame(rows, columns=[image, "place", "n", "r", "g", "b"])

    kind = pixels.schema[image].dataType.simpleString()
    return cells.groupBy(image).applyInPandas(centres, f"{image} {kind}, place int, n bigint, r double, g double, b double")
