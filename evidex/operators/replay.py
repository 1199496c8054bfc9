"""Bulk replay: stored bodies to all their tables, parsed once, with the counts of the run observed on the way.

The parsed rows are written once and every table is read off them. Counts are metrics of the two writes that happen anyway
(``DataFrame.observe``), so the funnel costs no pass of its own. Bodies are dealt out before they are parsed, and images before their names
are read: both are few bytes and much work, and a split by bytes would leave them to few tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from evidex.operators import filenames as N
from evidex.session import shared_dir, spread
from evidex.sources import html_pages as H
from evidex.sources import json_products as J


@dataclass(frozen=True)
class Replay:
    """The tables of a replay and its funnel: bodies, products, dead letters, images, and images by confidence."""

    products: DataFrame
    images: DataFrame
    badges: DataFrame
    unknown: DataFrame
    dead_letters: DataFrame
    funnel: dict[str, int]


def _observed(df: DataFrame, name: str, counts: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """The rows, written once, and counts over them."""
    watch = Observation(name)
    path = shared_dir(df.sparkSession, name)
    df.observe(watch, *[c.alias(k) for k, c in counts.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), {k: v or 0 for k, v in watch.get.items()}


def _by_confidence() -> dict[str, Column]:
    return {"images": F.count(F.lit(1))} | {level: F.count_if(F.col("confidence") == level) for level in ("high", "medium", "low")}


def _every(ok: Column) -> dict[str, Column]:
    return {"bodies": F.count(F.lit(1)), "products": F.count_if(ok), "dead_letters": F.count_if(~ok)}


def replay_payloads(log: DataFrame, key: str = "url", body: str = "body") -> Replay:
    """JSON payloads of the second source."""
    reason = J.dead_letter_reason(F.col("product"))
    parsed, funnel = _observed(J.parse_products(spread(log.select(key, body), key, body)).drop(body).withColumn("reason", reason), "parsed-payloads", _every(F.col("reason").isNull()))
    good = parsed.filter("reason is null")
    products = J.product_rows(good, [key])
    shown = spread(J.images(good, [key]), key).join(products.select(key, F.col("code").alias("product_code")), key)
    images, counts = _observed(N.source_b_facts(shown, "raw_filename"), "payload-images", _by_confidence())
    values = J.attribute_values(good, [key])
    return Replay(products, images, J.badges(values, [key]), J.unknown_attributes(values, [key]), parsed.filter("reason is not null").select(key, "reason"), funnel | counts)


def replay_pages(log: DataFrame, key: str = "url", body: str = "body") -> Replay:
    """HTML pages of the first source; a page that names no product is a dead letter."""
    log = spread(log.select(key, body), key, body)
    fields = H.product_fields(log, [key], body)
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    parts = log.select(key, F.struct(H.links(F.col(body), H.GALLERY, H.GALLERY_LINK).alias("links"), H.icons(F.col(body)).alias("icons")).alias("found"))
    parsed, funnel = _observed(fields.join(parts.hint("merge"), key), "parsed-pages", _every(named))
    good = parsed.filter(named)
    shown = H.named_images(spread(good.select(key, F.col("code").alias("product_code"), F.col("name").alias("product_name"), F.posexplode("found.links").alias("place", "source_url")), key, "place"))
    images, counts = _observed(N.source_a_facts(shown, "raw_filename"), "page-images", _by_confidence())
    badges, unknown = H.badges_of(good.select(key, F.posexplode("found.icons").alias("place", "icon")), [key])
    return Replay(good.drop("found"), images, badges, unknown, parsed.filter(~named).select(key, F.lit("no product").alias("reason")), funnel | counts)
