"""Sitemap files: (loc, lastmod) rows; malformed dates become null, other pages are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.labels import lenient_timestamp
from evidex.functions.urls import slug_of

SCHEMA = "loc string, lastmod string"


def read_sitemaps(spark: SparkSession, path: str, item_path: str | None = None) -> DataFrame:
    """Every ``<url>`` of a folder of sitemaps, split over tasks by the reader."""
    rows = spark.read.format("xml").option("rowTag", "url").option("ignoreNamespace", "true").schema(SCHEMA).load(path)
    loc = F.trim("loc")
    kept = rows.filter((loc != "") & (F.contains(loc, F.lit(item_path)) if item_path else F.lit(True)))
    return kept.select(loc.alias("url"), slug_of(loc).alias("slug"), lenient_timestamp(F.trim("lastmod")).alias("lastmod"))


def write_sitemaps(listing: DataFrame, path: str) -> None:
    """One sitemap file per partition, for tests and exports."""
    (listing.select(F.col("url").alias("loc"), "lastmod").write.format("xml")
     .option("rootTag", "urlset").option("rowTag", "url").save(path))
