"""Records with what hangs on them: labels of items, personal marks beside the catalog, pieces with their timeline and pictures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex import vocabulary as V
from evidex.operators.ordered import placed


def with_labels(items: DataFrame, makers: DataFrame, lines: DataFrame) -> DataFrame:
    """Items with the names behind their ids; an id without a name keeps a null, an item without a maker goes.

    Vocabularies are constants and are broadcast; makers and lines are joined by their size.
    """
    spark = items.sparkSession
    cones = V.cones(spark)
    return (items.join(makers, "maker_id").join(lines, "line", "left")
            .join(cones.withColumnsRenamed({"ordinal": "lo", "cone": "range_from"}), "lo", "left")
            .join(cones.withColumnsRenamed({"ordinal": "hi", "cone": "range_to"}), "hi", "left")
            .join(V.surfaces(spark), "surface", "left").join(V.opacities(spark), "opacity", "left"))


def marked_items(marks: DataFrame, items: DataFrame) -> DataFrame:
    """(mark_id, name, in_catalog, place) of every mark, the latest first (ties by id).

    A mark whose item has left the catalog shows the name that was stored with it.
    """
    found = items.select("item_id", "name", F.lit(True).alias("__there"))
    named = marks.join(found, "item_id", "left").select(
        "mark_id", F.coalesce("name", "stored_name").alias("name"), F.coalesce("__there", F.lit(False)).alias("in_catalog"), (-F.col("updated")).alias("__newest"))
    return placed(named, [], ["__newest", "mark_id"], "place").select("mark_id", "name", "in_catalog", F.col("place").cast("long").alias("place"))


def timeline(pieces: DataFrame, entries: DataFrame, media: DataFrame, entry_key: Sequence[str]) -> DataFrame:
    """Pieces with ``entries``, an array in order of ``entry_key``, each with its ``media`` in order of ``media_no``.

    ``entries`` has ``piece`` and ``entry_key``; ``media`` besides ``media_no, path``. Pieces without entries and entries without media
    have empty arrays. A group is one entry's or one piece's own rows.
    """
    shown = media.groupBy("piece", *entry_key).agg(F.array_sort(F.collect_list(F.struct("media_no", "path"))).alias("media"))
    nothing = F.array().cast(shown.schema["media"].dataType)
    with_media = entries.join(shown, ["piece", *entry_key], "left").withColumn("media", F.coalesce("media", nothing))
    own = with_media.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct(*entry_key, "media"))).alias("entries"))
    return pieces.join(own, "piece", "left").withColumn("entries", F.coalesce("entries", F.array().cast(own.schema["entries"].dataType)))
