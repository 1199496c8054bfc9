"""Texts packed for the shuffles that have to move them, and classes of equal word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(items: DataFrame) -> DataFrame:
    """``item_id, z``: every description as compressed UTF-8 (null: empty); a shuffle then moves a third of it."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pd.DataFrame({"item_id": batch["item_id"], "z": [press.compress(bytes(t)) for t in batch["b"]]})

    return items.select("item_id", as_bytes().alias("b")).mapInPandas(run, f"item_id {kind}, z binary")


def as_bytes():
    return F.coalesce(F.col("description").cast("string"), F.lit("")).cast("binary")


def unpacker():
    import zstandard

    return zstandard.ZstdDecompressor().decompress
