"""Exact duplicates among item descriptions, by recursive hash partitioning (grace hash deduplication).

Records are partitioned by leading bits of a hash of their text into buckets of spill files in the shared folder. A
bucket whose distinct texts are too large for a table is written anew by more bits, again and again, until every
bucket fits. Each bucket is then read once, past an open-addressing table that compares complete contents; the hash
alone decides nothing.

A group of copies cannot be split by its hash, so it is made small before it moves: every reading task collapses the
copies that it meets to one record with a list of their ids (in windows of bounded size). Group sizes and least ids
are combinable aggregates over such records, joined back under adaptive skew handling.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.session import stored

#: Compressed bytes of distinct texts that one table may hold, and at which a reading task hands on what it has.
BUCKET_BYTES, WINDOW_BYTES, WINDOW_IDS = 64 << 20, 16 << 20, 50_000
_STEP_BITS, _HASH_BITS = 4, 64
_RECORD = "h long, z binary, bytes long, sha binary, items array<long>"
_MATCHED = "bucket string, entry int, sha binary, items array<long>"


class ContentTable:
    """Open addressing with linear probing: a hash finds the place, the complete content decides."""

    def __init__(self) -> None:
        self.slots = [-1] * 64
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def find_or_add(self, h: int, content: bytes) -> tuple[int, bool]:
        """The number of this content, and whether it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and _same(self.contents[entry], content):
                return entry, False
            at = (at + 1) & mask
        self.slots[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        if 3 * len(self.hashes) > 2 * len(self.slots):
            self._grow()
        return len(self.hashes) - 1, True

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _same(a: bytes, b: bytes) -> bool:
    """Whether two compressed contents are of one text (two versions of a compressor may write it in two ways)."""
    if a == b:
        return True
    import zstandard

    undo = zstandard.ZstdDecompressor().decompress
    return undo(a) == undo(b)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record per text and window, with the ids of its copies."""
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    schema = pa.schema([("h", pa.int64()), ("z", pa.binary()), ("bytes", pa.int64()), ("sha", pa.binary()), ("items", pa.list_(pa.int64()))])
    table, shas, items, held, ids = ContentTable(), [], [], 0, 0

    def window() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            (table.hashes, table.contents, [len(z) for z in table.contents], shas, items), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for item, content, sha, h in zip(*(batch.column(c).to_pylist() for c in ("item_id", "content", "sha", "h")), strict=True):
            z = press(content)
            entry, new = table.find_or_add(h, z)
            if new:
                shas.append(sha)
                items.append([])
                held += len(z)
            items[entry].append(item)
            ids += 1
            if held >= WINDOW_BYTES or ids >= WINDOW_IDS:
                yield window()
                table, shas, items, held, ids = ContentTable(), [], [], 0, 0
    if ids:
        yield window()


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each record's content within its bucket; a bucket's records follow each other."""
    now, table = None, ContentTable()
    for batch in batches:
        entries = []
        for bucket, h, z in zip(*(batch.column(c).to_pylist() for c in ("bucket", "h", "z")), strict=True):
            if bucket != now:
                now, table = bucket, ContentTable()
            entries.append(table.find_or_add(h, z)[0])
        yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(entries, pa.int32()), batch.column("sha"), batch.column("items")], names=["bucket", "entry", "sha", "items"])


def _buckets(records: DataFrame, bits: int) -> DataFrame:
    """The records under the leading ``bits`` of their hash."""
    lead = F.shiftrightunsigned("h", _HASH_BITS - bits) if bits else F.lit(0)
    return records.withColumn("bucket", F.concat(F.lit(f"{bits}:"), lead.cast("string")))


def _too_large(records: DataFrame, limit: int) -> DataFrame:
    """Buckets that can be split and whose distinct texts are beyond the limit (copies count once)."""
    texts = records.groupBy("bucket", "h").agg(F.max("bytes").alias("bytes"))
    return texts.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("texts")).filter(f"bytes > {limit} and texts > 1").select("bucket")


def spilled(records: DataFrame, limit: int) -> DataFrame:
    """The records with a ``bucket`` whose distinct texts fit a table of ``limit`` bytes (or are one text)."""
    spark = records.sparkSession
    total = records.agg(F.sum("bytes")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(int(2 * total // limit), tasks).bit_length()
    fits, level = [], _buckets(records, bits)
    while True:
        large = stored(_too_large(level, limit), "large-buckets") if bits < _HASH_BITS else None
        if large is None or large.isEmpty():
            return reduce(DataFrame.union, [*fits, level])
        fits.append(level.join(large, "bucket", "left_anti").select(level.columns))
        bits = min(bits + _STEP_BITS, _HASH_BITS)
        level = _buckets(stored(level.join(large, "bucket", "left_semi").drop("bucket"), "spill"), bits)


def distinct_items(items: DataFrame, bucket_bytes: int = BUCKET_BYTES, hash_bits: int = _HASH_BITS) -> DataFrame:
    """``item_id, keep_id, group_size, kept, text_sha256`` of every item, those that go included.

    ``items`` has ``item_id`` (whole number) and ``description``; other columns are not looked at. Texts are equal when identical
    after each run of blanks and control characters from tab to carriage return became one space; a null is an empty text, and all
    empty texts are a group. ``keep_id`` is the least id of the group (null ids do not count), ``kept`` whether the row has it:
    repeated rows of that id all stay, and so do rows without id in a group where none has one, as nothing tells them apart.
    ``text_sha256`` is of the text in that form. An empty table has an empty result. ``hash_bits`` below 64 is for tests.
    """
    text = F.regexp_replace(F.coalesce(F.col("description").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    read = items.select(F.col("item_id").cast("long").alias("item_id"), text.cast("binary").alias("content"), F.unhex(F.sha2(text, 256)).alias("sha"),
                        F.shiftleft(F.xxhash64(text), _HASH_BITS - hash_bits).alias("h"))
    records = stored(read.mapInArrow(_collapse, _RECORD), "spill")
    placed = spilled(records, bucket_bytes).select("bucket", "h", "z", "sha", "items")
    matched = stored(placed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_match, _MATCHED), "matched")
    groups = matched.groupBy("bucket", "entry").agg(F.min(F.array_min("items")).alias("keep_id"), F.sum(F.size("items").cast("long")).alias("group_size"))
    rows = matched.join(groups, ["bucket", "entry"]).select(F.explode("items").alias("item_id"), "keep_id", "group_size", F.lower(F.hex("sha")).alias("text_sha256"))
    return rows.select("item_id", "keep_id", "group_size", F.col("item_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
