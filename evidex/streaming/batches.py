"""Streams that add to tables: every micro-batch is appended under its number, and the current row of a key is found on reading.

A batch that is replayed after a failure replaces its own folder, so it counts once. Nothing is merged or rewritten while
a stream runs; what a table holds is a combinable aggregate over its batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidex.functions.hashing import content_hash


class BatchTable:
    """A folder of Parquet batches (``batch_id=n``) and the rule by which rows of one key become one.

    ``rule`` names an aggregate per column; the order it goes by has to be in the rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: Sequence[str], rule: dict[str, Column]):
        self.spark, self.path, self.keys, self.rule = spark, path, list(keys), rule
        self.schema = spark.createDataFrame([], schema).schema

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch, its own rows of a key already made one."""
        self._one(batch.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def read(self, only: DataFrame | None = None) -> DataFrame:
        """One row per key; with ``only``, of its keys."""
        try:
            rows = self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], self.schema)
        return self._one(rows if only is None else rows.join(only.select(*self.keys).distinct(), self.keys, "left_semi"))

    def _one(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*[how.alias(name) for name, how in self.rule.items()]).select(*self.schema.names)


def issue_table(spark: SparkSession, path: str) -> BatchTable:
    """The review queue: one open row per (maker, kind, subject), newest detail wins."""
    newest = F.struct("seen_s", "detail")
    return BatchTable(spark, path, "maker_id int, kind string, subject string, opened_s bigint, seen_s bigint, detail string", ["maker_id", "kind", "subject"],
                      {"opened_s": F.min("opened_s"), "seen_s": F.max("seen_s"), "detail": F.max_by("detail", newest)})


def issue_stream(found: DataFrame, queue: BatchTable, checkpoint: str):
    """Keep the review queue current."""
    return found.writeStream.foreachBatch(queue.append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def head_table(spark: SparkSession, path: str) -> BatchTable:
    """The hash of the newest good fetch of every url."""
    return BatchTable(spark, path, "url string, hash string, fetched_s bigint", ["url"], {"hash": F.max_by("hash", "fetched_s"), "fetched_s": F.max("fetched_s")})


def sync_stream(log: DataFrame, heads: BatchTable, products: BatchTable, dead_letters: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
                checkpoint: str, noise: Sequence[str] = ()):
    """Changed-only ingestion: parse what is new or different, set failures aside, go on.

    ``parse`` maps changed (url, body, fetched_s) rows to (product rows, dead letters). Heads are written last, and a batch is compared with
    those of other batches only, so one that failed half-way is parsed again, with the same result.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        newest = batch.filter("status between 200 and 299").groupBy("url").agg(
            F.max_by(F.struct("body", "fetched_s"), F.struct("fetched_s", "id")).alias("r")).select("url", "r.*")
        hashed = newest.withColumn("hash", content_hash(F.col("body"), noise)).persist()
        try:
            held = heads.read(hashed).select("url", F.col("hash").alias("held"))
            changed = hashed.join(held, "url", "left").filter(~F.col("held").eqNullSafe(F.col("hash"))).drop("held")
            rows, failed = parse(changed)
            failed.write.mode("overwrite").parquet(f"{dead_letters}/batch_id={batch_id}")
            products.append(rows, batch_id)
            heads.append(hashed, batch_id)
        finally:
            hashed.unpersist()

    return log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
