"""Binary files (pictures) as a source: named by their content, kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.functions.hashing import storage_key


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, changed_at, bytes, sha256, storage_key) of every file below ``path`` whose name fits ``pattern``.

    A file is read, hashed and let go where it is read; its content goes no further.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    hashed = files.select("path", F.col("modificationTime").alias("changed_at"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return hashed.withColumn("storage_key", storage_key(F.col("sha256")))


def stored_once(files: DataFrame, *owners: str) -> DataFrame:
    """One row per content: its key and size, the path that stands for it (the least), and how many paths and owners cite it."""
    cited = [F.count_distinct(o).alias(f"n_{o}") for o in owners]
    return files.groupBy("sha256", "storage_key").agg(F.min("bytes").alias("bytes"), F.min("path").alias("first_path"), F.count(F.lit(1)).alias("n_paths"), *cited)
