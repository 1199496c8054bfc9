"""The fetch log: newest rows, retention, change detection, as-of heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.hashing import content_hash
from evidex.operators.ordered import ordered_scan, time_slice, top_per_key
from evidex.session import stored

#: outcomes of a fetch
STORED, UNCHANGED, GONE, FAILED, RETRIED = "stored", "unchanged", "gone", "failed", "retried"


def newest(log: DataFrame, keys: Sequence[str] = ("url",)) -> DataFrame:
    """The newest row per key. Only positions are aggregated; bodies are joined for the winners alone."""
    head = log.groupBy(*keys).agg(F.max(F.struct("fetched_s", "id")).alias("__at")).select(
        *keys, F.col("__at.fetched_s").alias("fetched_s"), F.col("__at.id").alias("id"))
    return log.join(head, [*keys, "fetched_s", "id"], "left_semi")


def for_makers(log: DataFrame, makers: DataFrame) -> DataFrame:
    """Rows of the given sources only, so one source's page never meets another's parser."""
    return log.join(makers.select("maker_id"), "maker_id", "left_semi")


def doomed(log: DataFrame, keep: int) -> DataFrame:
    """Rows beyond the ``keep`` newest per url. At least one is always kept, or the next comparison
    would have nothing to compare with."""
    kept = top_per_key(log.select("url", "id", "fetched_s"), ["url"], [F.desc("fetched_s"), F.desc("id")], max(keep, 1))
    return log.join(kept.select("url", "id"), ["url", "id"], "left_anti")


def outcomes(log: DataFrame, noise: Sequence[str] = (), slice_seconds: int = 86_400) -> DataFrame:
    """What every fetch amounted to: only 200s are compared, each with the 200 before it.

    An unchanged fetch has the stored hash by definition, so "the previous 200" and "the newest
    stored" hold the same hash.
    """
    status = F.col("status")
    # Bodies are read and hashed here, once; what follows sees narrow rows.
    hashed = stored(log.select("url", "id", "fetched_s", "status", F.when(status.between(200, 299), content_hash(F.col("body"), noise)).alias("hash")), "hashes")
    rows = hashed.withColumn("us", F.col("fetched_s") * 1_000_000)
    seen = ordered_scan(rows, ["url"], ["fetched_s", "id"], time_slice("us", slice_seconds), {"before": ("prior_last", "hash")})
    compared = F.when(F.col("before").eqNullSafe(F.col("hash")), UNCHANGED).otherwise(STORED)
    return seen.select("url", "id", "fetched_s", "status", "hash", F.when(F.col("hash").isNotNull(), compared).otherwise(status_outcome(status)).alias("outcome"))


def status_outcome(status: Column) -> Column:
    """The meaning of a status that brings no body: withdrawn is a fact, a server error is retried."""
    return (F.when(status == 304, UNCHANGED).when(status.isin(404, 410), GONE)
            .when((status >= 500) | (status == 429), RETRIED).otherwise(FAILED))


def fetch_results(attempts: DataFrame) -> DataFrame:
    """One outcome per fetch from its attempts: the last attempt decides, and a retry that was the last is a failure."""
    last = attempts.groupBy("url", "fetch_no").agg(F.max_by("outcome", "attempt").alias("__last"), F.max("attempt").alias("attempts"))
    return last.select("url", "fetch_no", "attempts", F.when(F.col("__last") == RETRIED, FAILED).otherwise(F.col("__last")).alias("outcome"))


def head_as_of(probes: DataFrame, log: DataFrame, keys: Sequence[str], value: str, slice_by: Column) -> DataFrame:
    """The value in force when each probe arrived: the newest log row at or before it.

    Both sides travel together once; the running "last value" is a sliced scan, so neither a hot
    key nor a range join is in the way. Probes come after log rows of the same moment.
    """
    left = log.select(*keys, "us", F.lit(0).alias("__kind"), F.col("log_id").alias("__tie"), F.struct(F.col(value).alias("v")).alias("__v"))
    right = probes.select(*keys, "us", F.lit(1).alias("__kind"), F.col("probe_id").alias("__tie"), F.lit(None).alias("__v"))
    both = left.unionByName(right.withColumn("__v", F.col("__v").cast(left.schema["__v"].dataType)))
    seen = ordered_scan(both, keys, ["us", "__kind", "__tie"], slice_by, {"__held": ("running_last", "__v")})
    return seen.filter("__kind = 1").select(*keys, "us", F.col("__tie").alias("probe_id"), F.col("__held.v").alias(value))


def too_close(requests: DataFrame, keys: Sequence[str], min_gap_us: int, slice_seconds: int = 3600) -> DataFrame:
    """Requests that came sooner after the previous one of their source than the agreed delay."""
    seen = ordered_scan(requests, keys, ["us", "event_id"], time_slice("us", slice_seconds), {"before": ("lag", "us")})
    gap = F.col("us") - F.col("before")
    return seen.withColumn("gap_us", gap).filter(F.col("gap_us") < min_gap_us).drop("before")


def canonical_files(objects: DataFrame, key: str, owner: str) -> DataFrame:
    """One row per content hash with its number of citing owners (a hash is stored once however often it is cited)."""
    return objects.groupBy(key).agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias("first_owner"))


