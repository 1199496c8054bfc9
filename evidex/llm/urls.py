"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Rules name a host and a path; the longest that fits decides. All other URLs are judged by a model fitted in numpy
on a small labelled table (``MAX_EXAMPLES`` rows at most, checked). Equal (host, path) pairs are judged once. The
rules are joined on every suffix of the host, so their number may grow; the model has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.words import BASES, Powers, mix
from evidex.session import spread

BUCKET_BITS, GRAMS, MAX_EXAMPLES = 14, (3, 4, 5), 10_000
_POWERS = Powers(BASES[2])


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; empty without it or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def grams(host: str, path: str) -> np.ndarray:
    """Buckets of the character n-grams of host and path, each with its borders; the two are told apart."""
    out = [np.zeros(0, np.int64)]
    for kind, text in ((1, host), (2, path)):
        raw = np.frombuffer(b"\x02" + text.encode("utf-8", "surrogatepass") + b"\x03", np.uint8).astype(np.uint64) + np.uint64(7)
        prefix = _POWERS.prefix(mix(raw * np.uint64(BASES[0])))
        for n in GRAMS:
            at = np.arange(max(0, len(raw) - n + 1))
            out.append((mix(_POWERS.spans(prefix, at, at + n) + np.uint64(16 * kind + n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return np.concatenate(out)


def fit(examples: list[tuple[str, str, int]], epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of the chance that a URL is unwanted, by gradient steps over (host, path, 0 or 1).

    Grams of one URL share its step equally. The classes weigh alike. Without examples everything is wanted.
    """
    weights, bias = np.zeros(1 << BUCKET_BITS), 0.0
    rows = [(np.unique(grams(h, p)), y) for h, p, y in sorted(examples)]
    share = sum(y for _, y in rows) / max(len(rows), 1)
    if not 0 < share < 1:
        return weights, 10.0 if share else -10.0
    rng = np.random.default_rng(3)
    for epoch in range(epochs):
        for k in rng.permutation(len(rows)):
            at, y = rows[k]
            scale = 1 / np.sqrt(len(at))
            p = 1 / (1 + np.exp(-(weights[at].sum() * scale + bias)))
            step = rate / (1 + epoch / 10) * (y - p) * (0.5 / share if y else 0.5 / (1 - share))
            weights[at] = weights[at] * (1 - decay) + step * scale
            bias += 0.1 * step
    return weights, bias


def judge_urls(snapshots: DataFrame, rules: DataFrame, examples: DataFrame, threshold: float = 0.5) -> DataFrame:
    """All rows of ``snapshots`` as ``snapshot_id, host, path, rule, score, verdict``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (``block`` or ``allow``); a rule fits its host and all subdomains if the path
    starts with the rule's. The longest fitting rule decides (ties: the lesser text). ``examples`` has ``url`` and
    ``unwanted`` (0 or 1). ``score`` is the model's chance that the URL is unwanted; it decides where no rule fits.
    A host with a port is a host of its own: rules do not fit it. A null url, or one without ``://``, has an empty host and path and is judged so. Null rules and examples are ignored.
    Repeated rows are answered each. Other columns are not looked at.
    """
    labelled = examples.filter("url is not null and unwanted in (0, 1)").select(host_of(F.col("url")), path_of(F.col("url")), F.col("unwanted").cast("int"))
    rows = labelled.limit(MAX_EXAMPLES + 1).collect()
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"more than {MAX_EXAMPLES} examples")
    shared = snapshots.sparkSession.sparkContext.broadcast(fit([tuple(r) for r in rows]))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        for hosts, paths in batches:
            total = []
            for h, p in zip(hosts, paths, strict=True):
                at = np.unique(grams(h, p))
                total.append(weights[at].sum() / np.sqrt(max(len(at), 1)) + bias)
            yield pd.Series(1 / (1 + np.exp(-np.array(total, float))))

    pages = snapshots.select("snapshot_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    distinct = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    # Only suffixes of as many labels as a rule can have; a host of very many labels has no more.
    most = rules.filter("host is not null").agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    suffixes = F.transform(F.sequence(F.greatest(F.size(labels) - most + 1, F.lit(1)), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    filed = rules.filter("host is not null and path is not null and verdict is not null").select(
        F.col("host").alias("suffix"), F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("by_rule"))
    fits = distinct.select("host", "path", F.explode(suffixes).alias("suffix")).join(filed, "suffix").filter(F.startswith("path", "rule_path"))
    chosen = fits.groupBy("host", "path").agg(F.min_by(F.struct("rule", "by_rule"), F.struct(-F.length("rule"), "rule", "by_rule")).alias("hit"))
    # Small shuffles are merged to few tasks; the Python step takes all. (Dealt by the join's own keys, the rows would stay where they are.)
    scored = spread(distinct.join(chosen, ["host", "path"], "left"), F.xxhash64("path", "host")).withColumn("score", score("host", "path"))
    verdict = F.coalesce(F.col("hit.by_rule"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    judged = scored.select("host", "path", F.col("hit.rule").alias("rule"), "score", verdict.alias("verdict"))
    return pages.join(judged, ["host", "path"]).select("snapshot_id", "host", "path", "rule", "score", "verdict")
