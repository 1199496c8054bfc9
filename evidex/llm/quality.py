"""Quality classifier for item descriptions: supervised subword embeddings.

Every word, every pair of neighbouring words (a word beside itself is one pair, whatever the word) and
every run of three to five bytes of a word, borders included, is hashed to a learned vector; a description is the average of its vectors, and a softmax layer gives the chance that it is
accepted. Vectors and layer are trained together by plain stochastic gradient descent in numpy, in one
task, on a bounded sample of reviewed items (``sample_rows``). The layer is linear, so the fitted model
is stored as one number a bucket and scoring is one average of looked-up numbers over the whole text.

The model (one megabyte, whatever the input) is broadcast; scoring has no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.packed import as_bytes
from evidex.llm.words import BASES, Powers, mix

BUCKET_BITS, DIM, GRAMS = 18, 16, (3, 4, 5)
#: Bytes of text that are looked up at once; bounds a task's memory for very long texts.
_CHUNK = 4 << 20
_POWERS = Powers(BASES[1])
_VALUES = np.random.default_rng(20260102).integers(0, 2**64, 256, dtype=np.uint64)


def buckets(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of all words and word parts of a text, in pieces cut at word borders."""
    for piece in _pieces(data.split()):
        raw = np.frombuffer(b" " + b" ".join(piece) + b" ", np.uint8)
        space = np.flatnonzero(raw == 0x20)
        prefix = _POWERS.prefix(_VALUES[raw])
        words = _POWERS.spans(prefix, space[:-1], space[1:] + 1)
        pairs = np.where(words[1:] == words[:-1], np.uint64(2), mix(words[:-1]) + words[1:])
        found = [words ^ np.uint64(1), pairs]
        following = np.append(space, len(raw))[np.searchsorted(space, np.arange(1, len(raw) + 1))]
        for n in GRAMS:
            at = np.arange(len(raw) - n + 1) if len(raw) >= n else np.zeros(0, np.int64)
            at = at[following[at] >= at + n - 1]  # no border inside
            found.append(_POWERS.spans(prefix, at, at + n) + np.uint64(n))
        yield (mix(np.concatenate(found)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _pieces(words: list[bytes]) -> Iterator[list[bytes]]:
    first, held = 0, 0
    for k, word in enumerate(words):
        held += len(word) + 1
        if held >= _CHUNK:
            yield words[first:k + 1]
            first, held = k + 1, 0
    if first < len(words):
        yield words[first:]


def fit(features: list[tuple[np.ndarray, np.ndarray]], accepted: np.ndarray, epochs: int = 5, rate: float = 1.5, seed: int = 1) -> tuple[np.ndarray, float]:
    """(number a bucket, bias) of the difference of the two softmax inputs.

    ``features`` has (buckets, weights that sum to one) per item. One step per item, in a fresh order each
    epoch, the rate falling to zero. Without items, or of one class only, the bias alone answers.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    share = float(np.clip(np.mean(accepted), 0.001, 0.999)) if len(accepted) else 0.5
    bias[1] = np.log(share / (1 - share))
    if len(set(accepted.tolist())) == 2:
        steps, done = epochs * len(features), 0
        for _ in range(epochs):
            for k in rng.permutation(len(features)):
                at, weight = features[k]
                hidden = weight @ vectors[at]
                z = layer @ hidden + bias
                p = np.exp(z - z.max())
                error = p / p.sum()
                error[accepted[k]] -= 1
                now = rate * (1 - done / steps)
                back = error @ layer
                layer -= now * np.outer(error, hidden)
                bias -= 0.05 * now * error
                if len(at):
                    vectors[at] -= now * np.outer(weight * min(len(at), 50), back)
                done += 1
    return (vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def train(items: DataFrame, reviews: DataFrame, sample_rows: int = 3000) -> tuple[np.ndarray, float]:
    """Fit on the descriptions of at most ``sample_rows`` reviewed items, chosen by a hash of their ids.

    ``reviews`` has ``item_id`` and ``accepted`` (0 or 1). Reviews with a null in either are ignored; an item
    reviewed twice counts once, with the lower mark. The sample is a stated parameter: its size bounds the
    one task that fits, whatever the number of reviews.
    """
    marks = reviews.filter("item_id is not null and accepted in (0, 1)").groupBy("item_id").agg(F.min("accepted").cast("int").alias("accepted"))
    chosen = marks.orderBy(F.xxhash64("item_id"), "item_id").limit(sample_rows).collect()
    spark = items.sparkSession
    sample = F.broadcast(spark.createDataFrame([(int(r[0]), int(r[1])) for r in chosen], "item_id long, accepted int"))
    texts = items.select(F.col("item_id").cast("long"), as_bytes().alias("b")).join(sample, "item_id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch["b"]:
                total = np.zeros(1 << BUCKET_BITS, np.int64)
                for part in buckets(bytes(data)):
                    total += np.bincount(part, minlength=1 << BUCKET_BITS)
                at = np.flatnonzero(total)
                rows.append((at.astype(np.int32), (total[at] / max(total.sum(), 1)).astype(np.float32)))
            yield pd.DataFrame({"item_id": batch["item_id"], "accepted": batch["accepted"], "at": [r[0] for r in rows], "weight": [r[1] for r in rows]})

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item_id", kind="stable").drop_duplicates("item_id")
        table, bias = fit(list(zip(rows["at"].map(np.asarray), rows["weight"].map(np.asarray), strict=True)), rows["accepted"].to_numpy())
        return pd.DataFrame({"numbers": [table.tobytes()], "bias": [bias]})

    counted = texts.mapInPandas(count, "item_id long, accepted int, at array<int>, weight array<float>")
    model = counted.groupBy(F.lit(1).alias("all")).applyInPandas(lambda rows: learn(rows), "numbers binary, bias double").first()
    if model is None:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    return np.frombuffer(bytes(model["numbers"]), np.float32), model["bias"]


def score_items(items: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """All columns of ``items`` and ``score``: the chance, 0 to 1, that the ``description`` is accepted.

    Only the description is looked at, whole. A null, empty or blank one gets the score of the bias. Repeated
    rows get equal scores. A column ``score`` that ``items`` has already is replaced.
    """
    shared = items.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, bias = shared.value
        for batch in batches:
            out = np.zeros(len(batch))
            for k, data in enumerate(batch):
                total, n = 0.0, 0
                for part in buckets(bytes(data)):
                    total += float(table[part].sum(dtype=np.float64))
                    n += len(part)
                out[k] = total / max(n, 1) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -500, 500))))

    return items.withColumn("score", score(as_bytes()))
