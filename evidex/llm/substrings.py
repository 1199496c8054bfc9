"""Passages repeated across item descriptions, found by level-wise doubling.

Windows of 13, 25 and 50 words (each twice the one before, joined words shared) are hashed. A window of
the asked length is represented at a shorter length by the least hash inside it, so equal windows have
equal representatives. At each level, hashes that occur in one item alone are dropped, and with them
every window they represent; only what is repeated is extended to the next length, until the asked length
is reached or nothing is left. At the last level a window is repeated if its own hash and that of its
representative (128 bits together) also start in an item with a smaller id.

Items with the same word sequence are one class, and only its first item takes part. Each level is one
combinable minimum and maximum per hash and one join back; a passage that a third of all items share
costs one partial row a task in the first and is split by skew handling in the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.packed import as_bytes, packed, unpacker
from evidex.llm.words import run_hashes, window_minima, word_hashes
from evidex.session import stored


def levels(window: int) -> list[int]:
    """Window lengths from about a quarter of the asked one to it; each is at most twice the one before."""
    out = [window]
    while len(out) < 3 and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _representatives(words: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``length`` words, for each window the place of its representative)."""
    hashes = run_hashes(words, length)
    return hashes, window_minima(hashes, window - length + 1)


def _klass(data: bytes) -> str:
    return hashlib.sha256(b" ".join(data.split())).hexdigest()


def _scan(items: DataFrame, window: int) -> DataFrame:
    """Per item: its class, number of words and the hashes that stand for its windows at the first level."""
    first = levels(window)[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch["b"]:
                words = word_hashes(bytes(data))[0]
                hashes, place = _representatives(words, window, first)
                out.append((_klass(bytes(data)), len(words), np.unique(hashes[np.unique(place)]).view(np.int64)))
            yield pd.DataFrame({"item_id": batch["item_id"], "klass": [x[0] for x in out], "n_words": [x[1] for x in out], "seeds": [x[2] for x in out]})

    return items.select("item_id", as_bytes().alias("b")).mapInPandas(run, "item_id long, klass string, n_words long, seeds array<long>")


def _shared(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur in more than one item, with the least item."""
    return (rows.groupBy(*key).agg(F.min("item_id").alias("first"), F.max("item_id").alias("last"))
            .filter("first < last").select(*key, "first"))


def repeated_passages(items: DataFrame, window: int = 50) -> DataFrame:
    """``item_id, klass, starts``: starts (word numbers) of windows that also start in an item with a smaller id.

    One row per distinct word sequence, that of its least item id, and only where there are such windows.
    Words are runs of characters other than blank and tab to carriage return. Null texts have no words; a
    row without an id neither loses nor causes anything.
    """
    items = items.select(F.col("item_id").cast("long"), "description").filter("item_id is not null")
    return _passages(items, stored(_scan(items, window), "scan"), window)


def _passages(items: DataFrame, scan: DataFrame, window: int) -> DataFrame:
    small, middle, _ = ([1] * 3 + levels(window))[-3:]
    heads = scan.filter(F.size("seeds") > 0).groupBy("klass").agg(F.min("item_id").alias("item_id"))
    seeds = scan.join(heads, ["klass", "item_id"]).select("klass", "item_id", F.explode("seeds").alias("h"))
    alive = (seeds.join(_shared(seeds.select("h", "item_id"), "h"), "h").groupBy("item_id")
             .agg(F.collect_set("h").alias("alive"), F.sort_array(F.collect_set("klass")).alias("klasses")))

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = unpacker()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("item_id", "tag", "h", "starts", "a")}
            for item, z, alive, klasses in zip(batch["item_id"], batch["z"], batch["alive"], batch["klasses"], strict=True):
                data = unpack(z)
                tag = {k: n for n, k in enumerate(klasses)}.get(_klass(data))
                if tag is None:
                    continue
                words = word_hashes(data)[0]
                hashes, place = _representatives(words, window, small)
                known = np.sort(np.asarray(alive, np.int64))
                mine = hashes[place].view(np.int64)
                starts = np.flatnonzero(known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine)
                hashes, place = _representatives(words, window, middle)
                whole = run_hashes(words, window, 2)[starts].view(np.int64)
                # Places never fall back from one window to the next, so windows of one representative are a run.
                rep = place[starts]
                edge = np.append(np.flatnonzero(np.diff(rep, prepend=-1)), len(rep))
                for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    for name, value in zip(out, (item, tag, int(hashes[rep[x]].view(np.int64)), starts[x:y].astype(np.int32), whole[x:y]), strict=True):
                        out[name].append(value)
            yield pd.DataFrame(out)

    grown = stored(packed(items).join(alive, "item_id").mapInPandas(extend, "item_id long, tag int, h long, starts array<int>, a array<long>"), "grown")
    doubled = grown.join(_shared(grown.select("h", "item_id"), "h").select("h"), "h")
    windows = doubled.select("item_id", "tag", "h", F.inline(F.arrays_zip("starts", "a")))
    final = windows.join(_shared(windows.select("h", "a", "item_id"), "h", "a"), ["h", "a"]).filter("item_id > first")
    starts = final.groupBy("item_id", "tag").agg(F.sort_array(F.collect_set("starts")).alias("starts"))
    return starts.join(alive.select("item_id", "klasses"), "item_id").select("item_id", F.get("klasses", F.col("tag")).alias("klass"), "starts")


def strip_repeated_passages(items: DataFrame, window: int = 50) -> DataFrame:
    """``item_id, description, n_words, n_removed``: descriptions without words inside repeated windows.

    A word goes if a window of ``window`` consecutive words that covers it has the same words as a window of
    an item with a smaller id; windows are judged on the given texts. What is left is joined by one blank. A
    null or empty text gives an empty one. Every row is answered: repeated rows alike; rows of one id do not
    affect each other; a row without an id stays whole. Other columns of ``items`` are not looked at.
    """
    items = items.select(F.col("item_id").cast("long"), "description")
    scan = stored(_scan(items.filter("item_id is not null"), window), "scan")
    heads = scan.groupBy("klass").agg(F.min("item_id").alias("head"))
    verdict = scan.select("item_id", "klass", "n_words").distinct().join(heads, "klass").filter((F.col("n_words") >= window) | (F.col("item_id") == F.col("head")))
    spans = _passages(items.filter("item_id is not null"), scan, window)
    # A later copy of a whole text is covered everywhere; a first copy loses what its passages cover.
    whole = verdict.filter("item_id > head").select("item_id", "klass", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    cuts = whole.union(spans.select("item_id", "klass", "starts", F.lit(False))).groupBy("item_id").agg(F.collect_list(F.struct("klass", "starts", "whole")).alias("cuts"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = unpacker()
        for batch in batches:
            texts, counts, gone = [], [], []
            for z, cuts in zip(batch["z"], batch["cuts"], strict=True):
                data = unpack(z)
                words = data.split()
                keep = np.ones(len(words), bool)
                klass = _klass(data) if cuts is not None and len(cuts) else None
                for c in cuts if klass else ():
                    if c["klass"] == klass:
                        if c["whole"]:
                            keep[:] = False
                        else:
                            edge = np.zeros(len(words) + 1, np.int64)
                            starts = np.asarray(c["starts"], np.int64)
                            np.add.at(edge, starts, 1)
                            np.add.at(edge, starts + window, -1)
                            keep &= np.cumsum(edge)[:-1] == 0
                texts.append(b" ".join(words if keep.all() else [w for w, k in zip(words, keep, strict=True) if k]).decode("utf-8"))
                counts.append(len(words))
                gone.append(int(len(words) - keep.sum()))
            yield pd.DataFrame({"item_id": batch["item_id"], "description": texts, "n_words": counts, "n_removed": gone})

    return packed(items).join(cuts, "item_id", "left").mapInPandas(cut, "item_id long, description string, n_words long, n_removed long")
