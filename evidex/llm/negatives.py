"""Hard negatives among measured readings, by threshold joins over inverted index blocks (in the manner of L2AP).

For each anchor the best readings of its own line are its positives, and just below each positive stands a window of
scores that readings of other lines may fall in. Both are threshold joins: readings that score at least ``t`` with an
anchor. The threshold starts where few are expected and is lowered, round by round, until the positives or the window
are full; a last round goes all the way down, so nothing is lost.

A task takes its readings in blocks and files each block by chunks of dimensions, heaviest first. A reading is filed
under its leading chunks only: the rest is omitted where its suffix norm alone cannot reach any threshold. Scores are
accumulated chunk by chunk; pairs whose partial score and remaining norms fall short are dropped, the few that are left
are finished one by one. A task keeps the first rows of each window only and raises its own threshold when they are full.

Readings are scanned where they are and never joined or moved. Anchors come in waves of bounded bytes, so what a wave
broadcasts and gets back does not grow with the table; the number of waves does.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.session import spread, stored

#: Bytes of anchors in a wave, readings in an index block, anchors scored at once, dimensions in a chunk.
WAVE_BYTES, BLOCK_ROWS, SIDE, CHUNK = 8 << 20, 8192, 512, 8
#: How many rows each round expects above its threshold; the last round has none.
EXPECTED = (64, 4096, None)
#: Rows of the sample that start thresholds are guessed from (results do not depend on it).
SAMPLE_ROWS = 512
_DENSE = 16


class BlockIndex:
    """Chunks of dimensions, each with the readings of a block that are filed under it."""

    def __init__(self, v: np.ndarray, reach: float):
        squares = np.add.reduceat(v * v, np.arange(0, v.shape[1], CHUNK), axis=1) if v.shape[1] else np.zeros((len(v), 1))
        rest = np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1])
        filed = (rest >= reach * (1 - 1e-9)).sum(axis=1)  # suffix norms only fall, so these are leading chunks
        self.order = np.argsort(-filed, kind="stable")
        self.v, self.rest = v[self.order], np.append(rest, np.zeros((len(v), 1)), axis=1)[self.order]
        self.counts = [int(x) for x in np.searchsorted(-filed[self.order], -np.arange(1, rest.shape[1] + 1), side="right")] + [0]

    def at_least(self, q: np.ndarray, q_rest: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, reading, score) of every pair with a score of at least the anchor's threshold."""
        score = np.zeros((len(q), self.counts[0]))
        found = []
        live = self.counts[0]
        for c in range(len(self.counts) - 1):
            if not live:
                break
            span = slice(c * CHUNK, (c + 1) * CHUNK)
            score[:, :live] += q[:, span] @ self.v[:live, span].T
            stay = self.counts[c + 1]
            hope = score[:, :live] + q_rest[:, c + 1, None] * self.rest[None, :live, c + 1] * (1 + 1e-9) + 1e-6 >= t[:, None]
            if stay and _DENSE * int(np.count_nonzero(hope[:, :stay])) < hope[:, :stay].size:
                stay = 0
            i, j = np.nonzero(hope[:, stay:])
            found.append(self._finished(q, q_rest, t, i, j + stay, score[i, j + stay], c + 1))
            live = stay
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)

    def _finished(self, q, q_rest, t, i, j, score, c):
        """The rest of the score of pairs whose first ``c`` chunks are known, dropping them as soon as they fall short."""
        while c * CHUNK < q.shape[1] and len(i):
            span = slice(c * CHUNK, (c + 1) * CHUNK)
            score = score + np.einsum("ij,ij->i", q[i, span], self.v[j, span])
            c += 1
            keep = score + q_rest[i, c] * self.rest[j, c] * (1 + 1e-9) + 1e-6 >= t[i]
            i, j, score = i[keep], j[keep], score[keep]
        keep = score >= t[i]
        return i[keep], self.order[j[keep]], score[keep]


def _rest(q: np.ndarray) -> np.ndarray:
    squares = np.add.reduceat(q * q, np.arange(0, q.shape[1], CHUNK), axis=1) if q.shape[1] else np.zeros((len(q), 1))
    return np.append(np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]), np.zeros((len(q), 1)), axis=1)


class _First:
    """The first ``k`` rows of each window: falling score, then rising id."""

    def __init__(self, k: int, windows: int):
        self.k, self.windows = k, windows
        self.window, self.score, self.item = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, window: np.ndarray, score: np.ndarray, item: np.ndarray) -> None:
        window, score, item = (np.concatenate(x) for x in ((self.window, window), (self.score, score), (self.item, item)))
        order = np.lexsort((item, -score, window))
        window, score, item = window[order], score[order], item[order]
        head = np.flatnonzero(np.diff(window, prepend=-1))
        keep = np.arange(len(window)) - np.repeat(head, np.diff(np.append(head, len(window)))) < self.k
        self.window, self.score, self.item = window[keep], score[keep], item[keep]

    def full_from(self) -> np.ndarray:
        """Per window the score of its last row if it is full, else minus infinity."""
        out = np.full(self.windows, -np.inf)
        count = np.bincount(self.window, minlength=self.windows)
        np.minimum.at(least := np.full(self.windows, np.inf), self.window, self.score)
        out[count >= self.k] = least[count >= self.k]
        return out


def _blocks(batches: Iterator[pa.RecordBatch], order: np.ndarray, lines: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, line numbers or -1, vectors in the order of dimensions) in blocks; short vectors end in zeros."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            yield _block(held, order, lines)
            held = []
    if held:
        yield _block(held, order, lines)


def _block(held, order, lines):
    table = pa.Table.from_batches(held).combine_chunks()
    coded = pa.concat_arrays(table.column("line").chunks).dictionary_encode()
    known = np.array([lines.get(x, -1) for x in coded.dictionary.to_pylist()], np.int64)
    return table.column("item_id").to_numpy(), known[coded.indices.to_numpy()], _matrix(table.column("lab"), order)


def _matrix(lists: pa.ChunkedArray, order: np.ndarray) -> np.ndarray:
    lists = pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    v = np.zeros((len(sizes), len(order)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    v[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return v[:, order]


def _search(order, lines, q, line, ids, t, windows, k):
    """A step over readings: the first ``k`` of each window with a score of at least ``t`` of its anchor.

    Without ``windows`` there is one per anchor, of readings of its own line; else they are (anchor, low, high) and take those of other lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_anchor, low, high = windows if windows is not None else (np.arange(len(q)), None, None)
        first, floor, rest, norm = _First(k, len(w_anchor)), t.astype(float), _rest(q), np.sqrt((q * q).sum(axis=1))
        slots = int(np.bincount(w_anchor).max(initial=0))
        by_anchor = np.full((len(q), slots), -1, np.int64)
        nth = np.arange(len(w_anchor)) - np.searchsorted(w_anchor, w_anchor)
        by_anchor[w_anchor, nth] = np.arange(len(w_anchor))
        top = np.full(len(q), -np.inf)
        if high is not None:
            np.maximum.at(top, w_anchor, high)
        for item, own, v in _blocks(batches, order, lines):
            kinds = np.intersect1d(own, line) if windows is None else [None]
            for kind in kinds:
                rows = np.arange(len(item)) if kind is None else np.flatnonzero(own == kind)
                mine = np.arange(len(q)) if kind is None else np.flatnonzero(line == kind)
                for a in range(0, len(mine), SIDE):
                    part = mine[a:a + SIDE]
                    reach = float(np.min(floor[part] / np.maximum(norm[part], 1e-300)))
                    i, j, score = BlockIndex(v[rows], reach).at_least(q[part], rest[part], floor[part])
                    i, j = part[i], rows[j]
                    if windows is None:
                        keep = item[j] != ids[i]
                        first.add(i[keep], score[keep], item[j[keep]])
                    else:
                        keep = (own[j] != line[i]) & (score <= top[i])
                        i, j, score = i[keep], j[keep], score[keep]
                        for slot in range(slots):
                            w = by_anchor[i, slot]
                            inside = (w >= 0) & (score >= low[w]) & (score <= high[w])
                            first.add(w[inside], score[inside], item[j[inside]])
            full = first.full_from()
            bound = np.maximum(full, floor[w_anchor] if low is None else np.maximum(low, floor[w_anchor]))
            least = np.full(len(q), np.inf)
            np.minimum.at(least, w_anchor, bound)
            floor = np.where(np.isfinite(least), np.maximum(floor, least), floor)
        if len(first.window):
            yield pa.RecordBatch.from_arrays([pa.array(first.window), pa.array(first.score.astype(np.int64)), pa.array(first.item)], names=["w", "score", "item_id"])

    return run


def _round(readings: DataFrame, k: int, step) -> DataFrame:
    found = readings.select("item_id", "line", "lab").mapInArrow(step, "w long, score long, item_id long")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "item_id"))).filter(F.col("rank") <= k)


def _valid(readings: DataFrame, scale: int) -> DataFrame:
    rows = readings.select(F.col("item_id").cast("long").alias("item_id"), F.col("line").cast("string").alias("line"), F.col("lab").cast("array<double>").alias("x"), F.coalesce("anchor", F.lit(False)).alias("anchor"))
    good = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = rows.filter(F.col("item_id").isNotNull() & F.col("line").isNotNull() & F.col("x").isNotNull() & good)
    whole = spread(rows, "item_id").select("item_id", F.struct("line", F.transform("x", lambda c: F.floor(c * scale)).alias("lab"), "anchor").alias("r"))
    return whole.groupBy("item_id").agg(F.min("r").alias("r")).select("item_id", "r.*")


def hard_negatives(readings: DataFrame, scale: int = 256, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: readings of other lines that score nearly as a positive.

    ``readings`` has ``item_id``, ``line`` (its class), ``lab`` (its measured numbers, of any length; the shorter of two ends in zeros) and ``anchor``
    (true for readings that are asked for). Each number becomes ``floor(scale * x)``; a score is the whole inner product. Higher scores
    come first, ties by smaller id. An anchor's positives are its first ``positives`` other readings of its line; for each of them the first
    ``negatives`` readings of other lines are returned whose score is ``low_percent`` to ``high_percent`` of the positive's.

    A null id, line, vector or component, or one that is not finite, takes its row out. Of rows that repeat an id the least (by line, numbers)
    counts. An anchor without positives, or none in a window, has no rows; an empty table has none. Numbers so large that scores would
    pass 2^53 raise an error. Other columns are not looked at.
    """
    spark = readings.sparkSession
    rows = stored(_valid(readings, scale), "readings")
    size, large = rows.agg(F.max(F.size("lab")), F.max(F.greatest(F.array_max("lab"), -F.array_min("lab")).cast("double"))).first()
    size, large = size or 0, large or 0
    if size * large * large >= 2**53:
        raise ValueError("readings are too large for whole scores below 2^53")
    lines = rows.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    anchors = rows.filter("anchor").join(lines, "line")
    waves = -(-(anchors.count() * max(size, 1) * 8) // WAVE_BYTES)
    anchors = stored(anchors.withColumn("wave", F.pmod(F.xxhash64("item_id"), F.lit(max(waves, 1)))), "anchors")
    total = rows.count()
    sample = rows.orderBy(F.xxhash64(F.lit(1), "item_id"), "item_id").limit(SAMPLE_ROWS).select("lab").toArrow()
    plain = np.arange(size)
    drawn = _matrix(sample.column("lab"), plain) if sample.num_rows else np.zeros((0, size))
    order = np.argsort(-(drawn * drawn).sum(axis=0), kind="stable") if len(drawn) else plain
    out = None
    for wave in range(waves):
        table = anchors.filter(F.col("wave") == wave).orderBy("item_id").select("item_id", "line", "lab", "n").toArrow()
        if table.num_rows:
            found = _mined(rows, table, order, drawn[:, order], total, positives, negatives, low_percent, high_percent)
            out = found if out is None else out.unionByName(found)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], schema) if out is None else out


def _mined(rows, table, order, drawn, total, positives, negatives, low_percent, high_percent) -> DataFrame:
    """One wave of anchors; all that is gathered here is bounded by the wave."""
    ids, n_line = table.column("item_id").to_numpy(), table.column("n").to_numpy()
    names = sorted(set(table.column("line").to_pylist()))
    lines = {x: k for k, x in enumerate(names)}
    line = np.array([lines[x] for x in table.column("line").to_pylist()])
    q = _matrix(table.column("lab"), order)
    guess = drawn @ q.T if len(drawn) else np.zeros((1, len(q)))
    mean, deviation = guess.mean(axis=0), guess.std(axis=0) + 1e-9
    normal = NormalDist()

    best = {}
    open_ = np.flatnonzero(n_line > 1)
    for expected in EXPECTED:
        if not len(open_):
            break
        share = np.full(len(open_), 1.0) if expected is None else np.minimum(1.0, expected / np.maximum(n_line[open_] - 1, 1))
        t = np.array([-np.inf if s >= 1 else m + sd * normal.inv_cdf(1 - max(s, 1e-15)) for s, m, sd in zip(share, mean[open_], deviation[open_], strict=True)])
        got = _round(rows, positives, _search(order, lines, q[open_], line[open_], ids[open_], t, None, positives)).toPandas()
        enough = np.minimum(positives, n_line[open_] - 1)
        counts = np.bincount(got["w"], minlength=len(open_))
        for w, part in got.groupby("w"):
            if counts[w] >= enough[w] or t[w] == -np.inf:
                best[int(open_[w])] = part.sort_values("rank")[["item_id", "score"]].to_numpy().tolist()
        open_ = open_[(counts < enough) & (t > -np.inf)]

    windows = [(a, item, p, -(-low_percent * p // 100), high_percent * p // 100) for a, found in sorted(best.items()) for item, p in found if low_percent * p <= high_percent * p]
    done = []
    for expected in EXPECTED:
        if not windows:
            break
        anchor, high = (np.array([w[k] for w in windows]) for k in (0, 4))
        low = np.array([w[3] for w in windows], float)
        used, at = np.unique(anchor, return_inverse=True)
        t = np.full(len(used), np.inf)
        np.minimum.at(t, at, [w if expected is None else max(w, m + s * normal.inv_cdf(1 - min(1 - 1e-12, max(1e-15, 1 - normal.cdf((h - m) / s)) + expected / total)))
                              for w, h, m, s in zip(low, high, mean[anchor], deviation[anchor], strict=True)])
        step = _search(order, lines, q[used], line[used], ids[used], t, (at, low, high.astype(float)), negatives)
        found = stored(_round(rows, negatives, step), "negatives")
        counts = np.bincount([r[0] for r in found.filter(F.col("rank") == negatives).select("w").collect()], minlength=len(windows))
        closed = (counts > 0) | (t[at] <= low)
        kept = rows.sparkSession.createDataFrame([(k, int(ids[w[0]]), int(w[1]), int(w[2])) for k, w in enumerate(windows) if closed[k]], "w long, anchor_id long, positive_id long, positive_score long")
        done.append(found.join(F.broadcast(kept), "w").select("anchor_id", "positive_id", "rank", F.col("item_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
        windows = [w for k, w in enumerate(windows) if not closed[k]]
    out = done[0] if done else rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    for more in done[1:]:
        out = out.unionByName(more)
    return out
