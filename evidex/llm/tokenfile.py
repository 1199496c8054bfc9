"""Token files: ids of item descriptions as canonical, length-limited Huffman code in independent blocks.

The file format is a Parquet folder of blocks plus one of code lengths. A block holds whole items in ascending
order of their ids: the place of its first token among all tokens, the items with their numbers of tokens,
the code bits, and the bit offset of every 1024th token. A block can be decoded alone, and inside it all
checkpoints are decoded side by side, one table look-up a token and step.

Code lengths come from the counts of all tokens, at most as many numbers as the vocabulary has, by package
merge; they, and with them the table, have a bound that does not depend on the input. Items are dealt to
slices of the order of their ids, so the files are written in order by many tasks; where a slice starts is a
sum over the slices before. Ids are written once to the shared folder before they are counted, so texts are
encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.llm.order import _slice, boundaries
from evidex.session import shared_dir, stored

BLOCK_IDS, CHECK_IDS = 1 << 16, 1 << 10
#: Nothing else of this size is in a task that encodes, so its memo may be larger than the encoder's own choice.
MEMO_WORDS, BATCH_CHARS = 300_000, 250_000
#: Blocks that are decoded at once: about a million ids, whose arrays take some 40 bytes each.
READ_BLOCKS = 16
BLOCKS = "start long, n_ids long, item_ids array<long>, known array<boolean>, n_tokens array<int>, checks array<long>, bits binary"


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol (0: unused), least in total among codes of at most ``limit`` bits (package merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    limit = limit_of(len(used))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    taken: list[np.ndarray] = []  # per level, from the deepest: which of the sorted entries are symbols
    row = weights
    for level in range(limit):
        if level:
            pairs = row[:len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([weights, pairs])
            place = np.argsort(both, kind="stable")
            taken.append(place < len(weights))
            row = both[place]
        else:
            taken.append(np.ones(len(row), bool))
    n = 2 * len(used) - 2
    for symbols in reversed(taken):
        mine = int(symbols[:n].sum())
        out[order[:mine]] += 1
        n = 2 * (n - mine)
    return out


def limit_of(symbols: int) -> int:
    return max(12, int(symbols - 1).bit_length() + 2)


class Code:
    """The canonical code of given lengths: codes of equal length ascend with the symbols."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = int(self.lengths.max(initial=1))
        used = np.flatnonzero(self.lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        share = np.left_shift(1, self.width - self.lengths[order])
        first = np.cumsum(share) - share
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (first >> (self.width - self.lengths[order])).astype(np.uint64)
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.symbol[:share.sum()] = np.repeat(order, share)
        self.bits = np.ones(1 << self.width, np.int64)
        self.bits[:share.sum()] = np.repeat(self.lengths[order], share)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits, bit offset of every 1024th id)."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        at = end - size
        if not len(ids):
            return b"", at
        word = at >> 5
        value = self.codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = np.zeros(int(end[-1] >> 5) + 2, np.uint64)
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes()[:(int(end[-1]) + 7) // 8], at[::CHECK_IDS]

    def decode(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """The ids of blocks of (bits, checkpoints, number of ids), all checkpoints side by side."""
        data, at, left, base = [], [], [], 0
        for bits, checks, n in blocks:
            data.append(bits + bytes(4))
            at.append(np.asarray(checks, np.int64) + 8 * base)
            left.append(np.minimum(CHECK_IDS, n - CHECK_IDS * np.arange(len(checks))))
            base += len(bits) + 4
        raw = np.frombuffer(b"".join(data) + bytes(4), np.uint8).astype(np.uint32)
        window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
        at, left = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, left))
        out = np.zeros((len(at), CHECK_IDS), np.uint32)
        order = np.argsort(-left, kind="stable")
        at, left = at[order], left[order]
        live = np.searchsorted(-left, -np.arange(1, CHECK_IDS + 1), side="right")  # lanes with an id at each step
        for step in range(int(left[0]) if len(left) else 0):
            n = live[step]
            p = at[:n]
            code = (window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - self.width)
            out[order[:n], step] = self.symbol[code]
            p += self.bits[code]
        ids, lane = [], 0
        for _, checks, n in blocks:
            ids.append(out[lane:lane + len(checks)].reshape(-1)[:n])
            lane += len(checks)
        return ids


def write_token_files(items: DataFrame, tokenizer_path: str, end_id: int, path: str) -> None:
    """Encode every whole ``description``, add ``end_id`` to each item, and write the files to ``path``.

    Items stand in ascending ``item_id`` (null ids first, equal ids by their text); a null or empty description is its end id alone;
    repeated rows are all written; an empty table gives files without blocks. Other columns are not looked at.
    """
    from evidex.llm.bpe import encoder_of

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokenizer_path, memo_words=MEMO_WORDS, batch_chars=BATCH_CHARS)
        for batch in batches:
            ids = [np.append(x, end_id).astype("<u4") for x in encoder.encode_batch(batch["description"].tolist())]
            small = [x.astype("<u2") if x.max() < 1 << 16 else x for x in ids]
            yield pd.DataFrame({"item_id": batch["item_id"], "known": batch["known"], "ids": [x.tobytes() for x in small], "wide": [x.itemsize == 4 for x in small], "n": [len(x) for x in ids]})

    # A null id travels as a flag: a batch with nulls in it would hold whole numbers as floating ones.
    read = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(0)).alias("item_id"), F.col("item_id").isNotNull().alias("known"), F.col("description").cast("string"))
    made = read.mapInPandas(encode, "item_id long, known boolean, ids binary, wide boolean, n int")
    coded = stored(made.select(F.when(F.col("known"), F.col("item_id")).alias("item_id"), "ids", "wide", "n"), "token-ids")
    lengths = _lengths(coded)
    spark = items.sparkSession
    spark.createDataFrame([(k, int(v)) for k, v in enumerate(lengths) if v], "id int, bits int").write.parquet(f"{path}/code")

    bounds = boundaries(coded, "item_id")
    cut = coded.withColumn("slice", F.coalesce(_slice(F.col("item_id"), bounds), F.lit(0)).cast("int"))
    ordered = ["slice", "item_id", "ids"]
    totals = dict(cut.groupBy("slice").agg(F.sum("n")).collect())
    base, bases = 0, []
    for k in range(len(bounds) + 1):
        bases.append(base)
        base += totals.get(k, 0)
    shared = spark.sparkContext.broadcast((lengths, bases))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths, bases = shared.value
        code = Code(lengths)
        now, start = None, 0
        held: list[tuple] = []

        def block() -> pd.DataFrame:
            nonlocal start, held
            ids = np.concatenate([np.frombuffer(x, "<u4" if wide else "<u2") for _, x, wide, *_ in held])
            bits, checks = code.encode(ids)
            row = (start, len(ids), [int(r[0]) for r in held], [bool(r[4]) for r in held], [r[3] for r in held], checks, bits)
            start, held = start + len(ids), []
            return pd.DataFrame([row], columns=["start", "n_ids", "item_ids", "known", "n_tokens", "checks", "bits"])

        size = 0
        for batch in batches:
            for s, *row in zip(batch["slice"], batch["item_id"], batch["ids"], batch["wide"], batch["n"], batch["known"], strict=True):
                if s != now or size >= BLOCK_IDS:
                    if held:
                        yield block()
                    size = 0
                    if s != now:
                        now, start = s, bases[s]
                held.append(tuple(row))
                size += row[3]
        if held:
            yield block()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cut.repartitionByRange(n, "slice").sortWithinPartitions(*ordered)
    rows = sorted_.select("slice", F.coalesce("item_id", F.lit(0)).alias("item_id"), "ids", "wide", "n", F.col("item_id").isNotNull().alias("known"))
    rows.mapInPandas(pack, BLOCKS).write.parquet(f"{path}/blocks")


def _lengths(coded: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for wide, part in batch.groupby("wide"):
                own = np.bincount(np.frombuffer(b"".join(part["ids"]), "<u4" if wide else "<u2"))
                total = np.pad(total, (0, max(0, len(own) - len(total))))
                total[:len(own)] += own
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    counts = coded.select("ids", "wide").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    total[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return code_lengths(total)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, start, n_tokens, ids`` of every item in the files: its place among all tokens, and its ids as little-endian
    unsigned 32-bit integers."""
    rows = spark.read.schema("id int, bits int").parquet(f"{path}/code").collect()
    lengths = np.zeros(max((r[0] for r in rows), default=0) + 1, np.uint8)
    for k, bits in rows:
        lengths[k] = bits
    shared = spark.sparkContext.broadcast(lengths)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Code(shared.value)
        for batch in batches:
            for k in range(0, len(batch), READ_BLOCKS):
                part = batch.iloc[k:k + READ_BLOCKS]
                decoded = code.decode(list(zip(part["bits"], part["checks"], part["n_ids"], strict=True)))
                out: dict[str, list] = {c: [] for c in ("item_id", "start", "n_tokens", "ids")}
                for ids, start, items, known, sizes in zip(decoded, part["start"], part["item_ids"], part["known"], part["n_tokens"], strict=True):
                    at = 0
                    for item, there, n in zip(items.tolist(), known.tolist(), sizes.tolist(), strict=True):
                        for name, value in zip(out, (item if there else None, start + at, n, ids[at:at + n].astype("<u4").tobytes()), strict=True):
                            out[name].append(value)
                        at += n
                yield pd.DataFrame(out | {"item_id": pd.array(out["item_id"], "Int64")})

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInPandas(unpack, "item_id long, start long, n_tokens long, ids binary")


def token_file_folder(spark: SparkSession) -> str:
    return shared_dir(spark, "token-files")
