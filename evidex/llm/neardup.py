"""Near-duplicate item descriptions by HyperMinHash.

A description's set of word shingles is hashed into 128 buckets; each bucket keeps, of its least hash,
the number of leading zeros and ten mantissa bits (16 bits in all; an empty bucket borrows from another
one, chosen by fixed probes). Bands of four registers find candidates: at a similarity of 0.8 a pair
shares none of the 32 bands once in 20 million pairs. The share of equal registers, corrected for
registers that are equal by chance, drops pairs that are four standard errors too low (a pair at the
threshold is lost once in 30,000); the others are confirmed on their full sets.

No bucket is expanded into rows of pairs. Equal sets are one class. Each class is first confirmed against
the least member of the bucket it shares most bands with. Buckets whose members are then still in
different components are cut into blocks of bounded size (the largest component's members are never set
against each other), registers are compared inside the blocks, and only pairs that may be similar come
out: first the best one of each member, then, after new components, all that are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.components import components
from evidex.llm.packed import as_bytes, packed, unpacker
from evidex.llm.words import mix, shingles
from evidex.session import stored

BUCKET_BITS, MANTISSA_BITS, BANDS = 7, 10, 32
#: Buckets of the finer sketch that members of shared buckets are compared by, and the mark of an empty bucket.
FINE_BITS, EMPTY = 9, 0xFFFF
BUCKETS = 1 << BUCKET_BITS
#: Standard errors by which an estimate may miss the threshold, and rows of one side of a block.
_ERRORS, BLOCK_ROWS = 4, 2048
#: Where an empty bucket looks, in turn.
_PROBES = np.random.default_rng(7).integers(0, BUCKETS, (BUCKETS, 64))


def registers(sorted_hashes: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    """One 16-bit register per bucket of an ascending array of hashes; ``EMPTY`` where a bucket has none."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    first = np.searchsorted(sorted_hashes, edges)
    filled = np.diff(np.append(first, len(sorted_hashes))) > 0
    rest = sorted_hashes[np.minimum(first, len(sorted_hashes) - 1)] << np.uint64(bits)
    zeros = 64 - np.frexp(rest.astype(np.float64))[1]
    mantissa = (rest << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out = (zeros.astype(np.uint64) << np.uint64(MANTISSA_BITS)) | mantissa
    return np.where(filled, out, EMPTY).astype(np.uint16)


def densified(regs: np.ndarray) -> np.ndarray:
    """The registers with every empty one borrowed from a filled one."""
    filled, source = regs != EMPTY, np.arange(BUCKETS)
    empty = np.flatnonzero(~filled)
    for k in range(_PROBES.shape[1]):
        if not len(empty):
            break
        source[empty] = _PROBES[empty, k]
        empty = empty[~filled[source[empty]]]
    if len(empty):  # few elements: the next filled bucket
        own = np.flatnonzero(filled)
        source[empty] = own[np.searchsorted(own, empty) % len(own)]
    return regs[source]


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of the registers."""
    return band_keys_of(np.tile(regs, (BANDS, 1)), np.arange(BANDS))


def band_keys_of(regs: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The key of one band of each row of registers."""
    chosen = regs.reshape(len(regs), BANDS, -1)[np.arange(len(regs)), band].astype(np.uint64)
    key = (band + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(chosen.shape[1]):
        key = mix(key ^ chosen[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(key).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate: the share of equal registers less what chance makes equal.

    Two independent registers agree when their zeros do (about a third of the time for sets of like size,
    and then with one chance in 2^10 for the mantissa).
    """
    chance = 1 / (3 << MANTISSA_BITS)
    return max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance))


def _sketch(items: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch["b"]:
                own = shingles(bytes(data), size)
                empty = len(own) == 0
                rows.append((None if empty else hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest(), len(own), None if empty else densified(registers(own)).tobytes()))
            yield pd.DataFrame({"item_id": batch["item_id"], **dict(zip(("klass", "n_shingles", "regs"), zip(*rows, strict=True), strict=True))} if rows else {"item_id": [], "klass": [], "n_shingles": [], "regs": []})

    return items.select("item_id", as_bytes().alias("b")).mapInPandas(run, "item_id long, klass string, n_shingles long, regs binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = unpacker()
        memo: dict[int, np.ndarray] = {}
        held = 0

        def full(node: int, z: bytes) -> np.ndarray:
            nonlocal held
            if node not in memo:
                if held > 4_000_000:
                    memo.clear()
                    held = 0
                memo[node] = shingles(unpack(z), size)
                held += len(memo[node])
            return memo[node]

        for batch in batches:
            good = []
            for a, b, ra, rb, na, nb, za, zb in zip(*(batch[c] for c in ("a", "b", "ra", "rb", "na", "nb", "za", "zb")), strict=True):
                share = percent / 100
                error = _ERRORS * (share * (1 - share) / min(BUCKETS, na, nb)) ** 0.5
                if estimate(np.frombuffer(ra, np.uint16), np.frombuffer(rb, np.uint16)) < share - error or 100 * min(na, nb) < percent * max(na, nb):
                    good.append(False)
                    continue
                both = len(np.intersect1d(full(a, za), full(b, zb), assume_unique=True))
                good.append(100 * both >= percent * (na + nb - both))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    def side(x: str) -> DataFrame:
        return sets.select(F.col("item_id").alias(x), F.col("regs").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"), F.col("z").alias(f"z{x}"))

    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").mapInPandas(run, "a long, b long")


def near_duplicate_items(items: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``item_id, n_shingles, component_id, kept`` of every item.

    Items are linked when ``100 * shared >= percent * united`` of their distinct ``shingle_words``-word
    shingles (words in A-Z lower case; fewer words are one shingle). ``component_id`` is the least item id
    that can be reached over links; ``kept`` marks that item. A null, empty or blank description has no
    shingles and is linked with nothing. Repeated rows get equal answers, rows of one id with different
    texts are one node; a row without an id is alone, with a null component, and kept. Other columns of
    ``items`` are not looked at.
    """
    items = items.select(F.col("item_id").cast("long"), "description")
    sketch = stored(_sketch(items, shingle_words), "sketch")
    classes = sketch.filter("klass is not null and item_id is not null").groupBy("klass").agg(F.min("item_id").alias("rep"))
    reps = sketch.join(classes.withColumnRenamed("rep", "item_id"), ["klass", "item_id"]).dropDuplicates(["klass"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [band_keys(np.frombuffer(r, np.uint16)) for r in batch["regs"]]
            yield pd.DataFrame({"item_id": np.repeat(batch["item_id"].to_numpy(), BANDS), "key": np.concatenate(keys) if keys else np.zeros(0, np.int64)})

    bands = reps.select("item_id", "regs").mapInPandas(cut, "item_id long, key long").distinct()
    leaders = bands.groupBy("key").agg(F.min("item_id").alias("leader"), F.max("item_id").alias("other")).filter("leader < other").drop("other")
    members = stored(bands.join(leaders, "key"), "members")
    wanted = members.select("item_id").distinct()
    sets = packed(items).join(wanted, "item_id").join(reps.select("item_id", "regs", "n_shingles").dropDuplicates(["item_id"]), "item_id").dropDuplicates(["item_id"])

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = unpacker()
        for batch in batches:
            yield batch.assign(fine=[registers(shingles(unpack(z), shingle_words), FINE_BITS).tobytes() for z in batch["z"]])

    sets = stored(sets.mapInPandas(refine, "item_id long, z binary, regs binary, n_shingles long, fine binary"), "sets")

    shared = members.filter("item_id <> leader").groupBy("leader", "item_id").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("item_id").agg(F.max_by("leader", F.struct("n", -F.col("leader"))).alias("leader"))
    links = stored(_confirmed(best.select(F.col("leader").alias("a"), F.col("item_id").alias("b")), sets, shingle_words, percent), "links")
    found = components(links)
    for best_only in (True, False):
        pairs = stored(_same_bucket(members, sets, found, percent, best_only), "pairs")
        if pairs.isEmpty():
            break
        links = stored(_confirmed(pairs, sets, shingle_words, percent), "links")
        if not links.isEmpty():
            found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))

    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("klass", F.coalesce("component", "rep").alias("component_id"))
    out = sketch.join(named, "klass", "left")
    component = F.when(F.col("item_id").isNotNull(), F.coalesce("component_id", "item_id"))
    return out.select("item_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("item_id") == component, F.lit(True)).alias("kept"))


def _same_bucket(members: DataFrame, sets: DataFrame, found: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """Pairs ``a, b`` of one bucket in different components whose registers allow the similarity."""
    rows = (members.join(found.select(F.col("node").alias("item_id"), F.col("component").alias("part")), "item_id", "left")
            .select("key", "item_id", F.coalesce("part", "item_id").alias("part")))
    parts = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("total")).filter("most < total")
    rows = rows.join(mixed, "key").join(sets.select("item_id", "regs", "fine", "n_shingles"), "item_id")
    ways = {x: F.ceil(F.expr(n) / BLOCK_ROWS).cast("int") for x, n in (("main_blocks", "most"), ("rest_blocks", "total - most"))}
    rows = rows.withColumns(ways).withColumn("is_main", F.col("part") == F.col("main"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))
    # (i, j): main block i against block j of the rest; (-1 - b, a): blocks a < b of the rest.
    groups = F.expr("""if(is_main, transform(sequence(0, rest_blocks - 1), j -> struct(block as i, j as j)),
        concat(transform(sequence(0, main_blocks - 1), i -> struct(i as i, block as j)),
               transform(filter(sequence(0, rest_blocks - 1), b -> b <> block), b -> struct(-1 - greatest(b, block) as i, least(b, block) as j))))""")
    dealt = (rows.select("key", "item_id", "part", "is_main", "block", "regs", "fine", "n_shingles", F.inline(groups))
             .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "item_id"))
    share = percent / 100

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(batch) == 0:
                continue
            last = batch[["key", "i", "j"]].iloc[-1]
            open_from = int(np.argmax(((batch["key"] == last["key"]) & (batch["i"] == last["i"]) & (batch["j"] == last["j"])).to_numpy()))
            held = batch.iloc[open_from:]
            yield pairs_of(batch.iloc[:open_from])
        if held is not None:
            yield pairs_of(held)

    def finer(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimate over buckets that either set fills, and its error at the threshold.

        Such buckets are a sample without repetition from the united set, so few elements err little.
        """
        used = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(axis=1), 1)
        united = both / (1 + share)
        error = np.sqrt(share * (1 - share) / used * np.clip(1 - used / united, 0.1, 1))
        return ((a == b) & (a != EMPTY)).sum(axis=1) / used, error

    def pairs_of(rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(rows):
            regs = np.frombuffer(b"".join(rows["regs"]), np.uint16).reshape(len(rows), BUCKETS)
            fine = np.frombuffer(b"".join(rows["fine"]), np.uint16).reshape(len(rows), 1 << FINE_BITS)
            key, i, j, item, part, main, block, n = (rows[c].to_numpy() for c in ("key", "i", "j", "item_id", "part", "is_main", "block", "n_shingles"))
            least = share - _ERRORS * np.sqrt(share * (1 - share) / np.minimum(BUCKETS, n))
            at, step = np.arange(len(rows)), 1
            while True:
                at = at[at + step < len(rows)]
                b = at + step
                same = (key[at] == key[b]) & (i[at] == i[b]) & (j[at] == j[b])
                at, b = at[same], b[same]
                if not len(at):
                    break
                ok = (part[at] != part[b]) & ((i[at] == 0) | (i[at] > 0) & (main[at] | main[b]) | (i[at] < 0) & (block[at] != block[b]))
                a, b = at[ok], b[ok]
                for x in range(0, len(a), 50_000):
                    a1, b1 = a[x:x + 50_000], b[x:x + 50_000]
                    equal = regs[a1] == regs[b1]
                    good = (equal.mean(axis=1) >= np.minimum(least[a1], least[b1])) & (100 * np.minimum(n[a1], n[b1]) >= percent * np.maximum(n[a1], n[b1]))
                    a1, b1 = a1[good], b1[good]
                    if not len(a1):
                        continue
                    # A pair is looked at in the first band it shares only.
                    first = np.argmax(equal[good].reshape(-1, BANDS, BUCKETS // BANDS).all(axis=2), axis=1)
                    own = band_keys_of(regs[a1], first) == key[a1]
                    a1, b1 = a1[own], b1[own]
                    close, error = finer(fine[a1], fine[b1], n[a1] + n[b1])
                    good = close >= share - _ERRORS * error
                    found.append((a1[good], b1[good], close[good]))
                step += 1
        a, b, close = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        if best_only and len(a):
            pairs = pd.DataFrame({"of": np.concatenate([a, b]), "a": np.tile(a, 2), "b": np.tile(b, 2), "close": np.tile(close, 2)})
            best = pairs.sort_values("close", kind="stable").drop_duplicates("of", keep="last").drop_duplicates(["a", "b"])
            a, b = best["a"].to_numpy(), best["b"].to_numpy()
        items = rows["item_id"].to_numpy()
        return pd.DataFrame({"a": items[a], "b": items[b]}) if len(a) else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    return dealt.mapInPandas(compare, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
