"""Exact duplicates, the manifest and hard negatives against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidex.llm import sha
from evidex.llm.distinct import ContentTable, _buckets, _too_large, distinct_items, spilled
from evidex.llm.manifest import SNAPSHOT_FIELDS, manifest
from evidex.llm.negatives import BlockIndex, _rest, hard_negatives

ITEMS = "item_id long, description string"


def plain(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def same_text(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(plain(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[plain(t)]
        least = min((x for x in ids if x is not None), default=None)
        out.append((i, least, len(ids), i == least, hashlib.sha256(plain(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hash_bits,bucket_bytes", [(64, 64 << 20), (64, 300), (3, 64 << 20), (3, 300)])
def test_exact_duplicates_against_brute_force(spark, hash_bits, bucket_bytes):
    """Also with buckets so small that they are written anew, and with hashes that many texts share."""
    rng = random.Random(hash_bits + bucket_bytes)
    texts = [" ".join(rng.choice(["ash", "bone", "iron", "Iron", "red ", "tin"]) for _ in range(rng.randint(1, 9))) for _ in range(80)]
    rows = [(k, rng.choice(texts[:40] if k % 3 else texts).replace(" ", rng.choice([" ", "\t", "\r\n ", "\x0b"]))) for k in range(400)] + [(1000 + k, "one text for a third of all rows") for k in range(200)]
    got = distinct_items(spark.createDataFrame(rows, ITEMS).repartition(7), bucket_bytes, hash_bits)
    assert sorted(map(tuple, got.collect()), key=str) == same_text(rows)


def test_exact_duplicates_of_odd_items(spark, odd_items):
    more = odd_items.union(spark.createDataFrame([(None, "alone", 0), (None, "alone", 0), (2**60 + 1, "  ", 0), (8, " ", 0)], odd_items.schema))
    rows = [(r["item_id"], r["description"]) for r in more.collect()]
    got = distinct_items(more.withColumnsRenamed({"score": "bucket"}).withColumns({"h": F.lit(1), "items": F.lit("x")}))
    assert sorted(map(tuple, got.collect()), key=str) == same_text(rows)
    assert distinct_items(odd_items.filter("false")).count() == 0


def test_buckets_are_split_until_they_fit(spark):
    rows = [(k, b"z", 100, b"", [k]) for k in range(-3000, 3000)] + [(5 << 40, b"z", 100, b"", [k]) for k in range(3000)]
    records = spark.createDataFrame(rows, "h long, z binary, bytes long, sha binary, items array<long>")
    found = spilled(records, 2000)
    assert found.count() == 9000 and _too_large(found, 2000).count() == 0
    assert found.groupBy("h").agg(F.count_distinct("bucket").alias("n")).filter("n > 1").count() == 0
    assert found.select("bucket").distinct().count() > _buckets(records, 4).select("bucket").distinct().count()


def test_table_compares_contents():
    import zstandard

    table, press = ContentTable(), zstandard.ZstdCompressor(level=3).compress
    assert [table.find_or_add(7, press(b"%d" % (k % 50))) for k in range(100)] == [(k, True) for k in range(50)] + [(k, False) for k in range(50)]
    assert table.find_or_add(7, zstandard.ZstdCompressor(level=19, write_checksum=True).compress(b"3")) == (3, False)


def test_states_resume():
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(5)]
    words = sha.of_bytes(digests)
    first = sha.compress(sha.start(5), sha.hex_block(words))
    kept = sha.of_bytes(sha.to_bytes(first))
    both = sha.finish(sha.compress(kept, sha.hex_block(words[:, ::-1])), np.full(5, 2))
    assert sha.to_bytes(both) == [hashlib.sha256((a.hex() + b.hex()).encode()).digest() for a, b in zip(digests, digests[::-1], strict=True)]
    assert sha.to_bytes(sha.finish(sha.start(1), [0])) == [hashlib.sha256(b"").digest()]


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def record_leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes, fan_out):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + fan_out]) for k in range(0, len(out[-1]), fan_out)])
    return out


def folded(levels, k, now, fan_out):
    proof = []
    for nodes in levels[:-1]:
        first = k // fan_out * fan_out
        family = nodes[first:first + fan_out]
        proof += [x for s, x in enumerate(family) if s != k - first]
        family[k - first] = now
        now, k = h(*family), k // fan_out
    return now, proof


def merkle(rows, fields, group, order, seen, fan_out):
    """Rows are dicts; ``seen`` changes a copy of one."""
    key = lambda r: (r[order] is not None, r[order] or 0, record_leaf([r[f] for f in fields]))
    groups = {}
    for r in sorted(rows, key=key):
        groups.setdefault(r[group], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, str(g).encode()))
    trees = {g: levels_of([record_leaf([r[f] for f in fields]) for r in groups[g]], fan_out) for g in names}
    top = levels_of([trees[g][-1][0] for g in names], fan_out)
    out = []
    for n, g in enumerate(names):
        for k, r in enumerate(groups[g]):
            sub, low = folded(trees[g], k, record_leaf([seen(r)[f] for f in fields]), fan_out)
            done, high = folded(top, n, sub, fan_out)
            out.append((r[order], trees[g][0][k], trees[g][-1][0], top[-1][0], h(*low, *high), done, done == top[-1][0]))
    return sorted(out, key=str)


SNAPSHOT = "id long, url string, maker_id int, fetched_s long, status int, body string, total int, pos string"


@pytest.mark.parametrize("fan_out,chunk_levels,n", [(2, 12, 57), (2, 1, 57), (2, 2, 64), (3, 1, 40), (5, 2, 33), (2, 3, 1)])
def test_manifest_against_brute_force(spark, fan_out, chunk_levels, n):
    """Chunks so small that there are many stages, groups of one record, and changed fields."""
    rng = random.Random(n + fan_out)
    rows = [(k * 3, f"a.com/{k}", rng.choice([0, 0, 0, 1, 2, 10, None]), rng.choice([k, None]), 200, rng.choice(["", None, "glaze é", "x" * 9000]), k, "q") for k in range(n)]
    rows += [(None, None, 0, None, None, None, 1, None)] * 2 + [(3, "same", 7, 1, 200, "twice", 0, "p")] * 2
    df = spark.createDataFrame(rows, SNAPSHOT)
    dicts = [r.asDict() for r in df.collect()]
    changed = lambda r: r | {"status": r["status"] + 1} if r["status"] is not None and (r["id"] or 0) % 4 == 0 else r
    got = manifest(df, seen={"status": F.when(F.col("id") % 4 == 0, F.col("status") + 1).otherwise(F.col("status"))}, fan_out=fan_out, chunk_levels=chunk_levels)
    assert got.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == merkle(dicts, SNAPSHOT_FIELDS, "maker_id", "id", changed, fan_out)


def test_manifest_of_snapshots(spark, catalog):
    """The fetch log of the catalog: all is verified, and a changed body is not."""
    log = catalog.snapshots
    assert manifest(log).filter("verified and folded_root = root").count() == log.count()
    bad = manifest(log, seen={"body": F.when(F.col("status") == 404, F.concat("body", F.lit(" "))).otherwise(F.col("body"))})
    assert bad.filter("not verified").count() == log.filter("status = 404").count() > 0
    assert manifest(log.filter("false")).count() == 0


def brute_negatives(rows, scale=256, k=5, low=80):
    rows = {i: (line, np.floor(scale * np.array(x))) for i, line, x, _ in rows}, [i for i, _, _, a in rows if a]
    data, out = rows[0], []
    width = max((len(v) for _, v in data.values()), default=0)
    padded = {i: np.pad(v, (0, width - len(v))) for i, (_, v) in data.items()}
    for a in rows[1]:
        scored = sorted(((int(padded[a] @ padded[i]), i) for i in data if i != a), key=lambda r: (-r[0], r[1]))
        for p, pos in [r for r in scored if data[r[1]][0] == data[a][0]][:k]:
            window = [r for r in scored if data[r[1]][0] != data[a][0] and low * p <= 100 * r[0] <= 100 * p][:k]
            out += [(a, pos, n, i, p, s) for n, (s, i) in enumerate(window, start=1)]
    return sorted(out)


READING = "item_id long, line string, lab array<double>, anchor boolean"


@pytest.mark.parametrize("n,width,shift", [(600, 3, 0.5), (900, 20, 0.2), (400, 40, 0.0), (300, 1, 0.1)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, n, width, shift):
    from evidex.llm import negatives

    monkeypatch.setattr(negatives, "EXPECTED", (2, 12, None))
    monkeypatch.setattr(negatives, "WAVE_BYTES", 8 * width * 11)
    rng = np.random.default_rng(n)
    line = rng.choice(["gloss", "matte", "raku", "rare"], n, p=[0.5, 0.3, 0.195, 0.005])
    x = np.round(rng.normal(shift, 0.4, (n, width)), 1)
    x[: n // 4] = x[0]  # a quarter are one vector: ties
    rows = [(int(i) * 7, str(c), v.tolist(), bool(i % 9 == 0)) for i, c, v in zip(rng.permutation(n), line, x, strict=True)]
    got = hard_negatives(spark.createDataFrame(rows, READING).repartition(5))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_hard_negatives_of_odd_readings(spark):
    good = [(k, "ab"[k % 2], [0.5 + k / 50, 0.25], k < 3) for k in range(12)]
    odd = [(None, "a", [1.0, 1.0], True), (50, None, [1.0], True), (51, "a", None, True), (52, "a", [1.0, None], True), (53, "b", [float("nan")], False), (54, "b", [float("inf"), 0.0], False)]
    short = [(60, "b", [1.0], False), (61, "a", [], True), (62, "lone", [0.5, 0.5], True), (63, "b", [-5.0, 0.0], True), (64, "b", [-5.0, 0.1], None)]
    df = spark.createDataFrame(good + good[:3] + odd + short, READING).withColumns({"w": F.lit(1), "rank": F.lit("x")})
    assert sorted(map(tuple, hard_negatives(df).collect())) == brute_negatives([(i, c, v, bool(a)) for i, c, v, a in good + short])
    assert hard_negatives(df.filter("false")).count() == 0 and hard_negatives(df.withColumn("anchor", F.lit(False))).count() == 0
    with pytest.raises(ValueError, match="too large"):
        hard_negatives(spark.createDataFrame([(1, "a", [1e9], True), (2, "a", [1.0], False)], READING))


@pytest.mark.parametrize("scale", [0.3, 0.6, 0.9])
def test_index_omits_and_prunes_without_loss(scale):
    rng = np.random.default_rng(5)
    v = np.floor(rng.normal(0, 60, (700, 30)) * np.linspace(3, 0.1, 30))
    q = v[:40]
    norm = np.sqrt((q * q).sum(axis=1))
    t = scale * norm * np.median(np.sqrt((v * v).sum(axis=1)))
    index = BlockIndex(v, float(np.min(t / norm)))
    i, j, score = index.at_least(q, _rest(q), t)
    whole = q @ v.T
    assert sorted(zip(i.tolist(), j.tolist(), score.tolist(), strict=True)) == sorted((a, b, whole[a, b]) for a, b in np.argwhere(whole >= t[:, None]).tolist())
    assert index.counts[-2] < index.counts[0] < len(v) or scale < 0.5
