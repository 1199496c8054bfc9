"""Encoding, quality, token files and fingerprints against the library, a plain restatement or held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidex.llm import bpe, leaks, quality, tokenfile, winnow
from evidex.llm.order import with_next
from evidex.llm.queries import queries

EMPTY = "item_id long, description string"


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").collect()


def test_tree_equals_library(tokenizer):
    plain, tree = Tokenizer.from_file(tokenizer), bpe.TreeEncoder(tokenizer, leaf_chars=200)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdeéüßñ日本'stre.!$&*|<>0123\u0301\x00\x01AZİ") for _ in range(n)) for n in (1, 5, 199, 300, 1000, 4000) for _ in range(4)]
    texts += [t[:len(t) // 2] + "<|endoftext|>" + t[len(t) // 2:] for t in texts]
    texts += ["a" * 5000, "thethe" * 2000, "$" * 3000, "'s" * 2000, "a b\x1cc d\x85e\xa0f " * 50, "<|endoftext|>" * 100, "", "  ", None]
    for text, ids in zip(texts, tree.encode_batch(texts), strict=True):
        want = plain.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert tree.decode_batch([ids]) == [plain.decode(want, skip_special_tokens=False)]
    for text in texts[:-3]:
        if not text.isspace() and " " not in text:
            assert tree.tree(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_whole_texts_are_joined_as_a_tree(spark, sf, tokenizer):
    """Cuts inside words, numbers, white space and letters with marks; the given documents are joined too."""
    plain, tree = Tokenizer.from_file(tokenizer), bpe.TreeEncoder(tokenizer, leaf_chars=200)
    rng = random.Random(7)
    pools = ["the glaze's broke over 12 tiles", "Töpfer brännt 1 222 °C", "e\u0301te\u0301 d'ar\u0300gile it's", "日本 の 釉薬 x"]
    texts = ["".join(rng.choice(pools[k % 4].split()) + rng.choice([" ", "  ", "\n", "\t\x85", "", "\x1c", "."]) for _ in range(rng.randint(50, 900))) for k in range(60)]
    texts += [" " * 3000, "a" * 1500 + " b " * 900, "<|endoftext|>" * 90 + " x" * 400]
    for text, ids in zip(texts, tree.encode_batch(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert tree.joins > 500
    given, whole = bpe.TreeEncoder(tokenizer), [r["text"] or "" for r in read(spark, sf, "documents")]
    assert [x.tolist() for x in given.encode_batch(whole)] == [plain.encode(t, add_special_tokens=False).ids for t in whole] and given.joins >= sum(len(t) > bpe.LEAF_CHARS for t in whole) > 0


def test_a_text_of_many_distinct_words_ends(tokenizer):
    tree = bpe.TreeEncoder(tokenizer)
    text = " ".join(f"w{k:x}q" for k in range(1_200_000))
    ids = tree.encode_batch([text])[0]
    assert tree.decode_batch([ids])[0].replace(" ", "").replace("</w>", "") == text.replace(" ", "")


def test_ids_of_any_size_and_nulls(spark, tokenizer, tmp_path):
    rows = [(2**53 + 1, "a b"), (None, "c"), (-(2**62) - 1, None)]
    items = spark.createDataFrame(rows, EMPTY).coalesce(1)
    coded = bpe.encode_descriptions(items, tokenizer)
    for made in (coded, bpe.decode_tokens(coded, tokenizer), bpe.recode_descriptions(items, tokenizer)):
        assert {r["item_id"] for r in made.collect()} == {r[0] for r in rows}
    tokenfile.write_token_files(items, tokenizer, 2, str(tmp_path / "a"))
    assert {r["item_id"] for r in tokenfile.read_token_files(spark, str(tmp_path / "a")).collect()} == {r[0] for r in rows}


def test_op1_on_whole_table(spark, sf, tokenizer):
    plain = Tokenizer.from_file(tokenizer)
    want = {}
    for r in read(spark, sf, "documents"):
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in (" ".join(map(str, ids)), plain.decode(ids, skip_special_tokens=False))]
        want[r["doc_id"]] = (len(ids), *digests)
    assert {r[0]: tuple(r[1:]) for r in queries()["op1_bpe"](spark, sf).collect()} == want


def test_encode_and_decode_odd_items(spark, odd_items, tokenizer):
    coded = bpe.encode_descriptions(odd_items, tokenizer)
    rows = coded.collect()
    assert len(rows) == 9 and sorted(len(r["token_ids"]) for r in rows)[:3] == [0, 0, 0]
    assert bpe.decode_tokens(coded, tokenizer).count() == 9
    assert bpe.encode_descriptions(spark.createDataFrame([], EMPTY), tokenizer).count() == 0


def test_op9_reads_back_what_was_written(spark, sf, tokenizer):
    plain, start, want = Tokenizer.from_file(tokenizer), 0, []
    for r in sorted(read(spark, sf, "documents"), key=lambda r: r["doc_id"]):
        ids = [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries()["op9_token_files"](spark, sf).collect()) == want


def test_an_encoder_leaves_cores_to_other_tasks(tokenizer, monkeypatch):
    import os

    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    encoder, plain = bpe.TreeEncoder(tokenizer), Tokenizer.from_file(tokenizer)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    latin = bytes(range(1, 256)).decode("latin-1")
    texts = [latin.replace("'", ""), latin, "".join(f"A{c}B 1{c} {c}" for c in latin if c != "'"), "don't", "ÀÉ ß µ ÿ Ÿ", "x\u0100", " ", ""]
    assert [x.tolist() for x in encoder.encode_batch(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "true")
    bpe.TreeEncoder(tokenizer)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "true"


def test_few_blocks_are_decoded_at_once(spark, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "READ_BLOCKS", 1)
    items = spark.createDataFrame([(k, "a b " * k) for k in range(40)], "item_id long, description string").coalesce(1)
    tokenfile.write_token_files(items, tokenizer, 2, str(tmp_path / "c"))
    rows = sorted(tokenfile.read_token_files(spark, str(tmp_path / "c")).collect(), key=lambda r: r["item_id"])
    assert [r["n_tokens"] for r in rows] == [2 * k + 1 for k in range(40)]


def test_token_files_of_odd_items(spark, odd_items, tokenizer, tmp_path):
    tokenfile.write_token_files(odd_items, tokenizer, 2, str(tmp_path / "a"))
    rows = sorted(tokenfile.read_token_files(spark, str(tmp_path / "a")).collect(), key=lambda r: r["start"])
    assert [r["item_id"] for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7] and rows[3]["n_tokens"] == 1
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    tokenfile.write_token_files(spark.createDataFrame([], EMPTY), tokenizer, 2, str(tmp_path / "b"))
    assert tokenfile.read_token_files(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 60, 5000])
def test_code_is_complete_and_round_trips(n):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.3, n).clip(0, 10**9)
    lengths = tokenfile.code_lengths(counts)
    assert lengths.max() <= tokenfile.limit_of(n) and (n == 1 or abs(sum(2.0 ** -int(x) for x in lengths) - 1) < 1e-9)
    code, ids = tokenfile.Code(lengths), [rng.integers(0, n, k) for k in (1, 1024, 1025, 5000)]
    for a, b in zip(ids, code.decode([(*code.encode(a), len(a)) for a in ids]), strict=True):
        assert (a == b).all()


def test_code_lengths_are_least():
    # Fibonacci counts want 15 bits; the best code of at most 12 bits has this cost (found by trying all length profiles).
    counts = np.array([1, 1, 2, 3, 5])
    assert int((tokenfile.code_lengths(counts) * counts).sum()) == 25


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in read(spark, sf, "labels")}
    rows = [r for r in queries()["op2_quality"](spark, sf).collect() if r["held_out"] and r["doc_id"] in marks]
    assert rows and np.mean([r["predicted"] == marks[r["doc_id"]] for r in rows]) >= 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def plain_buckets(text):
    """The buckets of a text one gram at a time, with whole numbers."""
    top = 2**64

    def mixed(h):
        h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 % top
        h = (h ^ (h >> 29)) * 0xA0761D6478BD642F % top
        return h ^ (h >> 32)

    def hashed(part):
        return mixed(sum(int(quality._VALUES[b]) * pow(bpe.BASES[1], k, top) for k, b in enumerate(part)) % top)

    words = [b" " + w + b" " for w in text.encode().split()]
    whole = [hashed(w) for w in words]
    found = [h ^ 1 for h in whole] + [2 if a == b else (mixed(a) + b) % top for a, b in zip(whole, whole[1:], strict=False)]
    found += [(hashed(w[k:k + n]) + n) % top for w in words for n in quality.GRAMS for k in range(len(w) - n + 1)]
    return [mixed(h) >> (64 - quality.BUCKET_BITS) for h in found]


def test_op2_against_plain_scores(spark, sf):
    """The query's scores from the fitted numbers, gram by gram; labels of held-out rows change nothing."""
    docs = {r["doc_id"]: r["text"] or "" for r in read(spark, sf, "documents")}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    items = spark.createDataFrame(list(docs.items()), EMPTY)
    marks = [(r["doc_id"], r["quality"]) for r in read(spark, sf, "labels") if r["doc_id"] not in held]
    table, bias = quality.train(items, spark.createDataFrame(marks, "item_id long, accepted int"))
    got = {r["doc_id"]: r for r in queries()["op2_quality"](spark, sf).collect()}
    assert got.keys() == docs.keys() and {i for i, r in got.items() if r["held_out"]} == held
    for i in sorted(docs, key=lambda i: len(docs[i]))[:60]:
        at = plain_buckets(docs[i])
        want = 1 / (1 + np.exp(-(sum(float(table[b]) for b in at) / max(len(at), 1) + bias)))
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["predicted"] == int(got[i]["score"] >= 0.3)


def test_quality_odd_items(spark, odd_items):
    reviews = spark.createDataFrame([(1, 1), (7, 0), (7, 1), (None, 1), (5, None)], "item_id long, accepted int")
    rows = quality.score_items(odd_items, quality.train(odd_items, reviews)).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    nothing = quality.train(odd_items, reviews.filter("false"))
    assert {r["score"] for r in quality.score_items(odd_items, nothing).collect()} == {0.5}


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(300):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, b))) for a, b in ((1, 90), (0, 60)))
        assert leaks.Myers(p).best(t)[0] == distance(p, t)


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    words = ["ash", "bone", "clay", "dolomite", "engobe", "frit", "glaze", "hare", "iron", "jun"]
    passages = [(k, " ".join(rng.choice(words) for _ in range(12))) for k in range(5)]
    items = []
    for n in range(40):
        text = [" ".join(rng.choice(words) for _ in range(20)), passages[n % 5][1].upper(), " ".join(rng.choice(words) for _ in range(9))]
        mid = list(text[1])
        for _ in range(n // 4):
            mid[rng.randrange(len(mid))] = rng.choice("xyz")
        items.append((n, "\n ".join([text[0], "".join(mid), text[2]])))
    items += [(100, None), (101, ""), (None, passages[0][1])]
    found = {(r["item_id"], r["passage_id"]): r["distance"] for r in leaks.leaked_passages(
        spark.createDataFrame(items, EMPTY), spark.createDataFrame([*passages, (9, None), (8, " "), (None, "x")], "passage_id long, text string")).collect()}
    want = {(i, k): d for i, t in items if t for k, p in passages if (d := distance(leaks.normal(p), leaks.normal(t))) <= len(leaks.normal(p)) * leaks.ERROR_PERCENT // 100}
    assert found == want and len(want) > 15
    clean = {r[0] for r in leaks.clean_items(spark.createDataFrame(items, EMPTY), spark.createDataFrame(passages, "passage_id long, text string")).collect()}
    assert clean == {i for i, _ in items} - {i for i, _ in want}
    none = spark.createDataFrame([], "passage_id long, text string")
    assert leaks.leaked_passages(spark.createDataFrame(items, EMPTY), none).count() == 0


def test_op5_on_whole_table(spark, sf):
    passages = {r["item_id"]: leaks.normal(r["text"]) for r in read(spark, sf, "benchmark")}
    whole = {(r["doc_id"], k) for r in read(spark, sf, "documents") for k, p in passages.items() if p in leaks.normal(r["text"])}
    rows = queries()["op5_leaks"](spark, sf).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["distance"] == 0} == whole


def test_op6_edited_texts(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in read(spark, sf, "documents")}
    ids = sorted(docs, reverse=True)
    rows = {r["doc_id"]: r for r in queries()["op6_fingerprints"](spark, sf).collect()}
    for k, i in enumerate(ids):
        mine, following = docs[i], docs[ids[(k + 1) % len(ids)]]
        cut = len(mine) // 3
        edited = mine[:len(mine) - cut] + following[:cut]
        assert (rows[i]["n_chars"], rows[i]["edited_sha256"]) == (len(mine), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= rows[i]["near_next"] <= 1
    assert np.mean([r["near_edited"] for r in rows.values()]) > 0.3 > 0.05 > np.median([r["near_next"] for r in rows.values()])


def plain_prints(text):
    """[(hash, position)] kept of a text, one window at a time."""
    import re

    import xxhash

    def both(a, b):
        return xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))

    pieces = [m[1] for m in re.finditer(r"(?=((?<!\S)\S{1,8}(?!\S)|\S{8}))\S", text, re.ASCII)]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    two = [both(a, b) for a, b in zip(h, h[1:], strict=False)]
    four = [both(a, b) & 0xFFFFFFFF for a, b in zip(two, two[2:], strict=False)]
    kept = []
    for k in range(max(1, len(four) - 7) if four else 0):
        window = range(k, min(k + 8, len(four)))
        place = min(window, key=lambda i: (four[i], -i))
        if (four[place], place) not in kept:
            kept.append((four[place], place))
    flat = re.sub("^ | $", "", re.sub(r"\s+", " ", text, flags=re.ASCII))
    if 0 < len(flat) <= 64:
        kept += [(xxhash.xxh64_intdigest(flat[k:k + 4].encode(), 42) & 0xFFFFFFFF, k) for k in range(max(1, len(flat) - 3))]
    return kept


def test_op6_against_plain_winnowing(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in read(spark, sf, "documents")}
    ids = sorted(docs, reverse=True)
    rows = {r["doc_id"]: r for r in queries()["op6_fingerprints"](spark, sf).collect()}
    plain = {i: plain_prints(docs[i]) for i in ids}

    def alike(a, b):
        x, y = {h for h, _ in a}, {h for h, _ in b}
        return len(x & y) / len(x | y) if x | y else 1.0

    for k, i in enumerate(ids):
        following = ids[(k + 1) % len(ids)]
        cut = len(docs[i]) // 3
        edited = plain_prints(docs[i][:len(docs[i]) - cut] + docs[following][:cut])
        shown = [" ".join(f"{h:08x}@{p}" for h, p in prints) for prints in (plain[i], edited)]
        assert [rows[i]["fingerprint"], rows[i]["edited_fingerprint"]] == shown
        assert abs(rows[i]["near_edited"] - alike(plain[i], edited)) < 1e-9 and abs(rows[i]["near_next"] - alike(plain[i], plain[following])) < 1e-9


def test_winnowing_by_hand(spark, odd_items):
    rows = winnow.fingerprints(odd_items.withColumn("prints", odd_items.score)).collect()
    assert len(rows) == 9 and [len(r["prints"]) for r in rows if not (r["description"] or "").strip()] == [0, 0, 0]
    df = spark.createDataFrame([(1, " ".join(f"w{k % 37}" for k in range(200)))], EMPTY)
    got = winnow.fingerprints(df).selectExpr("prints", "transform(regexp_extract_all(description, '\\\\S{1,8}', 0), x -> xxhash64(x)) h").first()
    spans = spark.sql("select 1").first() and [got["h"][k:k + 4] for k in range(197)]
    grams = [r[0] for r in spark.createDataFrame([(s, k) for k, s in enumerate(spans)], "s array<long>, k int").selectExpr(
        "xxhash64(xxhash64(s[0], s[1]), xxhash64(s[2], s[3])) & 4294967295 h", "k").orderBy("k").collect()]
    want = []
    for k in range(len(grams) - 7):
        place = min(range(k, k + 8), key=lambda i: (grams[i], -i))
        if (grams[place], place) not in want:
            want.append((grams[place], place))
    assert [(p >> 31, (1 << 31) - 1 - (p & ((1 << 31) - 1))) for p in got["prints"]] == want


def test_passages_shifted_in_text_without_blanks(spark):
    rng = random.Random(5)
    run = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    shared = run(18)
    rows = [(0, shared), *[(k, run(90) + run(k) + shared + run(90)) for k in range(1, 17)], (99, run(300)), (100, "iron red glaze"), (101, "iron red slip"), (102, "ash")]
    found = {r["item_id"]: set(r["h"]) for r in winnow.fingerprints(spark.createDataFrame(rows, EMPTY)).select("item_id", winnow.hashes(F.col("prints")).alias("h")).collect()}
    assert all(found[1] & found[k] for k in range(2, 17)) and not found[1] & found[99]
    assert found[100] & found[101] and found[102] and not found[100] & found[102]


def test_next_in_global_order(spark):
    for n in (0, 1, 2, 500):
        df = spark.range(n).selectExpr("id * 7 % 500 as k", "id")
        got = {r["k"]: r["next"]["k"] if r["next"] else None for r in with_next(df, "k", [df.id], ["k"], wrap=True).collect()}
        keys = sorted(got)
        assert got == {k: keys[(i + 1) % len(keys)] for i, k in enumerate(keys)}
        both = with_next(df, "k", [df.id], ["k"], before="previous").collect()
        ks = sorted(r["k"] for r in both)
        assert {r["k"]: (r["previous"] and r["previous"]["k"], r["next"] and r["next"]["k"]) for r in both} == {
            k: (ks[i - 1] if i else None, ks[i + 1] if i + 1 < len(ks) else None) for i, k in enumerate(ks)}
