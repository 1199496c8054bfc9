"""Search and similarity on a catalog of our own, against plain restatements of the rules."""

import random

import pytest
from pyspark.sql import functions as F

from evidex.functions.text import stemmed
from evidex.operators import postings as T
from evidex.operators import search as S
from evidex.operators import search_index as I
from evidex.operators import similar
from evidex.operators.quality import schema_contract
from tests import brute

ITEMS = "item_id long, maker_id int, code string, name string, description string, line string, lo int, hi int, terms array<string>, surface int, opacity int, flag boolean, price double"
SEARCH = "qid long, text string, makers array<int>, lines array<string>, surfaces array<int>, opacities array<int>, lo int, hi int, flag boolean, clays array<long>, codes array<string>, code_makers array<string>, page_limit int, page_offset int"
MAKERS = {3: "northkiln", 5: "orchard", 8: "tidewater"}
NOUNS = "harbour pine ember chalk penny drift willow cinder quarry heron".split()
STATES = "cooling settled glossy pooling broken drifting ringed smoky".split()
COLOURS = "slate rust amber oribe cobalt cream indigo tan".split()


def catalog(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        noun, state = rng.choice(NOUNS), rng.choice(STATES)
        name = f"{state.title()} {noun}" + rng.choice(["", "", f" or {rng.choice(NOUNS)}", "s"])
        text = rng.choice([None, "", f"The {noun} is {state} over {rng.choice(NOUNS)} and {rng.choice(NOUNS)}.", f"{state} {state} {noun}"])
        lo = rng.choice([None, rng.randint(1, 30)])
        rows.append((k * 11 + 4, rng.choice(list(MAKERS)), f"{rng.choice(['KV', 'RD', 'W'])}-{k // 3}", name, text, rng.choice(["KV", "RD", None]), lo, rng.choice([None, (lo or 1) + rng.randint(0, 6)]),
                     rng.sample(COLOURS, rng.randint(0, 3)), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2]), rng.choice([None, True, False]), float(k)))
    return rows


def asked(n, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(NOUNS + STATES + COLOURS)
    shapes = [lambda: None, lambda: "  ", word, lambda: f"{word()} {word()}", lambda: f'"{rng.choice(STATES)} {rng.choice(NOUNS)}"', lambda: f"{word()} -{word()}", lambda: f"{word()} or {word()} {word()}",
              lambda: f"-{word()}", lambda: f'-"{rng.choice(STATES)} {rng.choice(NOUNS)}" -{word()}', lambda: f'"{rng.choice(NOUNS)} or {rng.choice(NOUNS)}"', lambda: word()[:-2] + "x", lambda: f"kv-{rng.randint(0, 20)}",
              lambda: f"{word()} or -{word()}", lambda: "the of", lambda: f"{word()} -{word()[:1]}"]
    out = []
    for k in range(n):
        some = lambda values, p=0.2: rng.sample(values, rng.randint(1, 2)) if rng.random() < p / 2 else None
        codes = rng.choice([None] * 12 + [[], [" kv-1", "RD-2", "w-3", None], ["Kv-4", "rd-5"]])
        out.append((k, shapes[k % len(shapes)](), some(list(MAKERS)), some(["KV", "RD"], 0.1), some([1, 2, 3], 0.15), some([1, 2], 0.15), rng.choice([None, None, None, 9]), rng.choice([None, None, None, 18]),
                    rng.choice([None] * 5 + [True, False]), some([70, 71, 72], 0.15), codes, None if codes is None else rng.choice([["NORTHKILN ", "orchard"], ["tidewater", "northkiln", "nobody"], []]),
                    rng.choice([0, 2, 3, 5, 40]), rng.choice([-2, 0, 0, 0, 1])))
    return out


@pytest.fixture(scope="module")
def shop(spark):
    rows = catalog(60, 17)
    evidence = [(f"e{i}", r[0], "label_chip" if i % 3 else "layered", 1 + i % 4, 70 + i % 4 if i % 2 else None, "#102030", None, f"u{i}", f"s{i}") for i, r in enumerate(rows) if i % 5]
    makers = spark.createDataFrame(list(MAKERS.items()), "maker_id int, maker_key string")
    clays = spark.createDataFrame([(70, "Ball"), (71, "Fire"), (72, "Bone"), (73, "Raku")], "clay long, clay_name string")
    tables = S.Tables(spark.createDataFrame(rows, ITEMS), makers, spark.createDataFrame(evidence, "ev_id string, item_id long, role string, coat int, clay long, hex string, layered_over long, source_url string, storage_path string"), clays)
    shown = {}
    for e in evidence:
        if e[4] is not None:
            shown.setdefault(e[1], set()).add(e[4])
    return tables, [r.asDict() for r in tables.items.collect()], shown


def answers(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.qid, r.position)):
        out.setdefault(r.qid, []).append((r.item_id, r.tier, r.rank))
    return out


@pytest.fixture(scope="module")
def wanted(spark, shop):
    _, items, clays = shop
    searches = spark.createDataFrame(asked(90, 23), SEARCH)
    want = {r["qid"]: brute.page(r.asDict(), items, MAKERS, clays) for r in searches.collect()}
    return searches, {q: rows for q, rows in want.items() if rows}


def test_ranked_search_against_brute_force(shop, wanted):
    searches, want = wanted
    assert answers(S.ranked_search(shop[0], searches)) == want
    assert len(want) > 40 and {t for rows in want.values() for _, t, _ in rows} == {"match", "near"}


@pytest.mark.parametrize("shard_rows", [100_000, 2])
def test_index_search_against_brute_force(shop, wanted, shard_rows):
    """Also with lists in so small shards that every one is cut."""
    searches, want = wanted
    assert answers(I.search(I.build_index(shop[0], shard_rows), searches)) == want


@pytest.mark.parametrize("rare_rows,blocks", [(0, (1,)), (6, (1, 2))])
def test_pages_from_groups_against_brute_force(shop, wanted, monkeypatch, rare_rows, blocks):
    """All and some terms in groups; lists that are read in several rounds; both with and without a stored index."""
    from evidex.operators import search_pages as G

    searches, want = wanted
    monkeypatch.setattr(G, "RARE_ROWS", rare_rows)
    monkeypatch.setattr(G, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(G, "FIRST_REACH", 1)
    if rare_rows == 0:
        assert answers(S.ranked_search(shop[0], searches)) == want
    else:
        assert answers(I.search(I.build_index(shop[0], rare_rows=rare_rows), searches)) == want


@pytest.mark.parametrize("rare_rows", [6])
def test_totals_of_tiers_equal_those_of_rows(shop, wanted, monkeypatch, rare_rows):
    """Without a row per answer, also for a search that stands twice in its table."""
    from evidex.operators import search_pages as G

    monkeypatch.setattr(G, "RARE_ROWS", rare_rows)
    searches = wanted[0].unionByName(wanted[0].filter("qid % 7 = 0"))
    rows = S.scored(shop[0], searches).groupBy("qid", "tier").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("best"), F.min("rank").alias("worst"), F.sum("item_id").alias("ids"))
    want = sorted(map(tuple, rows.collect()))
    assert sorted(map(tuple, S.scored(shop[0], searches, totals=True).collect())) == want and len(want) > 60


def test_an_empty_identity_list_allows_nothing(spark, shop):
    base = (None, None, None, None, None, None, None, None)
    searches = spark.createDataFrame([(1, " ", *base, None, None, 40, 0), (2, " ", *base, [], [], 40, 0), (3, " ", *base, ["KV-1"], None, 40, 0)], SEARCH)
    assert set(answers(S.ranked_search(shop[0], searches))) == {1} == set(answers(I.search(I.build_index(shop[0]), searches)))


def test_the_index_is_not_shuffled(spark, catalog):
    from evidex.plans.search_checks import tables

    index = I.build_index(tables(catalog))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = I.hits(index, T.clauses(catalog.searches), I._wanted(catalog.searches))
        tree = found._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    read = {kind: [k for k, line in enumerate(tree) if f"Scan parquet spark_catalog.default.evidex_{kind}" in line] for kind in ("postings", "forward")}
    assert all(read.values())
    for k in sum(read.values(), []):
        above = depth(tree[k])
        for line in reversed(tree[:k]):  # up to the join that reads the index
            if depth(line) < above:
                above = depth(line)
                assert "Exchange" not in line
                if "Join" in line:
                    break


def test_bounds_hold_and_leave_few(spark, catalog):
    from evidex.plans.search_checks import tables
    from evidex.session import stored

    index = I.build_index(tables(catalog))
    searches = catalog.searches.filter("trim(text) <> ''")
    rows = stored(I.candidates(index, searches), "candidates")
    exact = rows.join(I.ranked(rows, 0.02).select("qid", "item_id", "tier", "rank"), ["qid", "item_id"])
    wrong = exact.filter("rank < low - 1e-6 or rank > high + 1e-6 or tier > tier_low or tier < tier_high")
    assert exact.count() > 100 and wrong.count() == 0
    depths = searches.select("qid", (F.col("page_limit") + F.col("page_offset")).cast("long").alias("depth"))
    kept = stored(I.survivors(rows, depths), "kept")
    order = [F.col("tier"), F.desc("rank"), F.col("code"), F.col("item_id")]
    first = lambda df: {tuple(r) for r in I._first(df, depths, order, "position").drop("depth").collect()}
    assert first(I.ranked(kept, 0.02)) == first(I.ranked(rows, 0.02))
    assert kept.count() <= 5 * depths.agg(F.sum("depth")).first()[0] and kept.count() < rows.count()


def test_porters_first_step(spark):
    rng = random.Random(4)
    known = dict(p.split(":") for p in ("caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agree plastered:plaster bled:bled motoring:motor sing:sing conflated:conflate "
                                        "troubled:trouble sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky").split())
    made = ["".join(rng.choice("aeiouybcdlstzw") for _ in range(rng.randint(1, 6))) + rng.choice(["", "s", "ed", "ing", "eed", "y", "ies", "sses", "edly"]) for _ in range(2000)]
    words = spark.createDataFrame([(w,) for w in sorted({*known, *made})], "w string")
    got = {r.w: r.s for r in words.select("w", stemmed(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w in known} == known and got == {w: brute.stem(w) for w in got}


def similar_by_hand(rows, k, anchors=None):
    def features(r):
        return {("t", t): 3 for t in r[8] or []} | ({("s", r[9]): 2} if r[9] else {}) | ({("o", r[10]): 2} if r[10] else {}) | ({("l", r[5]): 1} if r[5] else {})

    own, out = {r[0]: features(r) for r in rows}, set()
    for a in rows:
        if anchors is None or a[0] in anchors:
            scored = [(-sum(w for f, w in own[a[0]].items() if f in own[b[0]]), b[2], b[0]) for b in rows if b[0] != a[0]]
            out |= {(a[0], b, -s, i) for i, (s, _, b) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)}
    return out


@pytest.mark.parametrize("words,shard_rows,k", [(3, 10_000, 4), (3, 2, 4), (40, 10_000, 4), (40, 3, 50)])
def test_similarity_equals_brute_force(spark, words, shard_rows, k):
    """Few and many features, features that most items share, lists in small shards, more asked for than there are."""
    rng = random.Random(words + shard_rows)
    pool = [f"w{j}" for j in range(words + 5)]
    rows = [(i, i % 3, f"C-{i % 7}", None, None, "L" if i % 3 else None, None, None, sorted({"common", *rng.sample(pool, rng.randint(0, words))} if i % 5 else set()), (i % 4) or None, (i % 5) or None, None, None) for i in range(70)]
    items = spark.createDataFrame([(*r[:2], r[2], "n", *r[4:]) for r in rows], ITEMS)
    got = {(r.anchor_id, r.item_id, r.score, r.position) for r in similar.similar_items(items, k, shard_rows=shard_rows).collect()}
    assert got == similar_by_hand(rows, k)
    some = {0, 6, 35, 69}
    few = similar.similar_items(items, k, anchors=items.filter(F.col("item_id").isin(*some)), shard_rows=shard_rows)
    assert {(r.anchor_id, r.item_id, r.score, r.position) for r in few.collect()} == similar_by_hand(rows, k, some)
    assert similar.similar_items(items.filter("false"), k).count() == 0


def test_hit_contract(spark, shop):
    page = shop[0].items.select("item_id", F.lit("match").alias("tier"), F.lit(1.0).alias("rank"))
    found = S.project_hit(page, shop[0])
    assert schema_contract(found, S.HIT_ROW) == [] and len(S.HIT_COLUMNS) == 27
    assert schema_contract(found.withColumn("rank", F.col("rank").cast("float")), S.HIT_ROW) != []


def test_clauses(spark):
    frame = spark.createDataFrame([(1, 'smoky "Chalk Cliffs" -tan or the herons')], "qid long, text string")
    got = {(r.grp, r.unit, r.negated, r.place, r.term) for r in T.clauses(frame).collect()}
    assert got == {(0, 0, False, 0, "smoki"), (0, 1, False, 0, "chalk"), (0, 1, False, 1, "cliff"), (0, 2, True, 0, "tan"), (1, 1, False, 0, "heron")}


def test_matching_edges(spark):
    """A word both required and excluded matches nothing; any number of words match."""
    many = " ".join(f"w{i}x" for i in range(70))
    docs = spark.createDataFrame([(1, "tan heron"), (2, many + " tan"), (3, many.replace("w69x", "zz"))], "doc long, text string")
    index = T.postings(docs, "doc", [(F.col("text"), 1.0)])
    searches = spark.createDataFrame([(1, "tan -tan"), (2, many), (3, 'tan -"tan heron"'), (4, "heron tan")], "qid long, text string")
    got = {(r.qid, r.doc): r.cover_rank for r in T.matches(index, T.clauses(searches), "doc").collect()}
    assert set(got) == {(2, 2), (3, 2), (4, 1)} and got[(4, 1)] == 1.0 and got[(2, 2)] == 1.0


def test_close_spellings_meet_by_numbers_and_stop_at_the_page(spark, catalog):
    """No pair of texts is split into grams, and a search keeps no more spellings than may reach its page, with the rows it had."""
    from evidex.plans.search_checks import tables
    from evidex.session import stored

    index = I.build_index(tables(catalog))
    searches = stored(catalog.searches.filter("trim(text) <> ''"), "texted")
    have, need = S._permits(index.tables, searches)
    close = I.close_spellings(index, I._wanted(searches).join(need, "qid"))
    names = {(r.text, r.kind, r.spelling): round(r.near, 9) for r in close.join(searches.select("qid", "text"), "qid").select("text", "kind", "spelling", "near").distinct().collect()}
    spelled = {kind: [r[0] for r in catalog.items.select(kind).distinct().collect()] for kind in I._FLOORS}
    want = {(text, kind, x): round(n, 9) for (text,) in searches.select("text").distinct().collect() for kind, floor in I._FLOORS.items() for x in spelled[kind]
            if (n := brute.similarity(text, x)) > floor}
    assert names == want
    depths = searches.select("qid", F.lit(3).cast("long").alias("depth"))
    none = searches.select("qid", F.lit(0).cast("long").alias("item_id"), "text", F.col("text").alias("name")).withColumnRenamed("text", "code").limit(0)
    every = stored(I.near(index, close, have, None, none).groupBy("qid", "item_id", "code").agg(F.max("near").alias("near")), "every")
    kept = stored(I.near(index, close, have, depths, none).groupBy("qid", "item_id", "code").agg(F.max("near").alias("near")), "kept-near")
    order = [F.desc("near"), F.col("code"), F.col("item_id")]
    first = lambda df: {tuple(r) for r in I._first(df, depths, order, "position").filter("near >= 0.3").drop("depth").collect()}
    assert first(kept) == first(every) and kept.count() < every.count() / 2
