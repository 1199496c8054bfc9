"""Operators against brute force and published values on small inputs."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from evidex.functions.color import reading_words, with_delta_e
from evidex.functions.intervals import overlaps, register_sql
from evidex.functions.text import clean_text, trigram_similarity
from evidex.operators import aggregates, filenames, folds, merge, quality, ranges, snapshots
from evidex.operators.fuzzy import similar_texts
from evidex.operators.ordered import ordered_scan
from evidex.operators.paging import keyset_page, page
from evidex.vocabulary import COLOR_TERMS, CONE_NAMES


# --- ordered scans -------------------------------------------------------------------------------
def test_ordered_scan_equals_plain_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaab"), t, rng.choice([None, rng.randint(0, 9)])) for t in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    want = {"n": ("row_number", ""), "b": ("lag", "v"), "f": ("lead", "v"), "l": ("running_last", "v"), "s": ("running_sum", "v"),
            "m": ("running_max", "v"), "p": ("prior_max", "v"), "ts": ("total_sum", "v"), "tm": ("total_max", "v"), "ti": ("total_min", "v")}
    got = ordered_scan(df, ["k"], ["t"], F.floor(F.col("t") / 100), want)
    w = Window.partitionBy("k").orderBy("t")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("k")
    plain = df.select("k", "t", "v", F.row_number().over(w).cast("long").alias("n"), F.lag("v").over(w).alias("b"), F.lead("v").over(w).alias("f"),
                      F.last("v", True).over(upto).alias("l"), F.sum("v").over(upto).alias("s"), F.max("v").over(upto).alias("m"),
                      F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("p"), F.sum("v").over(whole).alias("ts"),
                      F.max("v").over(whole).alias("tm"), F.min("v").over(whole).alias("ti"))
    assert sorted(map(tuple, got.select(plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


# --- folds ---------------------------------------------------------------------------------------
def brute_marks(events):
    state, fav, note = None, False, None
    for action, text in events:
        if action == "clear":
            state, fav, note = None, False, None
        elif action == "own":
            state = "owned"
        elif action == "wish":
            state, fav = "wishlist", False
        elif action == "toggle":
            fav = (not fav) if state == "owned" else fav
        elif state is not None:
            note = (text or "").strip() or None
    return None if state is None else (state, fav, note)


def test_mark_fold_equals_a_sequential_fold(spark):
    rng = random.Random(5)
    rows = []
    for key in range(80):
        for i in range(rng.randint(1, 14)):
            action = rng.choice(["own", "wish", "toggle", "toggle", "note", "clear"])
            rows.append((key, rng.randint(0, 3) * 86_400_000_000 + i, i, action, rng.choice([None, " ", f"n{i}"]) if action == "note" else None))
    df = spark.createDataFrame(rows, "key long, us long, event_id long, action string, note string")
    want = {}
    for key in range(80):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        out = brute_marks([(r[3], r[4]) for r in mine])
        if out:
            want[key] = out
    got = {r.key: (r.state, r.favorite, r.note) for r in folds.mark_fold(df).collect()}
    assert got == want


def test_marks_stream_equals_a_sequential_fold(spark, tmp_path):
    """In batches that cut a key's events anywhere."""
    from evidex.streaming.keyed import marks_stream

    rng = random.Random(15)
    schema = "key long, us long, event_id long, action string, note string"
    rows = [(k, i, i, rng.choice(["own", "wish", "toggle", "toggle", "note", "clear"]), rng.choice([None, " ", f"n{i} "])) for k in range(60) for i in range(rng.randint(1, 16))]
    for low, high in ((0, 2), (2, 7), (7, 99)):
        spark.createDataFrame([r for r in rows if low <= r[1] < high], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def step(batch, number):
        batch.write.mode("overwrite").parquet(str(tmp_path / f"out/n={number}"))

    marks_stream(log).writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).groupBy("key").agg(F.max_by(F.struct("state", "favorite", "note"), "seq").alias("m")).collect()
    got = {r.key: tuple(r.m) for r in out if r.m.state is not None}
    want = {k: brute_marks([(r[3], r[4] if r[3] == "note" else None) for r in rows if r[0] == k]) for k in range(60)}
    assert got == {k: v for k, v in want.items() if v}


def test_status_never_regresses(spark):
    log = spark.createDataFrame([(1, 1, 1, "glazing"), (1, 2, 2, "throwing"), (1, 3, 3, "note"), (1, 90_000_000_000, 4, "finished")], "piece long, us long, event_id long, stage string")
    assert [r.status for r in folds.status_progress(log).orderBy("us").collect()] == ["glazed", "glazed", "glazed", "finished"]


# --- colour --------------------------------------------------------------------------------------
PAIRS = [  # Sharma, Wu, Dalal (2005), supplementary test data
    ((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615),
    ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((50, 0, 0), (50, -1, 2), 2.3669), ((50, 2.49, -0.001), (50, -2.49, 0.0009), 7.1792),
    ((50, 2.49, -0.001), (50, -2.49, 0.0011), 7.2195), ((50, -0.001, 2.49), (50, 0.0009, -2.49), 4.8045), ((50, 2.5, 0), (50, 0, -2.5), 4.3065),
    ((50, 2.5, 0), (73, 25, -18), 27.1492), ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((63.0109, -31.0961, -5.8663), (62.8187, -29.7946, -4.0864), 1.2630), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082),
]


def test_delta_e_published_pairs_and_symmetry(spark):
    rows = [(*map(float, a), *map(float, b), want) for a, b, want in PAIRS]
    df = spark.createDataFrame(rows, "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    out = with_delta_e(with_delta_e(df, ("l1", "a1", "b1"), ("l2", "a2", "b2"), "d"), ("l2", "a2", "b2"), ("l1", "a1", "b1"), "back").collect()
    for r in out:
        assert r.d == pytest.approx(r.want, abs=5e-5) and r.back == pytest.approx(r.d, abs=1e-9)


def test_reading_words_family_follows_term(spark):
    df = spark.createDataFrame([(1, 66.0, -14.0, 14.0, 24.0, 12.0, 16.0), (2, 5.0, 120.0, -120.0, None, None, None)], "id long, l double, a double, b double, l2 double, a2 double, b2 double")
    got = {r.id: r.words for r in reading_words(df, "id", [("l", "a", "b", 3), ("l2", "a2", "b2", 1)], COLOR_TERMS).collect()}
    assert got[1][:2] == ["sage", "green"] and got[1][-2:] == ["tenmoku", "brown"] and "temmoku" not in got[1]
    assert got.get(2, []) == []


def test_dominant_colour_leaves_background_out(spark):
    rows = [(1, 255, 255, 255)] * 100 + [(1, 10, 20, 30)] * 40 + [(1, 200, 20, 30)] * 10 + [(2, 250, 250, 250)] * 5
    top = aggregates.dominant_colors(spark.createDataFrame(rows, "image int, r int, g int, b int"), "image").collect()
    assert {(r.image, r.place, r.n, r.r) for r in top} == {(1, 1, 40, 10.0), (1, 2, 10, 200.0), (2, 1, 5, 250.0)}


# --- text, ranges, vocabulary ---------------------------------------------------------------------
def test_trigram_similarity_and_cleaning(spark):
    df = spark.sql("select 'word' a, 'two words' b, '<p>Stroke &amp;amp; Coat&reg;&nbsp; 1222&deg;C &#174; &#x41; &unknown; &lt;b&gt;</p>' h")
    r = df.select(F.round(trigram_similarity(F.col("a"), F.col("b")), 4).alias("s"), clean_text(F.col("h")).alias("t")).first()
    assert r.s == 0.3636 and r.t == "Stroke &amp; Coat® 1222°C ® A &unknown; <b>"


def test_fuzzy_join_equals_all_pairs(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    left, right = spark.createDataFrame([(w,) for w in words[:25]], "x string"), spark.createDataFrame([(w,) for w in words], "y string")
    for t in (0.25, 0.6):
        got = {(r.x, r.y_match) for r in similar_texts(left, "x", right, "y", t).collect()}
        every = left.distinct().crossJoin(right.distinct()).filter(trigram_similarity(F.col("x"), F.col("y")) > t)
        assert got == {(r.x, r.y) for r in every.collect()}


def test_overlap_table(spark):
    cases = [(1, 5, None, None, True), (None, None, 3, 3, True), (5, 9, 9, 12, True), (5, 9, 10, None, False), (None, 4, 5, 6, False), (4, None, 30, 31, True)]
    df = spark.createDataFrame(cases, "lo int, hi int, a int, b int, want boolean")
    register_sql(spark)
    both = df.select("want", overlaps(F.col("lo"), F.col("hi"), F.col("a"), F.col("b")).alias("x"), F.expr("range_overlaps(lo, hi, a, b)").alias("y"))
    assert all(r.want == r.x == r.y for r in both.collect())


def test_range_join_equals_all_pairs(spark):
    rng = random.Random(4)
    def rows(n):
        out = []
        for i in range(n):
            lo = rng.choice([None, rng.randint(1, 36)])
            out.append((i, lo, rng.choice([None, (lo or 1) + rng.randint(0, 6)])))
        return out
    a = spark.createDataFrame(rows(30), "q long, lo int, hi int")
    b = spark.createDataFrame(rows(60), "i long, lo int, hi int")
    got = sorted(map(tuple, ranges.overlapping(a, b, "q", "i").collect()))
    x, y = a.withColumnsRenamed({"lo": "al", "hi": "ah"}), b
    want = x.crossJoin(y).filter(overlaps(F.col("lo"), F.col("hi"), F.coalesce("al", F.lit(1)), F.coalesce("ah", F.lit(36)))).select("q", "i")
    assert got == sorted(map(tuple, want.collect()))


def test_scale_order():
    assert len(CONE_NAMES) == 36 and CONE_NAMES.index("05") < CONE_NAMES.index("5") and CONE_NAMES[0] == "022" and CONE_NAMES[-1] == "14"


# --- file names ------------------------------------------------------------------------------------
def second_source_case(rng):
    """(file name, product, alt, facts) put together from the parts that the second grammar knows."""
    spell = lambda prefix, digits: f"{prefix.upper()}-{digits}"
    codes = rng.sample([(p, d) for p in ("kv", "rdx", "q") for d in ("7", "041", "903", "12")], rng.choice([0, 1, 1, 2, 2, 2, 3]))
    named, way = [spell(*c) for c in codes], rng.choice(["over", "under"]) if len(codes) == 2 else "over"
    spelt = [p + rng.choice(["", "-"]) + d for p, d in codes]
    written = "_".join([f"_{way}_".join(spelt[:2]), *spelt[2:]])
    cone, coats, form = rng.choice([None, "5", "06", "10"]), rng.choice([None, None, "3"]), rng.choice([None, None, "bowl", "tile", "plate"])
    noise, strange, chart = rng.sample(["web", "final", "crop"], rng.randint(0, 2)), rng.sample(["velvet", "harbour"], rng.randint(0, 2)), rng.random() < 0.1
    parts = [written, f"cone{cone}" if cone else "", f"{coats}coats" if coats else "", form or "", *noise, *strange, "lineup" if chart else ""]
    alt = rng.choice([None, None, "", "Brown clay, Cone 04"])
    product = rng.choice([*named, "KV-555"]) if named else "KV-555"
    top, base = (named if way == "over" else named[::-1]) if len(named) == 2 else (None, None)
    layered = base if base and product != base else None
    combination = named if len(named) > 1 and not layered else []
    unmatched = strange if not alt else list(dict.fromkeys([*strange, "brown", "clay"]))
    role = ("line_chart" if chart else "layered" if layered else "other" if combination or coats else "in_use" if form in ("bowl", "plate")
            else "label_chip" if len(named) == 1 or form == "tile" else "other")
    return ("_".join(x for x in parts if x) + rng.choice([".jpg", "-scaled.jpg", ".JPG"]), product, alt,
            {"subject": top or (product if product in named else named[0] if named else product), "layered_over": layered, "combination": combination, "cone": cone or ("04" if alt else None), "coats": coats,
             "form": {"tile": "flat_tile"}.get(form, form), "role": role, "unmatched": unmatched, "confidence": "low" if combination else "medium" if not named or unmatched else "high"})


def first_source_case(rng):
    """The same for the first grammar, which knows its prefixes."""
    codes = rng.sample([(p, d) for p in ("PC", "LUG", "sm", "V") for d in ("7", "41", "093")], rng.choice([0, 1, 1, 1, 2, 2]))
    named = [f"{p.upper()}-{int(d)}" for p, d in codes]
    pair = len(codes) == 2 and rng.random() < 0.7
    joint = rng.choice(["over", "_over_", "-over-"]) if pair else "_"
    written = joint.join(p + rng.choice(["", "-", "_"]) + d for p, d in codes)
    kind = rng.choice(["", "", "", "application-tiles", "colour-chart"])
    form = rng.choice([None, None, "Mug", "Vase", "chip", "LabelTile"])
    cone, clay = rng.choice([None, "6", "05"]), rng.choice([None, 38, 25])
    name, noise, strange = rng.choice(["Harbour Fog", None]), rng.sample(["web", "hires", "final"], rng.randint(0, 2)), rng.sample(["medina", "blick"], rng.randint(0, 1))
    parts = [written, f"Cone{cone}" if cone else "", f"{clay}M" if clay else "", kind, form or "", rng.choice(["HarbourFog", "Fog"]) if name else "", *noise, *strange]
    product = rng.choice([*named, "PC-555"]) if named else "PC-555"
    vessel = form in ("Mug", "Vase")
    role = ("line_chart" if "chart" in kind else "coats_composite" if "tiles" in kind else "layered" if pair else "in_use" if vessel else "label_chip" if form or len(named) == 1 else "other")
    subject = None if role == "line_chart" else named[0] if pair else product if product in named else named[0] if len(named) == 1 else product
    combination = named if len(named) == 2 and not pair else []
    return ("_".join(x for x in parts if x) + ".jpg", product, f"{product} {name}" if name else None,
            {"subject": subject, "layered_over": named[1] if pair else None, "combination": combination, "cone": cone, "clay": clay, "role": role,
             "form": {"Mug": "mug", "Vase": "vase", "chip": "flat_tile", "LabelTile": "textured_tile"}.get(form, None), "unmatched": strange,
             "confidence": "low" if subject is None or combination or not named else "medium" if strange else "high"})


@pytest.mark.parametrize("case,facts,third", [(second_source_case, filenames.source_b_facts, "alt"), (first_source_case, filenames.source_a_facts, "product_name")])
def test_file_names_built_from_their_grammar(spark, case, facts, third):
    rng = random.Random(8)
    made = [case(rng) for _ in range(400)]
    df = spark.createDataFrame([(n, *c[:3]) for n, c in enumerate(made)], f"n int, filename string, product_code string, {third} string")
    wrong = [(made[r.n][:3], {k: (r[k], v) for k, v in made[r.n][3].items() if r[k] != v}) for r in facts(df).collect() if any(r[k] != v for k, v in made[r.n][3].items())]
    assert not wrong, wrong[:3]


# --- merges, quality, snapshots, paging ---------------------------------------------------------------
def test_running_a_merge_twice_changes_nothing(spark):
    schema = "k string, a string, b string, c long"
    policy = {"a": "take_new", "b": "coalesce", "c": "greatest"}
    old = spark.createDataFrame([("x", "1", "keep", 5), ("y", "2", None, 9)], schema)
    new = spark.createDataFrame([("x", None, None, 7), ("z", "3", "n", 1), ("z", "4", "m", 2)], schema)
    once = merge.upsert(old, new, ["k"], policy, ["c"])
    twice = merge.upsert(once, new, ["k"], policy, ["c"])
    want = {("x", None, "keep", 7), ("y", "2", None, 9), ("z", "4", "m", 2)}
    assert set(map(tuple, once.collect())) == want == set(map(tuple, twice.collect()))


def test_resolved_issues_do_not_block(spark):
    schema = "maker_id int, kind string, subject string, opened_s long, seen_s long, detail string, resolved_s long"
    queue = spark.createDataFrame([(1, "k", "s", 1, 1, "old", 2), (1, "k", "t", 1, 1, "old", None)], schema)
    found = spark.createDataFrame([(1, "k", "s", 9, 9, "new", None), (1, "k", "t", 9, 9, "new", None), (2, "k", "t", 9, 9, "new", None)], schema)
    rows = {(r.maker_id, r.subject, r.opened_s, r.detail, r.resolved_s) for r in merge.upsert_issues(queue, found).collect()}
    assert rows == {(1, "s", 1, "old", 2), (1, "s", 9, "new", None), (1, "t", 1, "new", None), (2, "t", 9, "new", None)}


def test_schema_contract(spark):
    df = spark.createDataFrame([], "a int, b string")
    assert quality.schema_contract(df, df.schema) == []
    assert quality.schema_contract(df.select("b", "a"), df.schema) == ["columns are in another order"]
    assert "missing b string" in quality.schema_contract(df.select("a"), df.schema)


def test_outcome_table(spark):
    log = spark.createDataFrame([("u", i, 100 + 86_400 * i, s, b) for i, (s, b) in enumerate([(200, "a"), (200, "a"), (304, ""), (200, "b"), (404, ""), (500, ""), (403, ""), (200, "b"), (200, "a")])],
                                "url string, id long, fetched_s long, status int, body string")
    got = [r.outcome for r in snapshots.outcomes(log).orderBy("id").collect()]
    assert got == ["stored", "unchanged", "unchanged", "stored", "gone", "retried", "failed", "unchanged", "stored"]
    assert snapshots.doomed(log, 0).count() == 8 and snapshots.doomed(log, 20).count() == 0


def test_pages_concatenate_to_the_whole(spark):
    rows = [(i, f"C-{i % 5}", "match" if i % 3 else "near", 1.0) for i in range(57)]
    df = spark.createDataFrame(rows, "item_id long, code string, tier string, rank double")
    whole = [r.item_id for r in page(df, 100).collect()]
    assert [r.item_id for o in range(0, 60, 10) for r in page(df, 10, o).collect()] == whole and len(set(whole)) == 57
    assert page(df, -3, -1).count() == 0 and [r.item_id for r in page(df, 2, -5).collect()] == whole[:2]
    seen, last = [], None
    while rows := keyset_page(df, 10, last).collect():
        seen += [r.item_id for r in rows]
        last = (rows[-1].tier, rows[-1].rank, rows[-1].code, rows[-1].item_id)
    assert seen == whole


def test_split_is_three_boxes_or_a_reason(spark):
    blocks = spark.createDataFrame([(1, 0, 9), (1, 20, 29), (1, 40, 49), (2, 0, 9), (3, 0, 9), (3, 20, 50), (3, 60, 69)], "k long, first long, last long")
    got = {r.k: (r.ok, r.reason, r.boxes and [(b.left, b.right) for b in r.boxes]) for r in ranges.split_or_refuse(blocks, "k").collect()}
    assert got[1] == (True, None, [(0, 16), (16, 33), (33, 50)])
    assert got[2] == (False, "expected 3 parts, found 1", None) and got[3] == (False, "parts disagree on width", None)


def test_similar_texts_splits_no_text_per_pair(spark):
    """Pairs meet by stored lists of grams, come once each, and keep the similarity of the texts."""
    words = ["red", "gear", "gears", "reds", "green gear", "pc-1", "pc-12", "pc-123", "", None]
    texts = spark.createDataFrame([(w,) for w in words + words], "x string")
    found = similar_texts(texts, "x", texts.withColumnRenamed("x", "y"), "y", 0.3)
    assert "regexp_extract_all" not in found._jdf.queryExecution().executedPlan().toString()
    known = [w for w in words if w]
    both = spark.createDataFrame([(a, b) for a in known for b in known], "x string, y string").select("x", "y", trigram_similarity(F.col("x"), F.col("y")).alias("s")).filter("s > 0.3")
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in both.collect())
