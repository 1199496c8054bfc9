"""Facts stated by hand for cases that no given table has."""

from pyspark.sql import functions as F

from evidex import vocabulary as V
from evidex.functions import urls
from evidex.functions.labels import bare_name
from evidex.operators.evidence import role_priority
from evidex.operators.filters import request_key


def test_request_keys_differ_where_requests_do(spark):
    rows = [(1, "red", ["A,B"]), (2, "red", ["B", "A"]), (3, " red ", ["A", "B", "A"]), (4, None, None), (5, "  ", []), (6, "-", None)]
    df = spark.createDataFrame(rows, "n int, text string, makers array<string>")
    key = {r.n: r.k for r in df.select("n", request_key(F.col("text"), F.lit(40), [F.col("makers")], []).alias("k")).collect()}
    assert key[2] == key[3] and key[4] == key[5] and len({key[1], key[2], key[4], key[6]}) == 4


def test_names_without_padded_codes(spark):
    rows = [("C-5", "C-05 Pewter"), ("PC-27", "PC27 Lagoon"), ("PC-27", "PC-027: Lagoon"), ("PC-2", "PC-27 Lagoon"), ("PC-27", "PC-27"), ("PC-27", "Lagoon")]
    df = spark.createDataFrame(rows, "code string, name string")
    assert [r[0] for r in df.select(bare_name(F.col("code"), F.col("name"))).collect()] == ["Pewter", "Lagoon", "Lagoon", "PC-27 Lagoon", "PC-27", "Lagoon"]


def test_detail_ladder_and_source_suffixes(spark):
    df = spark.createDataFrame([("label_chip",), ("coats_composite",), ("layered",), ("other",)], "role string")
    ranks = df.select(role_priority(F.col("role")), role_priority(F.col("role"), V.DETAIL_PRIORITY)).collect()
    assert [tuple(r) for r in ranks] == [(0, 0), (1, 1), (2, 2), (2, 3)]
    name = spark.createDataFrame([("PC-27_Lagoon-12x12.jpg",)], "f string")
    assert name.select(urls.stem_of(F.col("f"), (urls.CACHE_BUSTER,))).first()[0] == "pc-27_lagoon-12x12"


def test_clay_words_are_those_of_the_clay_found(spark):
    from evidex.operators.filenames import source_a_facts

    df = spark.createDataFrame([("pc-20_99m_16m.jpg", "PC-20", None), ("pc-20_99m.jpg", "PC-20", None)], "filename string, product_code string, product_name string")
    got = [(r.clay, r.evidence.get("clay_body")) for r in source_a_facts(df).select("clay", "evidence").collect()]
    assert got == [(16, "16m"), (None, None)]


def test_carry_forward_by_image(spark):
    from evidex.operators.evidence import carry_forward

    old = spark.createDataFrame([(1, "light", "#1", "a"), (1, "heavy", "#2", "a"), (2, "light", "#3", "b"), (2, "heavy", "#4", "b"), (3, None, None, "c")],
                                "image int, coat string, hex string, cone string")
    new = spark.createDataFrame([(1, None, None, "6"), (2, "light", "#9", "6"), (3, None, None, "6"), (4, None, None, "5"), (None, None, None, "5")], old.schema)
    got = sorted(map(tuple, carry_forward(new, old, ["image"], ["coat", "hex"]).collect()), key=str)
    assert got == sorted([(1, "light", "#1", "6"), (1, "heavy", "#2", "6"), (2, "light", "#9", "6"), (3, None, None, "6"), (4, None, None, "5"), (None, None, None, "5")], key=str)


def test_a_replayed_batch_counts_once(spark, tmp_path):
    import pytest

    from evidex.streaming.batches import BatchTable

    rule = {"v": F.max_by("v", "at"), "at": F.max("at")}
    table = BatchTable(spark, str(tmp_path / "t"), "k long, v string, at long", ["k"], rule)
    assert table.read().count() == 0
    table.append(spark.createDataFrame([(k, "a", 1) for k in range(20)], table.schema), 0)
    torn = spark.createDataFrame([(k, "b", 2) for k in range(5, 25)], table.schema)
    with pytest.raises(Exception, match="lost"):
        table.append(torn.withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))), 1)
    assert {(r.k, r.v) for r in table.read().collect()} == {(k, "a") for k in range(20)}
    for _ in range(2):  # the replayed batch, and once more
        table.append(torn, 1)
        assert {(r.k, r.v) for r in table.read().collect()} == {(k, "a" if k < 5 else "b") for k in range(25)}
    table.append(torn.limit(0), 2)
    assert table.read().count() == 25 and table.read(torn.filter("k in (3, 6)")).count() == 1


def test_runs_of_one_key_cross_slices(spark):
    from evidex.operators.ranges import runs

    cells = [c for c in range(-40, 400) if c % 37 not in (5, 6) and not 100 <= c < 131]
    want, start = [], cells[0]
    for a, b in zip(cells, [*cells[1:], None], strict=True):
        if b != a + 1:
            want.append(("k", start, a, a - start + 1))
            start = b
    df = spark.createDataFrame([("k", c) for c in cells * 2], "k string, cell long")
    for width in (1, 2, 7, 10, 4096):
        assert sorted(map(tuple, runs(df, "k", "cell", width).collect())) == sorted(want)


def test_interval_join_on_any_scale(spark):
    import random

    from evidex.operators.ranges import overlapping

    rng = random.Random(6)
    for low, high in ((1, 36), (-5, 3), (0, 2**41 + 17), (7, 7)):
        def made(n, low=low, high=high):
            ends = [sorted((rng.randint(low, high), rng.randint(low, high))) for _ in range(n)]
            return [(k, rng.choice([None, a, a]), rng.choice([None, b, a])) for k, (a, b) in enumerate(ends)]

        wants, items = made(25), made(40)
        got = overlapping(spark.createDataFrame(wants, "q long, lo long, hi long"), spark.createDataFrame(items, "i long, lo long, hi long"), "q", "i", low, high)
        full = lambda r: (r[0], low if r[1] is None else r[1], high if r[2] is None else r[2])
        want = sorted((a, b) for a, al, ah in map(full, wants) for b, bl, bh in map(full, items) if al <= ah and bl <= bh and al <= bh and bl <= ah)
        assert sorted(map(tuple, got.collect())) == want


def test_totals_of_an_interval_join_make_no_pairs(spark):
    from evidex.operators.ranges import overlapping

    wants = spark.createDataFrame([(1, 0, 9), (1, 5, 5), (2, None, None), (3, 40, 41), (4, 9, 2)], "q long, lo long, hi long")
    items = spark.range(300).selectExpr("id as i", "id % 30 as lo", "case when id % 7 > 0 then id % 30 + id % 5 end as hi")
    pairs = overlapping(wants, items, "q", "i", 0, 63)
    want = sorted(map(tuple, pairs.groupBy("q").agg(F.count(F.lit(1)), F.sum("i"), F.min("i"), F.max("i")).collect()))
    totals = overlapping(wants, items, "q", "i", 0, 63, {"n": "count", "ids": "sum", "least": "min", "most": "max"})
    assert sorted(map(tuple, totals.collect())) == want and [r[0] for r in want] == [1, 2, 3]
    text = totals._jdf.queryExecution().optimizedPlan().toString()  # the items of a node are one row below every join
    assert text.count("Aggregate [node") == 2 and text.index("Join") < text.index("Aggregate [node")


def test_an_interval_join_sends_no_nodes_to_the_driver(spark):
    """A range is many nodes, so a side that the planner takes for small may be large: neither may be broadcast."""
    from evidex.operators.ranges import overlapping

    wants, items = (spark.range(20).selectExpr(f"id as {k}", "id as lo", "id + 3 as hi") for k in ("q", "i"))
    for totals in (None, {"n": "count"}):
        assert "Broadcast" not in overlapping(wants, items, "q", "i", 0, 2**41, totals)._jdf.queryExecution().executedPlan().toString()


def test_late_and_repeated_attempts(spark, tmp_path):
    """An attempt behind a later one or behind the end of its fetch changes nothing; silence is a failure."""
    from datetime import datetime, timedelta

    from evidex.streaming.timed import fetch_stream

    schema = "url string, fetch_no int, attempt int, status int, at timestamp"
    rows = [[("u", 0, 1, 503, 0), ("u", 0, 2, 410, 60), ("v", 0, 2, 503, 60), ("w", 0, 1, 429, 0), ("w", 1, 1, 404, 5)], [("v", 0, 1, 404, 30), ("u", 0, 2, 500, 61), ("v", 0, 3, 503, 400)],
            [("w", 2, 1, 404, 5000), ("x", 0, 1, 304, 5000)], [("x", 1, 1, 304, 90000)]]
    for part in rows:
        spark.createDataFrame([(*r[:4], datetime(2024, 1, 1) + timedelta(seconds=r[4])) for r in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = fetch_stream(log).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("url", "fetch_no", "attempts", "outcome").collect())
    assert got == [("u", 0, 2, "gone"), ("v", 0, 3, "failed"), ("w", 0, 1, "failed"), ("w", 1, 1, "gone"), ("w", 2, 1, "gone"), ("x", 0, 1, "unchanged"), ("x", 1, 1, "unchanged")]


def test_funnel_equals_the_tables(spark, catalog):
    from evidex.operators.replay import replay_pages, replay_payloads

    for found in (replay_payloads(catalog.json_products.withColumnRenamed("p_partkey", "url")), replay_pages(catalog.product_pages.withColumnRenamed("p_partkey", "url"))):
        levels = {r["confidence"]: r["count"] for r in found.images.groupBy("confidence").count().collect()}
        assert found.funnel == {"bodies": found.products.count() + found.dead_letters.count(), "products": found.products.count(), "dead_letters": found.dead_letters.count(),
                                "images": found.images.count(), **{k: levels.get(k, 0) for k in ("high", "medium", "low")}}


def test_detail_contract(spark, catalog):
    from evidex.operators import detail as D
    from evidex.operators.quality import schema_contract

    refs = spark.createDataFrame([(1, " ASIA", "pc-20 "), (2, "asia", "PC-20"), (3, "asia", "none"), (4, None, "PC-20")], "ref_id int, maker string, code string")
    rows = D.detail_rows(D.DetailTables(catalog.items, catalog.makers, catalog.full_evidence, catalog.clay_families), refs)
    kinds = rows.select(*D.DETAIL_ROW.names)
    assert schema_contract(kinds, D.DETAIL_ROW) == [] and len(D.DETAIL_ROW) == 19
    by_ref = {r["ref_id"]: r["n"] for r in rows.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(by_ref) == {1, 2} and by_ref[1] == by_ref[2] > 0


def test_detail_rows_without_and_with_repeated_labels(spark):
    """Rows are numbered as they are listed: a clay or base that stands twice gives two rows; no clay, no base and a missing one give one."""
    from evidex.operators import detail as D

    items = spark.createDataFrame([(1, 0, "A-1", "one"), (2, 0, "A-2", "two"), (3, 0, "A-3", "three"), (3, 0, "A-3", "three")], "item_id long, maker_id int, code string, name string")
    makers = spark.createDataFrame([(0, "m")], "maker_id int, maker_key string")
    clays = spark.createDataFrame([(7, "seven", "x"), (7, "seven", "x"), (8, "eight", "y"), (None, "none", "z")], "clay long, clay_name string, clay_family string")
    rows = [("a", 1, 7, None), ("b", 1, 8, None), ("c", 1, 9, 3), ("d", 1, None, 2), ("e", 1, None, None), ("f", None, 7, 3), ("g", 2, None, 5)]
    evidence = spark.createDataFrame(rows, "ev_id string, item_id long, clay long, layered_over long").withColumns({"coat": F.lit(1), "role": F.lit("other"), "cone_no": F.lit(1)})
    evidence = evidence.withColumns({f.name: F.lit(None).cast(f.dataType) for f in D.DETAIL_ROW if f.name not in (*evidence.columns, "clay_name", "clay_family", "base_name", "coat_name", "cone")})
    refs = spark.createDataFrame([(10, "M", "a-1"), (11, "m", "A-1"), (12, "m", "A-2")], "ref_id int, maker string, code string")
    found = D.detail_rows(D.DetailTables(items, makers, evidence, clays), refs)
    got = sorted((r["ref_id"], r["place"], r["ev_id"], r["clay_name"], r["base_code"]) for r in found.collect())
    one = [(1, "a", "seven", None), (2, "a", "seven", None), (3, "b", "eight", None), (4, "c", None, "A-3"), (5, "c", None, "A-3"), (6, "d", None, "A-2"), (7, "e", None, None)]
    assert got == [(10, *r) for r in one] + [(11, *r) for r in one] + [(12, 1, "g", None, None)]


def test_every_items_evidence_is_listed(catalog):
    from evidex.plans import load_checks

    listed = load_checks()["evidence_listing_all"].run(catalog)
    known = catalog.evidence.join(catalog.items.join(catalog.makers, "maker_id"), "item_id", "left_semi")
    assert listed.count() == known.count() and listed.select("item_id").distinct().count() == known.select("item_id").distinct().count() > 3


def test_whole_passages_are_searched(spark, catalog):
    from evidex.operators import postings as T

    asked = catalog.passage_searches
    assert asked.count() == 4 * catalog.table("benchmark").count()
    assert asked.filter("qid % 4 = 1").selectExpr("min(size(split(text, ' '))) n").first()["n"] >= 15
    words = [f"w{k}q" for k in range(80)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[1:])), (3, " ".join(reversed(words)))], "doc_id long, text string")
    searches = spark.createDataFrame([(1, " ".join(words)), (2, '"' + " ".join(words) + '"'), (3, words[1] + ' -"' + " ".join(words) + '"'), (4, " ".join(words[1:]) + " -" + words[0])], "qid long, text string")
    found = T.matches(T.postings(docs, "doc_id", [(docs.text, 1.0)]), T.clauses(searches), "doc_id")
    assert {(r["qid"], r["doc_id"]) for r in found.collect()} == {(1, 1), (1, 3), (2, 1), (3, 2), (3, 3), (4, 2)}


def test_a_document_meets_only_searches_whose_rarest_word_it_holds(spark):
    """No row is made per word of a search, and words that no document has bar nothing."""
    from evidex.operators import postings as T

    docs = spark.createDataFrame([(1, "red kiln red glaze"), (2, "kiln glaze red"), (3, "glaze kiln"), (4, None), (5, "red")], "doc_id long, text string")
    rows = [(1, "red kiln"), (2, '"kiln glaze"'), (3, "glaze -red"), (4, 'red -"kiln glaze"'), (5, "red unheard"), (6, 'red -"kiln unheard"'), (7, "red -red"), (8, "unheard or kiln"), (9, '"red red"'), (10, "-red")]
    searches = spark.createDataFrame(rows, "qid long, text string")
    found = T.matches(T.postings(docs, "doc_id", [(docs.text, 1.0)]), T.clauses(searches), "doc_id")
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "keys=[qid" not in text and text.count("keys=[doc_id") > 0
    got = {}
    for r in found.collect():
        got.setdefault(r["qid"], {})[r["doc_id"]] = r["cover_rank"]
    assert {q: set(d) for q, d in got.items()} == {1: {1, 2}, 2: {2}, 3: {3}, 4: {1, 5}, 6: {1, 2, 5}, 8: {1, 2, 3}}
    assert got[1][1] == 2.0 and got[4] == {1: 2.0, 5: 1.0} and got[2][2] == 1.0


def test_pages_are_not_broadcast(spark, catalog):
    """A page is a hundred times the row it is derived from, so file sizes say nothing about it."""
    from evidex.sources import html_pages as H

    fields = H.product_fields(catalog.product_pages, ["p_partkey"], "body")
    text = fields._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in text and text.count("SortMergeJoin") == 1
    assert fields.filter("description is not null and name <> ''").count() > 0
    found = catalog.product_pages._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p_partkey" in found


def test_latest_stream_over_batches_with_missing_tickets_and_keys(spark, tmp_path):
    """Keys share calls of Python and keep their own best; a missing ticket is neither best nor stale."""
    from evidex.streaming.keyed import latest_stream

    schema = "user_id long, us long, event_id long, ticket long"
    big = 2**53 + 1
    parts = [[(1, 1, 1, 5), (1, 2, 2, 3), (2, 1, 3, big), (None, 1, 4, 7)], [(1, 3, 5, 4), (2, 2, 6, big - 1), (None, 2, 7, 6), (3, 1, 8, 1)], [(1, 4, 9, 9), (1, 5, 10, None), (4, 1, 11, None)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    (latest_stream(log, "user_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
     .trigger(availableNow=True).start().awaitTermination())
    got = {r.event_id: (r.user_id, r.ticket, r.stale) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k for k, v in got.items() if v[2]} == {2, 5, 6, 7}
    assert {k: v[:2] for k, v in got.items()} == {r[2]: (r[0], r[3]) for part in parts for r in part if r[2] != 3 and r[2] != 6} | {3: (2, big), 6: (2, big - 1)}


def test_picture_files_are_written_by_many_tasks(catalog, tmp_path, monkeypatch):
    from evidex.plans import extraction_checks as X

    monkeypatch.setattr(X, "shared_dir", lambda spark, name: str(tmp_path / name))
    X.content_files(catalog)
    files = list((tmp_path / "pictures").glob("owner=*/part-*"))
    assert len(files) == catalog.table("supplier").count()
    assert len({f.name.split("-")[1] for f in files}) > 1


def test_similar_to_reads_stored_answers(spark, catalog):
    """Repeated and missing ids count as in a join of features; few items asked for are looked up, many are found from the features."""
    from collections import Counter

    from evidex.operators import detail as D
    from evidex.operators import search as S
    from evidex.operators import sqlapi
    from evidex.plans.search_checks import tables

    ids = [None if n == 3 else n % 37 for n in range(40)]
    rows = [(i, f"PC-{n % 5}", ["red", "ash", "mud"][: 1 + n % 3], n % 3, None if n % 4 == 0 else n % 2, f"L{n % 2}", n % 4) for n, i in enumerate(ids)]
    items = spark.createDataFrame(rows, "item_id bigint, code string, terms array<string>, surface int, opacity int, line string, maker_id int")
    whole = catalog.items.drop("terms", "surface", "opacity", "line", "maker_id", "code").limit(1).drop("item_id")
    t = tables(catalog)
    t = S.Tables(items.crossJoin(whole).select(*catalog.items.columns), t.makers, t.evidence, t.clays)
    hits = S.project_hit(items.select(F.col("item_id").alias("qid"), F.lit(1).alias("position"), "item_id", F.lit("match").alias("tier"), F.lit(1.0).alias("rank")), t, keep=("qid", "position"))
    sqlapi.register_tables(t, D.DetailTables(t.items, t.makers, catalog.full_evidence, catalog.clay_families), hits)

    def features(row):
        _, _, terms, surface, opacity, line, _ = row
        return [("t", x, 3) for x in terms] + [("s", surface, 2)] + ([("o", opacity, 2)] if opacity is not None else []) + [("l", line, 1)]

    def best(asked, k):
        score = Counter()
        for a in rows:
            for b in rows:
                if a[0] == asked and b[0] is not None and b[0] != asked:
                    score[b[0], b[1]] += sum(w for *f, w in features(a) if (*f, w) in features(b))
        found = sorted((-n, code, item) for (item, code), n in score.items() if n)
        return [(item, -n, at + 1) for at, (n, code, item) in enumerate(found[:k])]

    for k in (3, sqlapi.SIMILAR_DEPTH + 8):
        got = {}
        df = spark.sql(f"select n.item_id asked, s.* from (select distinct item_id from evidex_features where item_id is not null) n, lateral similar_to(n.item_id, {k}) s")
        for r in df.collect():
            got.setdefault(r.asked, []).append((r.item_id, r.score, r.position))
        assert {a: sorted(v, key=lambda x: x[2]) for a, v in got.items()} == {a: best(a, k) for a in set(ids) - {None}}
        # asked for few, no pair of items is made
        assert ("Window" in df._jdf.queryExecution().optimizedPlan().toString()) == (k > sqlapi.SIMILAR_DEPTH)


def test_links_wait_in_groups_of_codes(spark, tmp_path):
    """Evidence of several batches waits for its item, in whichever order they come; codes are dealt to groups, not called one by one."""
    from evidex.streaming.timed import link_stream

    named = [[("e1", 1, 0, "A"), ("e2", 2, 1, "A"), ("e3", 3, 0, "B")], [("e4", 4, 0, "A"), ("e5", 9, 0, "A"), ("e6", 5, 0, "C")], [("e7", 6, 0, "A"), ("e8", 7, 1, "A"), ("e9", 8, 0, "")]]
    known = [[(70, 0, None)], [(71, 0, "Z")], [(9, 0, "A"), (3, 0, "B")], [(8, 1, "A"), (72, 0, "")]]
    streams = []
    for kind, parts, schema in (("named", named, "ev_id string, item_id bigint, maker_id int, base_code string"), ("known", known, "item_id bigint, maker_id int, code string")):
        for part in parts:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
        streams.append(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / kind)))
    links = link_stream(*streams)
    assert "key_group" in links._jdf.queryExecution().analyzed().toString()
    out = str(tmp_path / "out")
    links.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == [("e1", 1, "A", 9), ("e2", 2, "A", 8), ("e4", 4, "A", 9), ("e7", 6, "A", 9), ("e8", 7, "A", 8)]
