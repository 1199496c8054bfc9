"""Plan shapes: what must and must not be in the physical plans."""

import pytest
from pyspark.sql import functions as F

from evidex.operators import evidence as E
from evidex.operators import filters as P
from evidex.operators import paging as G
from evidex.operators import search as S
from evidex.operators import similar
from evidex.plans import load_checks
from evidex.plans.search_checks import tables
from evidex.session import literal_table
from evidex.vocabulary import cones

CHECKS = load_checks()
#: what these do cannot be said in expressions: state machines and a numeric solver
PYTHON = {"two_means_color", "stream_change_detect", "stream_latest", "stream_marks"}
#: streams and stored intermediates run while the query is built
EAGER = {name for name in CHECKS if name.startswith("stream_")} | {
    "ranked_search", "bulk_replay", "change_detect", "page_index", "publish_items", "marks_with_fallback", "marks_in_order", "index_search", "search_edges", "similar_items", "similar_hits", "lookup_hits", "sql_functions", "replay_rows", "replay_funnel", "replay_pages"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(CHECKS) - EAGER))
def test_no_cross_joins_and_no_python(catalog, name):
    text = plan(CHECKS[name].run(catalog))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON:
        assert "Python" not in text and "Pandas" not in text


def test_facets_reach_the_scan(catalog):
    text = plan(catalog.table("part").filter(F.col("p_type").isin("SMALL", "LARGE")).select("p_partkey"))
    assert "PushedFilters: [In(p_type" in text and "ReadSchema: struct<p_partkey:bigint,p_type:string>" in text
    only = plan(P.facets(catalog.items, {"line": ["SMALL"], "surface": None, "maker_id": []}).select("item_id"))
    assert "EqualTo(p_type,SMALL)" in only and "p_size" not in only


def test_evidence_is_semi_joined_before_it_is_aggregated(catalog):
    rows = catalog.items.select("item_id", "code", F.lit("match").alias("tier"), F.lit(1.0).alias("rank"))
    text = plan(E.roll_up(catalog.evidence, catalog.clay_vocab, only=G.page(rows, 40)))
    # Plans print from the result down: the aggregate stands above the semi-join.
    assert "LeftSemi" in text and text.index("min_by") < text.index("LeftSemi")
    assert "TakeOrderedAndProject" in text


def test_top_k_is_limited_before_the_shuffle(catalog):
    t = tables(catalog)
    found = S.scored(t, catalog.searches).withColumnRenamed("qid", "rep")
    from pyspark.sql import Window

    w = Window.partitionBy("rep").orderBy("tier", F.desc("rank"), "code", "item_id")
    assert "WindowGroupLimit" in plan(found.withColumn("n", F.row_number().over(w)).filter("n <= 40"))
    profiles, lists = similar._profiles(similar.features(catalog.items), 12, 10_000)
    assert "WindowGroupLimit" in plan(similar._read(profiles.select("profile", "numbers", "reading"), lists, 0, 1, 12))


def test_vocabularies_are_local_relations(spark, catalog):
    assert "LocalTableScan" in plan(cones(spark))
    assert "LocalTableScan" in plan(literal_table(spark, "a int, b string", [(1, "x'y"), (2, None)]))
    joined = catalog.items.join(cones(spark).withColumnRenamed("ordinal", "lo"), "lo", "left")
    assert "BroadcastHashJoin" in plan(joined)


def test_bodies_are_hashed_once_and_marks_scanned_once(spark, catalog):
    from evidex.operators import folds, snapshots
    from evidex.plans.windows_checks import NOISE

    text = plan(snapshots.outcomes(catalog.snapshots, NOISE))
    assert "sha2" not in text and "html" not in text
    assert plan(folds.mark_fold(catalog.marks_log)).count("FileScan parquet") <= 2


def test_only_asked_postings_are_spread(spark, catalog):
    from evidex.operators import postings as T
    from evidex.plans.search_checks import doc_postings

    text = plan(T.matches(doc_postings(catalog), T.clauses(catalog.doc_searches), "doc_id"))
    at = text.index("REPARTITION_BY_NUM")
    assert "LeftSemi" in text[at:at + 2500]


def test_detail_rows_move_whole_rows_once_besides_those_with_a_label(spark, catalog):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = CHECKS["detail_rows"].run(catalog)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    joins = [line for line in text.splitlines() if "Join LeftOuter" in line]
    assert any("(clay#" in j for j in joins) and any("(layered_over#" in j for j in joins)
    assert "Union" in text and text.index("row_number") < text.index("Union")


def test_replays_are_dealt_out_before_they_are_parsed(spark, catalog):
    """A log of few bytes in one task; its bodies and images are still parsed by several."""
    from evidex.operators.replay import replay_pages, replay_payloads

    logs = [df.withColumnRenamed("p_partkey", "url").coalesce(1) for df in (catalog.json_products, catalog.product_pages)]
    payloads, pages = replay_payloads(logs[0]), replay_pages(logs[1])
    assert all(len(df.inputFiles()) > 1 for df in (payloads.products, payloads.images, pages.images))


def test_replayed_urls_may_repeat(spark):
    from evidex.operators.replay import replay_payloads

    body = '[{"sku": "SW-1", "name": "a", "images": [{"src": "https://e.example/sw1_cone6.jpg"}]}]'
    log = spark.createDataFrame([("u", body), ("u", body), ("v", body), (None, body), ("w", "[")], "url string, body string")
    found = replay_payloads(log)
    assert found.products.count() == 4 and [r[0] for r in found.dead_letters.collect()] == ["w"]
    assert sorted(r["url"] for r in found.images.collect()) == ["u"] * 4 + ["v"]
