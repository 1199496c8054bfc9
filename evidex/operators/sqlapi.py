"""The catalog for SQL users: four table functions over temporary views.

``item_by_code``, ``item_evidence``, ``similar_to`` and ``search_page`` are thin: each is one SELECT over views that the DataFrame
operators define, so they answer as those do, and filters on their arguments reach the views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.operators import detail as D
from evidex.operators import search as S
from evidex.operators import similar
from evidex.session import stored
from evidex.vocabulary import DETAIL_PRIORITY

#: Similar items of every item that are found when the functions are defined; who asks for more is answered from the features.
SIMILAR_DEPTH = 12


def _columns(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def _define(df: DataFrame, name: str, arguments: str, body: str) -> None:
    df.sparkSession.sql(f"create or replace temporary function {name}({arguments}) returns table ({_columns(df)}) return {body}")


def _similar(items: DataFrame, k: int) -> DataFrame:
    """(anchor_id, item_id, score, position): the first ``k`` items like every item.

    Items are one by their id; where an id stands in several rows, every pair of rows counts, as in a join of their features.
    """
    counted = items.filter("item_id is not null").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(counted.filter("n > 1").select("item_id"), "repeated")
    if repeated.isEmpty():
        return similar.similar_items(items.filter("item_id is not null"), k)
    once = items.filter("item_id is not null").join(repeated, "item_id", "left_anti")
    found = similar.similar_items(once, k).drop("position").join(once.select("item_id", "code"), "item_id")
    singles = lambda df: similar.features(df).select("item_id", "code", F.inline("features"))
    every, many = singles(items), singles(items.join(repeated, "item_id", "left_semi"))
    met = [a.select(F.col("item_id").alias("anchor_id"), "kind", "value").join(b, ["kind", "value"]).filter("item_id <> anchor_id")
           for a, b in ((many, every), (singles(once), many))]
    more = met[0].unionByName(met[1]).groupBy("anchor_id", "item_id", "code").agg(F.sum("weight").cast("int").alias("score"))
    w = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "code", "item_id")
    ranked = found.unionByName(more).withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
    return ranked.select("anchor_id", "item_id", "score", "position")


def register_tables(t: S.Tables, details: D.DetailTables, hits: DataFrame) -> None:
    """Define the views and functions in the session of ``t``; ``hits`` are answered searches (``ranked_search``, or ``search`` on an index)."""
    folded = lambda c: f"lower(trim({c}))"
    named = t.items.join(t.makers, "maker_id").select("item_id", F.lower(F.trim("maker_key")).alias("maker"), F.lower(F.trim("code")).alias("item_code"))
    named.createOrReplaceTempView("evidex_names")
    every = t.items.select("item_id", F.lit("match").alias("tier"), F.lit(1.0).alias("rank"))
    items = S.project_hit(every, t)
    items.createOrReplaceTempView("evidex_hits")
    _define(items, "item_by_code", "p_maker string, p_code string",
            f"select h.* from evidex_hits h join evidex_names n on n.item_id = h.item_id where n.maker = {folded('p_maker')} and n.item_code = {folded('p_code')}")

    refs = named.select(F.col("item_id").alias("ref_id"), "maker", F.col("item_code").alias("code"))
    rows = D.detail_rows(details, refs).drop("ref_id", "place")
    rows.createOrReplaceTempView("evidex_details")
    ladder = " ".join(f"when '{role}' then {k}" for role, k in DETAIL_PRIORITY.items())
    order = f"d.coat nulls last, case d.role {ladder} else {len(DETAIL_PRIORITY)} end, d.ev_id"
    _define(rows, "item_evidence", "p_maker string, p_code string",
            f"select d.* from evidex_details d join evidex_names n on n.item_id = d.item_id where n.maker = {folded('p_maker')} and n.item_code = {folded('p_code')} order by {order}")

    similar.features(t.items).select("item_id", "code", F.inline("features")).createOrReplaceTempView("evidex_features")
    scored = t.items.select("item_id", F.lit(0).alias("score"), F.lit(0).alias("position"))
    stored(_similar(t.items, SIMILAR_DEPTH), "similar").createOrReplaceTempView("evidex_similar")
    _define(scored, "similar_to", "p_item bigint, p_k int", f"""select item_id, score, position from evidex_similar where anchor_id = p_item and position <= p_k and p_k <= {SIMILAR_DEPTH}
        union all select item_id, cast(score as int) score, position from (
        select item_id, score, row_number() over (order by score desc, code, item_id) position from (
            select f.item_id, f.code, sum(f.weight) score from evidex_features f join evidex_features a on a.kind = f.kind and a.value = f.value
            where p_k > {SIMILAR_DEPTH} and a.item_id = p_item and f.item_id <> p_item group by f.item_id, f.code))
        where position <= p_k""")

    hits.createOrReplaceTempView("evidex_pages")
    _define(hits, "search_page", "p_qid bigint", "select p.* from evidex_pages p where p.qid = p_qid order by p.position")
