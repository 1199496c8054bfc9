"""Paging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators import evidence as E
from evidex.operators import paging as G
from evidex.plans import sqltext as Q
from evidex.plans.registry import check
from evidex.plans.views import Catalog


def ranked(c: Catalog) -> DataFrame:
    """A ranked result over all items: ties everywhere, the id decides."""
    return c.items.selectExpr("item_id", "code", "case when coalesce(surface, 0) = 2 then 'near' else 'match' end as tier",
                              "cast(coalesce(opacity, 0) as double) / 10 as rank")


RANKED_SQL = """rk as (select item_id, code, case when coalesce(surface, 0) = 2 then 'near' else 'match' end tier, cast(coalesce(opacity, 0) as double) / 10 as rank from items)"""


@check("page_total_order", f"with {RANKED_SQL} select item_id, code, tier, rank from rk order by tier, rank desc, code, item_id limit 40 offset 80", "items")
def page_total_order(c: Catalog) -> DataFrame:
    return G.page(ranked(c), 40, 80)


@check("page_then_rollup", f"""with {RANKED_SQL}, {Q.ROLL_UP}, pg as (select * from rk order by tier, rank desc, code, item_id limit 40 offset 40)
 select p.item_id, p.tier, p.rank, r.hero_source_url, r.hero_hex, coalesce(r.coat_levels, 0) coat_levels, coalesce(r.layering_count, 0) layering_count from pg p left join ru r on r.item_id = p.item_id""", "items evidence clay_vocab")
def page_then_rollup(c: Catalog) -> DataFrame:
    page = G.page(ranked(c), 40, 40)
    rolled = E.with_rollup(page, E.roll_up(c.evidence, c.clay_vocab, only=page))
    return rolled.select("item_id", "tier", "rank", "hero_source_url", "hero_hex", "coat_levels", "layering_count")


@check("page_index", """with r as (select *, maker_id as result from items), n as (select result, item_id, row_number() over (partition by result order by code, item_id) as position, count(*) over (partition by result) total from r)
 select result, item_id, position, (position - 1) // 40 page_no, total > ((position - 1) // 40 + 1) * 40 has_more, least(total, ((position - 1) // 40 + 1) * 40) next_offset from n""", "items")
def page_index(c: Catalog) -> DataFrame:
    """Every page of every result at once."""
    rows = c.items.select(F.col("maker_id").alias("result"), "code", "item_id")
    return G.page_index(rows, ["result"], ["code", "item_id"], 40).drop("code")


@check("keyset_page", f"""with {RANKED_SQL}, a as (select * from rk where tier = 'match' order by tier, rank desc, code, item_id limit 1 offset 100)
 select item_id, code, tier, rank from (select r.*, row_number() over (order by r.tier, r.rank desc, r.code, r.item_id) rn from rk r) where rn > 101 and rn <= 141""", "items")
def keyset_page(c: Catalog) -> DataFrame:
    last = G.page(ranked(c), 1, 100).first()
    return G.keyset_page(ranked(c), 40, (last.tier, last.rank, last.code, last.item_id))


def fetched(c: Catalog) -> DataFrame:
    """Pages as fetched one after another while rows shifted: neighbours overlap, some repeat entirely."""
    return c.table("lineitem").selectExpr(
        "l_suppkey as result", "cast(l_linenumber as int) as page_no", "case when l_tax < 0.06 then 'match' else 'near' end as tier",
        "l_orderkey * 10 + l_linenumber as position", "l_partkey % 50 as item_id", "true as has_more")


FETCHED_SQL = """fp as (select l_suppkey as result, l_linenumber page_no, case when l_tax < 0.06 then 'match' else 'near' end tier, l_orderkey * 10 + l_linenumber as position, l_partkey % 50 item_id from lineitem),
 mp as (select result, item_id, min({'p': page_no, 't': tier, 'o': position}) first from fp group by all)"""


@check("merge_pages", f"with {FETCHED_SQL} select result, item_id, first.p page_no, first.t tier, first.o as position from mp")
def merge_pages(c: Catalog) -> DataFrame:
    return G.merge_pages(fetched(c))


@check("page_additions", f"""with {FETCHED_SQL}, pp as (select distinct result, page_no from fp), ad as (select result, first.p page_no, count(*) added from mp group by all)
 select pp.result, pp.page_no, coalesce(added, 0) added, coalesce(added, 0) > 0 go_on from pp left join ad on ad.result = pp.result and ad.page_no = pp.page_no""")
def page_additions(c: Catalog) -> DataFrame:
    pages = fetched(c)
    return G.additions(pages, G.merge_pages(pages))
