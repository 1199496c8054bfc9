"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.codes import has_code_shape
from evidex.functions.intervals import overlaps
from evidex.operators import filters as P
from evidex.plans.registry import check
from evidex.plans.views import Catalog


@check("facet_filter", """select item_id, line, surface from items where maker_id in (0, 2) and line in ('SMALL', 'PROMO')
 and surface in (1, 3)""", "items")
def facet_filter(c: Catalog) -> DataFrame:
    wanted = {"maker_id": [0, 2], "line": ["SMALL", "PROMO"], "surface": [1, 3], "opacity": [], "hi": None}
    return P.facets(c.items, wanted).select("item_id", "line", "surface")


@check("tristate_filter", "select item_id, flag from items where flag is not distinct from false", "items")
def tristate_filter(c: Catalog) -> DataFrame:
    return P.tristate(c.items, "flag", False).select("item_id", "flag")


@check("interval_overlap", """select i.item_id, o.o_orderkey % 7 as bound_lo, coalesce(i.lo, 1) <= o.o_orderkey % 7 + 9 and coalesce(i.hi, 32767) >= o.o_orderkey % 7 as meets
 from items i join orders o on o.o_orderkey = i.item_id""", "items")
def interval_overlap(c: Catalog) -> DataFrame:
    o = c.table("orders").select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 7).alias("bound_lo"))
    return c.items.join(o, "item_id").select(
        "item_id", "bound_lo", overlaps(F.col("lo"), F.col("hi"), F.col("bound_lo"), F.col("bound_lo") + 9).alias("meets"))


def _refs(c: Catalog) -> DataFrame:
    """References typed by hand: odd case and blanks, one in five to a maker that is not there."""
    return c.table("customer").join(c.makers, (F.col("c_custkey") % 4).cast("int") == F.col("maker_id")).selectExpr(
        "c_custkey as ref_id",
        "case when c_custkey % 5 = 0 then 'nobody' else concat(' ', upper(maker_key)) end as maker",
        "concat(' pC-', c_custkey % 97, ' ') as code")


@check("exact_lookup", """select c.c_custkey ref_id, i.item_id, i.code, m.maker_key from customer c
 join makers m on m.maker_id = c.c_custkey % 4 and c.c_custkey % 5 <> 0
 join items i on i.maker_id = m.maker_id and i.code = 'PC-' || (c.c_custkey % 97)""", "items makers")
def exact_lookup(c: Catalog) -> DataFrame:
    return P.exact_lookup(c.items, c.makers, _refs(c)).select("ref_id", "item_id", "code", "maker_key")


@check("paired_filter", """select i.item_id, i.maker_id, i.code from items i where exists (
  select 1 from supplier s where i.code = 'PC-' || s.s_suppkey and s.s_suppkey % 3 <> 0 and s.s_suppkey % 4 = i.maker_id)""",
       "items")
def paired_filter(c: Catalog) -> DataFrame:
    keyed = c.clay_vocab.join(c.makers, "maker_id").selectExpr(
        "array(concat(' pc-', clay), concat('PC-', clay)) as codes",
        "case when clay % 3 = 0 then array(cast(null as string)) else array(concat(maker_key, ' ')) end as makers")
    return P.paired(c.items, c.makers, P.paired_refs(keyed)).select("item_id", "maker_id", "code")


@check("evidence_semi", """select item_id, code from items i where exists (
  select 1 from evidence e where e.item_id = i.item_id and e.clay in (1, 2, 3))""", "items evidence")
def evidence_semi(c: Catalog) -> DataFrame:
    return P.with_evidence(c.items, c.evidence.filter(F.col("clay").isin(1, 2, 3))).select("item_id", "code")


@check("path_allowlist", "select p_partkey from part where p_partkey % 29 <> 0 and p_partkey % 5 in (0, 1, 4)")
def path_allowlist(c: Catalog) -> DataFrame:
    from evidex.sources.json_products import parse_products

    inside = P.under_path(F.col("product.categories"), "/product-category/color/fired/", ["product-kits", "non-fired"])
    return parse_products(c.json_products).filter(inside).select("p_partkey")


@check("slug_filter", """select page_id, slug from (select page_id, case page_id % 5 when 0 then '/PCF-' || page_id || '-x/' when 1 then 'pc-' || (page_id % 1000)
 when 2 then 'pcx-' || page_id when 3 then 'c-' || (page_id % 1000) || '/' else 'elem_1_or_3' end slug from pages)
 where (page_id % 5 = 0 and page_id < 1000) or page_id % 5 in (1, 3)""")
def slug_filter(c: Catalog) -> DataFrame:
    slugs = c.table("pages").selectExpr("page_id", """case page_id % 5 when 0 then concat('/PCF-', page_id, '-x/')
        when 1 then concat('pc-', page_id % 1000) when 2 then concat('pcx-', page_id)
        when 3 then concat('c-', page_id % 1000, '/') else 'elem_1_or_3' end as slug""")
    return slugs.filter(has_code_shape(F.col("slug")))


@check("delta_discovery", """select page_id, url from pages where page_id % 3 <> 0 and (page_id % 4 = 0
 or timestamp '2024-01-01 00:00:00' + to_days(cast(page_id as integer)) > timestamp '2024-02-15 00:00:00')""")
def delta_discovery(c: Catalog) -> DataFrame:
    listing = c.table("pages").selectExpr(
        "page_id", "url", "cast(page_id as string) as slug",
        "case when page_id % 4 <> 0 then timestamp '2024-01-01 00:00:00' + make_dt_interval(cast(page_id as int)) end as lastmod")
    allowed = c.table("pages").filter("page_id % 3 <> 0").selectExpr("cast(page_id as string) as slug")
    return P.discovered(listing, allowed, F.lit("2024-02-15 00:00:00").cast("timestamp")).select("page_id", "url")


def saved(c: Catalog) -> DataFrame:
    """A table of saved searches: crossed ranges, impossible lines, the same request in several spellings."""
    return c.table("customer").selectExpr(
        "c_custkey as qid",
        "case c_custkey % 3 when 0 then ' red ' when 1 then 'red' else concat('red ', c_custkey % 5) end as text",
        "case c_custkey % 4 when 0 then array(1, 0) when 1 then array(0, 1) when 2 then array() else null end as makers",
        "case when c_custkey % 2 = 0 then array(c_custkey % 100, 2) end as clays",
        "cast(10 + c_custkey % 6 as int) as lo", "cast(case when c_custkey % 7 <> 0 then 12 end as int) as hi",
        "case when c_custkey % 5 = 0 then 'hi' else 'lo' end as last_set",
        "case when c_custkey % 11 = 0 then true end as flag")


@check("saved_searches", """with s as (select c_custkey qid, case c_custkey % 3 when 0 then 'red' when 1 then 'red' else 'red ' || (c_custkey % 5) end as text,
  c_custkey % 4 in (0, 1) bound, c_custkey % 2 = 0 clayed, list_sort(list_distinct([x for x in [c_custkey % 100, 2]
    if c_custkey % 4 not in (0, 1) or (x % 4 in (0, 1) and x < ns)])) clays,
  cast(10 + c_custkey % 6 as integer) lo, cast(case when c_custkey % 7 <> 0 then 12 end as integer) hi, c_custkey % 5 = 0 last_hi,
  case when c_custkey % 11 = 0 then true end flag from customer cross join (select count(*) ns from supplier)),
 f as (select qid, text, bound, case when clayed and len(clays) > 0 then array_to_string(clays, ',') else '-' end clay_key,
  case when lo > hi and last_hi then hi else lo end lo, case when lo > hi and not last_hi then lo else hi end hi, flag from s),
 k as (select *, cast(bound as integer) + cast(clay_key <> '-' as integer) + cast(lo is not null or hi is not null as integer) + cast(coalesce(flag, false) as integer) n_active from f)
 select min(qid) qid, count(*) n_saved, max(n_active) n_active, max(lo) lo, max(hi) hi from k
 group by text, bound, clay_key, lo, hi, flag""")
def saved_searches(c: Catalog) -> DataFrame:
    pruned = P.prune_scoped(saved(c), c.clay_vocab.selectExpr("clay as child", "maker_id"), "makers", "clays")
    lo, hi = P.clamp_range(F.col("lo"), F.col("hi"), F.col("last_set"))
    clean = pruned.withColumns({"lo": lo, "hi": hi})
    key = P.request_key(F.col("text"), F.lit(40), [F.col("makers"), F.col("clays")], [F.col("lo"), F.col("hi"), F.col("flag")])
    return (clean.withColumn("n_active", P.active_count(["makers", "clays"], "lo", "hi", "flag")).groupBy(key.alias("request"))
            .agg(F.min("qid").alias("qid"), F.count(F.lit(1)).alias("n_saved"), F.max("n_active").alias("n_active"),
                 F.max("lo").alias("lo"), F.max("hi").alias("hi"))
            .drop("request"))
