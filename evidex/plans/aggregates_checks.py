"""Aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.codes import sku_code
from evidex.functions.color import hex_of, reading_words
from evidex.operators import aggregates as A
from evidex.operators import evidence as E
from evidex.plans import sqltext as Q
from evidex.plans.registry import check
from evidex.plans.views import Catalog
from evidex.vocabulary import COLOR_TERMS


@check("hero_pick", """select item_id, arg_min(source_url, {'p': case role when 'label_chip' then 0 when 'coats_composite' then 1 else 2 end, 'e': ev_id, 'v': source_url}) hero_source_url,
 arg_min(hex, {'p': case role when 'label_chip' then 0 else 1 end, 'e': ev_id, 'v': hex}) filter (hex is not null) hero_hex from evidence group by item_id""", "evidence")
def hero_pick(c: Catalog) -> DataFrame:
    return c.evidence.groupBy("item_id").agg(*E.hero_columns()).drop("hero_storage_path")


@check("evidence_counts", "select item_id, count(distinct coat) coat_levels, count(*) filter (layered_over is not null) layering_count from evidence group by item_id", "evidence")
def evidence_counts(c: Catalog) -> DataFrame:
    return c.evidence.groupBy("item_id").agg(*E.count_columns())


@check("label_set", """select i.item_id, coalesce(string_agg(distinct v.clay_name, ',' order by v.clay_name), '') labels from items i
 left join evidence e on e.item_id = i.item_id left join clay_vocab v on v.clay = e.clay group by i.item_id""", "items evidence clay_vocab")
def label_set(c: Catalog) -> DataFrame:
    rolled = E.with_rollup(c.items.select("item_id"), E.roll_up(c.evidence, c.clay_vocab))
    return rolled.select("item_id", F.array_join("clay_bodies_shown", ",").alias("labels"))


@check("facet_counts", """select 'maker_id' facet, cast(maker_id as varchar) as value, count(*) n from items group by maker_id
 union all select 'line', line, count(*) from items group by line union all select 'surface', cast(surface as varchar), count(*) from items where surface is not null group by surface
 union all select 'opacity', cast(opacity as varchar), count(*) from items where opacity is not null group by opacity
 union all select 'flag', cast(flag as varchar), count(*) from items where flag is not null group by flag""", "items")
def facet_counts(c: Catalog) -> DataFrame:
    return A.facet_counts(c.items, ["maker_id", "line", "surface", "opacity", "flag"]).orderBy("facet", "value")


@check("facet_options", """with o as (select 'maker' facet, cast(i.maker_id as varchar) as value, m.maker_key label, null maker, count(*) n from items i join makers m on m.maker_id = i.maker_id group by all
 union all select 'line', i.line, i.line, m.maker_key, count(*) from items i join makers m on m.maker_id = i.maker_id where line is not null group by all
 union all select 'surface', cast(i.surface as varchar), s.surface_name, null, count(*) from items i join surfaces s on s.surface = i.surface group by all
 union all select 'opacity', cast(i.opacity as varchar), p.opacity_name, null, count(*) from items i join opacities p on p.opacity = i.opacity group by all
 union all select 'clay', cast(v.clay as varchar), v.clay_name, m.maker_key, count(distinct e.item_id) from evidence e join clay_vocab v on v.clay = e.clay join makers m on m.maker_id = v.maker_id group by all)
 select *, row_number() over (partition by facet order by maker nulls first, label, value) as place from o""", "items makers surfaces opacities evidence clay_vocab")
def facet_options(c: Catalog) -> DataFrame:
    return A.facet_options(c.items, c.makers, c.evidence, c.clay_vocab)


@check("catalog_report", """select 'items' metric, count(*) n from items union all select 'items_with_range', count(lo) from items union all select 'items_priced', count(price) from items
 union all select 'evidence', count(*) from evidence union all select 'with_clay', count(clay) from evidence union all select 'layered', count(layered_over) from evidence
 union all select 'open_issues', count(*) from events where event_type = 'error' and event_id % 4 <> 0""", "items evidence")
def catalog_report(c: Catalog) -> DataFrame:
    return A.report(c.items, c.evidence, issue_log(c))


def issue_log(c: Catalog) -> DataFrame:
    return c.events.filter("event_type = 'error'").selectExpr(
        "event_id as issue_id", "cast(user_id % 4 as int) as maker_id", "concat('kind_', event_id % 5) as kind", "concat('subject_', user_id) as subject",
        "us div 1000000 as seen_s", "case when event_id % 4 = 0 then us div 1000000 + 60 end as resolved_s", "props as detail")


@check("issues_by_kind", "select 'kind_' || (event_id % 5) kind, count(*) n from events where event_type = 'error' and event_id % 4 <> 0 group by 1")
def issues_by_kind(c: Catalog) -> DataFrame:
    return issue_log(c).filter("resolved_s is null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@check("confidence_hist", """with f as (select p, p % 4 = 3 or p % 4 = 1 or (p % 4 = 0 and p % 10 = 0) vague, p % 9 = 0 or p % 3 = 0 residue from filenames)
 select count(*) filter (vague) low, count(*) filter (not vague and residue) medium, count(*) filter (not vague and not residue) high from f""", "filenames")
def confidence_hist(c: Catalog) -> DataFrame:
    from evidex.operators.filenames import source_b_facts

    facts = source_b_facts(c.filenames)
    return facts.groupBy().pivot("confidence", ["low", "medium", "high"]).agg(F.count(F.lit(1)))


@check("dq_floor", """select m.maker_key, count(*) loaded, cast(case m.maker_id when 0 then 400 when 1 then 800 end as bigint) floor_rows from items i join makers m on m.maker_id = i.maker_id
 group by m.maker_key, m.maker_id having count(*) < case m.maker_id when 0 then 400 when 1 then 800 end""", "items makers")
def dq_floor(c: Catalog) -> DataFrame:
    from evidex.operators.quality import below_floor

    floors = c.makers.selectExpr("maker_id", "maker_key", "cast(case maker_id when 0 then 400 when 1 then 800 end as bigint) as floor_rows")
    return below_floor(c.items, floors, "maker_id").select("maker_key", "loaded", "floor_rows")


def words_of(c: Catalog) -> DataFrame:
    """Three terms of the main colour, one of the second, each followed by its family."""
    return reading_words(c.readings, "vec_id", [("l1", "a1", "b1", 3), ("l2", "a2", "b2", 1)], COLOR_TERMS)


@check("item_terms", f"""with {Q.NAMED}, w as (select vec_id, term word from nm union select vec_id, family from nm where family is not null)
 select r.owner, string_agg(distinct w.word, ',' order by w.word) words from w join readings r on r.vec_id = w.vec_id group by r.owner""", "readings color_terms")
def item_terms(c: Catalog) -> DataFrame:
    """The search words of an item: all words of all its readings."""
    found = words_of(c).join(c.readings.select("vec_id", "owner"), "vec_id")
    return A.item_words(found, "owner", "words").withColumn("words", F.array_join("words", ","))


@check("reuse_ratio", "select count(*) n_rows, count(distinct sha256(text)) n_distinct from documents")
def reuse_ratio(c: Catalog) -> DataFrame:
    return A.reuse(c.table("documents"), F.sha2("text", 256))


@check("reuse_ratio_approx")
def reuse_ratio_approx(c: Catalog) -> DataFrame:
    return A.reuse(c.table("documents"), F.sha2("text", 256), approximate=True)


@check("reuse_ratio_within", "select count(*) n_rows, true as within from documents")
def reuse_ratio_within(c: Catalog) -> DataFrame:
    """Whether the estimate of distinct texts is within three in a hundred of their number."""
    sha = F.sha2("text", 256)
    both = c.table("documents").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(sha).alias("exact"), F.approx_count_distinct(sha, 0.01).alias("estimate"))
    return both.select("n_rows", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within"))


@check("price_span", """with p as (select p_partkey, p_partkey % 31 = 0 no_scale, p_partkey % 4 = 0 ranged, p_partkey % 6 = 0 zero, round(p_retailprice * 100) / 100 price from part where p_partkey % 29 <> 0)
 select p_partkey, round(case when ranged then price when not zero then price end, 2) price_min, round(case when ranged then round(price * 200) / 100 when not zero then price end, 2) price_max
 from p where not (no_scale and (ranged or not zero))""")
def price_span(c: Catalog) -> DataFrame:
    from evidex.sources.json_products import parse_products, product_rows

    rows = product_rows(parse_products(c.json_products), ["p_partkey"])
    return rows.select("p_partkey", F.round(F.col("price_min").cast("double"), 2).alias("price_min"), F.round(F.col("price_max").cast("double"), 2).alias("price_max"))


@check("line_range", """select line, arg_max(lo, item_id) filter (lo is not null and hi is not null) line_lo, arg_max(hi, item_id) filter (lo is not null and hi is not null) line_hi from items group by line""", "items")
def line_range(c: Catalog) -> DataFrame:
    stated = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), F.struct("lo", "hi"))
    return A.last_stated(c.items, "line", stated, F.col("item_id"), "r").select("line", F.col("r.lo").alias("line_lo"), F.col("r.hi").alias("line_hi"))


@check("token_support", """with t as (select source, doc_id, unnest(list_distinct([t for t in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') if t <> ''])) token from documents),
 s as (select source, count(distinct doc_id) n_docs from documents group by source)
 select t.source, t.token, count(*) n_with, s.n_docs from t join s on s.source = t.source group by all having count(*) >= 0.5 * s.n_docs""")
def token_support(c: Catalog) -> DataFrame:
    return A.token_support(c.table("documents"), "doc_id", "source", "text")


@check("shared_assets", """select coalesce(hex, 'none') asset, count(distinct source_key) owners from evidence group by 1 having count(distinct source_key) > 1""", "evidence")
def shared_assets(c: Catalog) -> DataFrame:
    return A.shared_assets(c.evidence.select(F.coalesce("hex", F.lit("none")).alias("asset"), "source_key"), "asset", "source_key")


@check("dominant_color", """with m as (select vec_id, i, r, g, b, least(r, g, b) >= 235 light from pixels),
 d as (select *, count(*) filter (not light) over (partition by vec_id) dark from m),
 k as (select vec_id, r // 32 qr, g // 32 qg, b // 32 qb, count(*) n, avg(r) r, avg(g) g, avg(b) b from d where dark < 16 or not light group by all),
 t as (select *, row_number() over (partition by vec_id order by n desc, qr, qg, qb) place from k)
 select vec_id, place, n, printf('#%02x%02x%02x', cast(round_even(r, 0) as integer), cast(round_even(g, 0) as integer), cast(round_even(b, 0) as integer)) hex from t where place <= 2""", "pixels")
def dominant_color(c: Catalog) -> DataFrame:
    top = A.dominant_colors(c.pixels, "vec_id", min_kept=16)
    return top.select("vec_id", F.col("place").cast("bigint").alias("place"), "n", hex_of(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


@check("dominant_color_all", """with m as (select vec_id, i, r, g, b, least(r, g, b) >= 235 light from all_pixels),
 d as (select *, count(*) filter (not light) over (partition by vec_id) dark from m),
 k as (select vec_id, r // 32 qr, g // 32 qg, b // 32 qb, count(*) n, avg(r) r, avg(g) g, avg(b) b from d where dark < 16 or not light group by all),
 t as (select *, row_number() over (partition by vec_id order by n desc, qr, qg, qb) place from k)
 select vec_id, place, n, printf('#%02x%02x%02x', cast(round_even(r, 0) as integer), cast(round_even(g, 0) as integer), cast(round_even(b, 0) as integer)) hex from t where place <= 2""", "all_pixels")
def dominant_color_all(c: Catalog) -> DataFrame:
    top = A.dominant_colors(c.all_pixels, "vec_id", min_kept=16)
    return top.select("vec_id", F.col("place").cast("bigint").alias("place"), "n", hex_of(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


@check("two_means_color")
def two_means_color(c: Catalog) -> DataFrame:
    two = A.two_means(c.pixels, "vec_id")
    return two.select("vec_id", "place", "n", hex_of(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


@check("code_collisions", """with n as (select p_partkey % 4 maker_id, case when p_partkey % 3 = 0 then 'SW' || (p_partkey // 8) else 'sw-' || (p_partkey // 8) || '-1' || (p_partkey % 5) end raw, 'SW-' || (p_partkey // 8) code from part)
 select cast(maker_id as integer) maker_id, code, count(distinct raw) spellings from n group by all having count(distinct raw) > 1""")
def code_collisions(c: Catalog) -> DataFrame:
    raw = c.table("part").selectExpr("cast(p_partkey % 4 as int) as maker_id", """case when p_partkey % 3 = 0 then concat('SW', p_partkey div 8)
        else concat('sw-', p_partkey div 8, '-1', p_partkey % 5) end as raw""")
    return A.code_collisions(raw, "raw", sku_code(F.col("raw")), ["maker_id"])
