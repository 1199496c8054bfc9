"""Search: terms, matching, ranks, similarity, tiers, whole searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import trigram_similarity
from evidex.operators import postings as T
from evidex.operators import search as S
from evidex.operators import search_index as I
from evidex.operators.fuzzy import similar_texts
from evidex.plans import sqltext as Q
from evidex.plans.registry import check
from evidex.plans.views import Catalog


def tables(c: Catalog) -> S.Tables:
    return S.Tables(c.items, c.makers, c.evidence, c.clay_vocab)


def doc_postings(c: Catalog) -> DataFrame:
    return T.postings(c.table("documents"), "doc_id", [(F.col("source"), 1.0), (F.col("text"), 0.2)])


@check("postings", f"""with {Q.doc_index()}
 select term, count(*) n_hits, count(distinct doc_id) n_docs, cast(max(pos) as integer) last_pos, round(sum(weight), 3) weight from dp group by term""")
def postings(c: Catalog) -> DataFrame:
    return doc_postings(c).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_hits"), F.count_distinct("doc_id").alias("n_docs"), F.max("pos").alias("last_pos"),
        F.round(F.sum("weight"), 3).alias("weight"))


@check("search_terms", f"with {Q.term_ctes('searches')} select qid, cast(grp as integer) grp, cast(unit as integer) unit,"
       " negated, cast(place as integer) as place, term from st", "searches")
def search_terms(c: Catalog) -> DataFrame:
    return T.clauses(c.searches)


def _match_sql(kind: str) -> str:
    return f"""with {Q.doc_index()}, {Q.term_ctes(f'(select * from doc_searches where qid % 4 {kind})')}, {Q.match_ctes('dp', 'doc_id')}
 select distinct qid, doc_id from mt"""


def _matched(c: Catalog, shape: str) -> DataFrame:
    terms = T.clauses(c.doc_searches.filter(shape))
    return T.matches(doc_postings(c), terms, "doc_id").select("qid", "doc_id").distinct()


@check("match_and", _match_sql("in (0, 3)"), "doc_searches")
def match_and(c: Catalog) -> DataFrame:
    return _matched(c, "text not like '%\"%' and text not like '% -%'")


@check("match_phrase", _match_sql("= 1"), "doc_searches")
def match_phrase(c: Catalog) -> DataFrame:
    return _matched(c, "text like '%\"%'")


@check("match_not", _match_sql("= 2"), "doc_searches")
def match_not(c: Catalog) -> DataFrame:
    return _matched(c, "text like '% -%'")


@check("cover_rank", f"""with {Q.doc_index()}, {Q.term_ctes('doc_searches')}, {Q.match_ctes('dp', 'doc_id')}, {Q.cover_ctes('dp', 'doc_id')}
 select qid, cast(grp as integer) grp, doc_id, cover_rank from cr""", "doc_searches")
def cover_rank(c: Catalog) -> DataFrame:
    return T.matches(doc_postings(c), T.clauses(c.doc_searches), "doc_id")


def _passage_sql(form: str) -> str:
    return f"""with {Q.doc_index()}, {Q.term_ctes(f'(select * from passage_searches where qid % 4 {form})')}, {Q.match_ctes('dp', 'doc_id')}
 select distinct qid, doc_id from mt"""


def _passages_matched(c: Catalog, form: str) -> DataFrame:
    terms = T.clauses(c.passage_searches.filter(f"qid % 4 {form}"))
    return T.matches(doc_postings(c), terms, "doc_id").select("qid", "doc_id").distinct()


@check("match_and_whole", _passage_sql("= 0"), "passage_searches")
def match_and_whole(c: Catalog) -> DataFrame:
    return _passages_matched(c, "= 0")


@check("match_phrase_whole", _passage_sql("= 1"), "passage_searches")
def match_phrase_whole(c: Catalog) -> DataFrame:
    return _passages_matched(c, "= 1")


@check("match_not_whole", _passage_sql("in (2, 3)"), "passage_searches")
def match_not_whole(c: Catalog) -> DataFrame:
    return _passages_matched(c, "in (2, 3)")


@check("cover_rank_whole", f"""with {Q.doc_index()}, {Q.term_ctes('passage_searches')}, {Q.match_ctes('dp', 'doc_id')}, {Q.cover_ctes('dp', 'doc_id')}
 select qid, cast(grp as integer) grp, doc_id, cover_rank from cr""", "passage_searches")
def cover_rank_whole(c: Catalog) -> DataFrame:
    return T.matches(doc_postings(c), T.clauses(c.passage_searches), "doc_id")


@check("trigram_sim", f"select item_id, round({Q.similarity('a', 'b')}, 6) sim from (select item_id, {Q.grams('name')} a,"
       f" {Q.grams('description')} b from items)", "items")
def trigram_sim(c: Catalog) -> DataFrame:
    return c.items.select("item_id", F.round(trigram_similarity(F.col("name"), F.col("description")), 6).alias("sim"))


@check("fuzzy_join", f"""with a as (select distinct text, {Q.grams('text')} ga from searches),
 b as (select distinct name, {Q.grams('name')} gb from items)
 select text, name as name_match, round({Q.similarity('ga', 'gb')}, 6) similarity from a cross join b
 where {Q.similarity('ga', 'gb')} > 0.25""", "searches items")
def fuzzy_join(c: Catalog) -> DataFrame:
    return similar_texts(c.searches, "text", c.items, "name", 0.25).withColumn("similarity", F.round("similarity", 6))


_SEARCH_CTES = (f"{Q.item_index()}, {Q.term_ctes('searches')}, {Q.match_ctes('ip', 'item_id')}, "
                f"{Q.cover_ctes('ip', 'item_id')}, {Q.SCORED}")


@check("tiering", f"with {_SEARCH_CTES} select qid, tier, count(*) n, max(rank) best, min(rank) worst,"
       " cast(sum(item_id) as bigint) ids from sc group by qid, tier", "searches items evidence")
def tiering(c: Catalog) -> DataFrame:
    return S.scored(tables(c), c.searches, totals=True)


@check("ranked_search", f"""with {_SEARCH_CTES}, {Q.ROLL_UP},
 nb as (select *, row_number() over (partition by qid order by tier, rank desc, code, item_id) as position from sc),
 pg as (select * from nb where position > page_offset and position <= page_offset + page_limit)
 select p.qid, p.position, p.item_id, p.code, i.name, i.description, i.line line_code, m.maker_key, cf.cone range_from, ct.cone range_to,
 s.surface_name, o.opacity_name, array_to_string(i.terms, ',') color_terms, i.flag food_safe, i.price price_min,
 r.hero_source_url, r.hero_storage_path, r.hero_hex, coalesce(r.coat_levels, 0) coat_levels, coalesce(r.layering_count, 0) layering_count,
 coalesce(r.clay_bodies_shown, '') clay_bodies_shown, p.tier, p.rank
 from pg p join items i on i.item_id = p.item_id join makers m on m.maker_id = i.maker_id
 left join cones cf on cf.ordinal = i.lo left join cones ct on ct.ordinal = i.hi
 left join surfaces s on s.surface = i.surface left join opacities o on o.opacity = i.opacity
 left join ru r on r.item_id = p.item_id""", "searches items evidence clay_vocab makers cones surfaces opacities")
def ranked_search(c: Catalog) -> DataFrame:
    hits = S.ranked_search(tables(c), c.searches)
    return flat(hits, "line_name", "ap_seal", "availability", "product_url", "maker_name", "maker_site").withColumn(
        "position", F.col("position").cast("bigint"))


def flat(hits: DataFrame, *without: str) -> DataFrame:
    """Arrays as text, for comparison."""
    return hits.drop(*without).withColumns({
        "color_terms": F.array_join("color_terms", ","), "clay_bodies_shown": F.array_join("clay_bodies_shown", ",")})


@check("hit_projection", f"""with {Q.ROLL_UP}
 select i.item_id, i.code, i.name, i.description, i.line line_code, i.line line_name, m.maker_key, cf.cone range_from, ct.cone range_to,
 s.surface_name, o.opacity_name, array_to_string(i.terms, ',') color_terms, i.flag food_safe, cast(null as boolean) ap_seal,
 i.price price_min, cast(null as varchar) availability, cast(null as varchar) product_url,
 r.hero_source_url, r.hero_storage_path, r.hero_hex, coalesce(r.coat_levels, 0) coat_levels, coalesce(r.layering_count, 0) layering_count,
 coalesce(r.clay_bodies_shown, '') clay_bodies_shown, 'match' tier, 1.0::double as rank,
 array_to_string([upper(w[1]) || w[2:] for w in string_split(m.maker_key, ' ')], ' ') maker_name,
 'https://' || replace(m.maker_key, ' ', '-') || '.example.com' maker_site
 from items i join makers m on m.maker_id = i.maker_id
 left join cones cf on cf.ordinal = i.lo left join cones ct on ct.ordinal = i.hi
 left join surfaces s on s.surface = i.surface left join opacities o on o.opacity = i.opacity
 left join ru r on r.item_id = i.item_id""", "items evidence clay_vocab makers cones surfaces opacities")
def hit_projection(c: Catalog) -> DataFrame:
    page = c.items.select("item_id", F.lit("match").alias("tier"), F.lit(1.0).alias("rank"))
    return flat(S.project_hit(page, tables(c)))


def _pages_sql(ctes: str) -> str:
    return f"""with {ctes}, {Q.ROLL_UP},
 nb as (select *, row_number() over (partition by qid order by tier, rank desc, code, item_id) as position from sc),
 pg as (select * from nb where position > page_offset and position <= page_offset + page_limit)
 select p.qid, p.position, p.item_id, p.code, i.name, i.description, i.line line_code, m.maker_key, cf.cone range_from, ct.cone range_to,
 s.surface_name, o.opacity_name, array_to_string(i.terms, ',') color_terms, i.flag food_safe, i.price price_min,
 r.hero_source_url, r.hero_storage_path, r.hero_hex, coalesce(r.coat_levels, 0) coat_levels, coalesce(r.layering_count, 0) layering_count,
 coalesce(r.clay_bodies_shown, '') clay_bodies_shown, p.tier, p.rank
 from pg p join items i on i.item_id = p.item_id join makers m on m.maker_id = i.maker_id
 left join cones cf on cf.ordinal = i.lo left join cones ct on ct.ordinal = i.hi
 left join surfaces s on s.surface = i.surface left join opacities o on o.opacity = i.opacity
 left join ru r on r.item_id = p.item_id"""


_FOUND = "items evidence clay_vocab makers cones surfaces opacities"


@check("index_search", _pages_sql(_SEARCH_CTES), f"searches {_FOUND}")
def index_search(c: Catalog) -> DataFrame:
    return _hits(I.search(I.build_index(tables(c)), c.searches))


@check("search_edges", _pages_sql(f"{Q.item_index()}, {Q.term_ctes('edge_searches')}, {Q.match_ctes('ip', 'item_id')}, {Q.cover_ctes('ip', 'item_id')}, {Q.SCORED_EDGES}"),
       f"edge_searches {_FOUND}")
def search_edges(c: Catalog) -> DataFrame:
    return _hits(I.search(I.build_index(tables(c)), c.edge_searches))


def _hits(hits: DataFrame) -> DataFrame:
    return flat(hits, "line_name", "ap_seal", "availability", "product_url", "maker_name", "maker_site").withColumn("position", F.col("position").cast("bigint"))
