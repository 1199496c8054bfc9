"""Ranked search for a table of searches: filters, candidates, tiers, pages, roll-up, projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from evidex import vocabulary as V
from evidex.functions.codes import fold
from evidex.functions.text import array_text, trigram_similarity
from evidex.operators import evidence as E
from evidex.operators import filters as P
from evidex.operators import postings as T
from evidex.operators.fuzzy import similar_texts
from evidex.session import spread, stored

if TYPE_CHECKING:
    from evidex.operators.search_index import SearchIndex
    from evidex.operators.search_pages import Source

_S, _L = T_.StringType(), T_.LongType()
#: Frozen output: names, order and types are part of the contract (an item's id and flags are as its table has them).
HIT_ROW = T_.StructType([T_.StructField(name, kind) for name, kind in (
    ("item_id", _L), ("code", _S), ("name", _S), ("description", _S), ("line_code", _S), ("line_name", _S), ("maker_key", _S), ("range_from", _S), ("range_to", _S),
    ("surface_name", _S), ("opacity_name", _S), ("color_terms", T_.ArrayType(_S)), ("food_safe", T_.BooleanType()), ("ap_seal", T_.BooleanType()), ("price_min", T_.DoubleType()),
    ("availability", _S), ("product_url", _S), ("hero_source_url", _S), ("hero_storage_path", _S), ("hero_hex", _S), ("coat_levels", _L), ("layering_count", _L),
    ("clay_bodies_shown", T_.ArrayType(_S)), ("tier", _S), ("rank", T_.DoubleType()), ("maker_name", _S), ("maker_site", _S))])
HIT_COLUMNS = HIT_ROW.names
#: Into how many parts the items under one maker are cut when blank searches meet them.
SALTS = 32
FACETS = ["code", "name", "maker_id", "line", "surface", "opacity", "lo", "hi", "flag"]
WANTS = ["makers", "lines", "surfaces", "opacities", "want_lo", "want_hi", "want_flag"]
FILTER_ARRAYS = ["makers", "lines", "surfaces", "opacities", "clays", "codes", "code_makers"]


@dataclass(frozen=True)
class Tables:
    """What a search reads. ``clays`` has (clay, clay_name); ``makers`` (maker_id, maker_key)."""

    items: DataFrame
    makers: DataFrame
    evidence: DataFrame
    clays: DataFrame


def item_postings(items: DataFrame) -> DataFrame:
    """Code and name weigh A, colour words B, description C."""
    w = V.FIELD_WEIGHTS
    return T.postings(spread(items, "item_id"), "item_id", [
        (F.concat_ws(" ", "code", "name"), w["A"]), (array_text(F.col("terms")), w["B"]), (F.col("description"), w["C"])])


def collapse(searches: DataFrame) -> DataFrame:
    """Give equivalent searches one representative (``rep``): each distinct request is evaluated once."""
    scalars = [F.col("lo"), F.col("hi"), F.col("flag")]
    # Parallel identity lists are pairs, not sets: their order is meaning.
    pairs = F.when(F.col("codes").isNotNull(), F.concat_ws(",", F.transform(F.arrays_zip("codes", F.coalesce("code_makers", F.array().cast("array<string>"))), lambda p: F.to_json(p))))
    arrays = [F.col(a) for a in FILTER_ARRAYS if a not in ("codes", "code_makers")]
    keyed = searches.withColumn("__key", P.request_key(F.col("text"), F.lit(0), arrays, [*scalars, pairs]))
    reps = keyed.groupBy("__key").agg(F.min("qid").alias("rep"))
    return keyed.join(reps, "__key").drop("__key")


def _texted(t: Tables, asked: DataFrame, index: DataFrame) -> DataFrame:
    """Full-text hits and close spellings of searches that have text."""
    texted = asked.filter(F.coalesce(F.trim("text"), F.lit("")) != "")
    terms = T.clauses(texted)
    found = T.matches(index, terms, "item_id").select("qid", "item_id", F.col("cover_rank").alias("ts_rank"))
    barred = T.exclusions(terms)
    # Exclusions alone rank nothing, but what lacks them is a hit. Their lookup is planned only where a search asks for it.
    if not barred.isEmpty():
        alone = barred.select("qid", "grp").distinct().join(texted.select("qid", "makers"), "qid")
        lack = T.lacking(index, barred, _listed(t, alone, ["qid", "grp"]), "item_id")
        found = found.unionByName(lack.select("qid", "item_id", F.lit(0.0).alias("ts_rank")))
    ranked = found.select("qid", "item_id", "ts_rank", F.lit(True).alias("is_hit"), F.lit(None).cast("double").alias("near"))
    # Names and codes share one index over distinct spellings, however many items carry them.
    floors = {"name": V.NAME_SIMILARITY_FLOOR, "code": V.CODE_SIMILARITY_FLOOR}
    spelled = t.items.select("item_id", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("spelling")) for kind in floors])).alias("s")).select("item_id", "s.*")
    # Each kind is read with its own floor: the higher it is, the fewer common grams are looked up.
    close = reduce(DataFrame.unionByName, [similar_texts(texted, "text", spelled.filter(F.col("kind") == kind), "spelling", floor).withColumn("kind", F.lit(kind)) for kind, floor in floors.items()])
    # Either side of this join may be the one that is read in few tasks, and a row of each meets many of the other.
    near = (spread(texted.select("qid", "text").join(close, "text").withColumnRenamed("spelling_match", "spelling"), "qid", "spelling")
            .join(spread(spelled, "item_id"), ["kind", "spelling"])
            .select("qid", "item_id", F.lit(0.0).alias("ts_rank"), F.lit(False).alias("is_hit"), F.col("similarity").alias("near")))
    return ranked.unionByName(near)


def _listed(t: Tables, asked: DataFrame, keep: list[str], facets: Sequence[str] = ()) -> DataFrame:
    """(keep..., item_id, facets...) of every item of the makers that each row of ``asked`` allows; the maker is the join key.

    Every item also stands under the key -1, where searches without a chosen maker look. A key can
    hold all items, so it is salted: the few searches are repeated, the items are spread.
    """
    open_makers = F.col("makers").isNull() | (F.size("makers") == 0)
    keys = F.when(open_makers, F.array(F.lit(-1))).otherwise(F.array_distinct("makers"))
    reach = asked.select(*keep, F.explode(keys).alias("reach")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Either side may be read in few tasks, and a row of each meets many of the other.
    filed = spread(t.items, "item_id").select("item_id", *facets, F.pmod(F.xxhash64("item_id"), F.lit(SALTS)).cast("int").alias("salt"),
                           F.explode(F.array(F.col("maker_id"), F.lit(-1))).alias("reach"))
    return spread(reach, *reach.columns[:1], "reach", "salt").join(filed, ["reach", "salt"]).select(*keep, "item_id", *facets)


def wanted(searches: DataFrame) -> DataFrame:
    """Searches with the columns that ``filters.row_passes`` reads beside those of an item."""
    return searches.select("qid", "text", "makers", "lines", "surfaces", "opacities", F.col("lo").alias("want_lo"), F.col("hi").alias("want_hi"), F.col("flag").alias("want_flag"))


def browse(t: Tables, searches: DataFrame) -> DataFrame:
    """(qid, item_id, code, tier, rank) of every item that the filters of blank searches allow.

    An item is listed once for a search, with its facets, so nothing is gathered: the rows of a search without evidence and identity
    filters stay where they are made, and only those of the others meet their permits.
    """
    blank = searches.filter(F.coalesce(F.trim("text"), F.lit("")) == "")
    have, need = _permits(t, blank)
    asked = wanted(blank).join(need, "qid")
    keep = ["qid", *[w for w in WANTS if w != "makers"]]

    def listed(some: DataFrame) -> DataFrame:
        rows = _listed(t, some, [*keep, "need"], FACETS).withColumn("makers", F.lit(None).cast("array<int>")).filter(P.row_passes())
        return rows.filter("item_id is not null").select("qid", "item_id", "code", "need")

    free = listed(asked.filter("need = 0"))
    bound = listed(asked.filter("need <> 0")).join(have, ["qid", "item_id"]).filter("have = need")
    return free.unionByName(bound.drop("have")).select("qid", "item_id", "code", F.lit("match").alias("tier"), F.lit(1.0).alias("rank"))


def _permits(t: Tables, searches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence and identity filters as keys: (qid, item_id, have) and, per search, how many are needed."""
    by_clay = F.col("clays").isNotNull() & (F.size("clays") > 0)
    by_ref = F.col("codes").isNotNull()  # a stated but empty list allows nothing
    shown = t.evidence.filter("clay is not null").select("item_id", "clay").distinct()
    clay = (searches.filter(by_clay).select("qid", F.explode("clays").alias("clay"))
            .join(shown, "clay").select("qid", "item_id", F.lit(1).alias("bit")))
    keyed = t.items.join(t.makers, "maker_id").select("item_id", "maker_key", fold(F.col("code")).alias("code_key"))
    refs = P.paired_refs(searches.filter(by_ref), makers="code_makers", keep=["qid"])
    ref = refs.join(keyed, ["maker_key", "code_key"]).select("qid", "item_id", F.lit(2).alias("bit"))
    have = clay.unionByName(ref).groupBy("qid", "item_id").agg(F.bit_or("bit").alias("have"))
    need = searches.select("qid", (F.when(by_clay, 1).otherwise(0) + F.when(by_ref, 2).otherwise(0)).alias("need"))
    return have, need


def scored(t: Tables, searches: DataFrame, match_floor: float = V.MATCH_RANK_FLOOR,
           index: DataFrame | None = None, totals: bool = False) -> DataFrame:
    """(qid, item_id, code, tier, rank) of everything that answers each search, filters applied.

    ``index`` takes a stored postings table; without one it is built from the items. With ``totals`` there is one row per search and tier,
    (qid, tier, n, best, worst, ids), and none per answer.
    """
    if totals:
        from evidex.operators import search_pages as G

        return G.totals(batch_source(t, places=index), searches, _permits(t, searches), match_floor)
    index = item_postings(t.items) if index is None else index
    texted = searches.filter(F.coalesce(F.trim("text"), F.lit("")) != "")
    found = (spread(_texted(t, texted, index), "qid", "item_id")
             .groupBy("qid", "item_id").agg(F.max("ts_rank").alias("ts_rank"), F.bool_or("is_hit").alias("is_hit"),
                                            F.max("near").alias("near")))
    have, need = _permits(t, texted)
    asked = wanted(texted).join(need, "qid")
    described = t.items.select("item_id", *FACETS)
    # The candidates are partitioned by (qid, item_id) already, so the permits join moves only permits.
    rows = (found.join(have, ["qid", "item_id"], "left").join(asked, "qid")
            .filter(F.coalesce("have", F.lit(0)) == F.col("need"))
            .join(described, "item_id").filter(P.row_passes()))
    # A spelling not found on the way here is at most the higher floor, so similarity is computed only
    # where nothing known exceeds that.
    high = F.lit(max(V.NAME_SIMILARITY_FLOOR, V.CODE_SIMILARITY_FLOOR))
    known = F.greatest(F.col("ts_rank"), F.coalesce("near", F.lit(0.0)))
    close = F.greatest(trigram_similarity(F.col("text"), F.col("name")), trigram_similarity(F.col("text"), F.col("code")))
    best = F.when(known >= high, known).otherwise(F.greatest(known, close))
    tier = F.when(F.col("is_hit") & (F.col("ts_rank") >= match_floor), "match").otherwise("near")
    ranked = rows.select("qid", "item_id", "code", tier.alias("tier"), F.round(best, 6).alias("rank"))
    return ranked.unionByName(browse(t, searches))


def pages(rows: DataFrame, searches: DataFrame) -> DataFrame:
    """The page of every search, from the rows of its representative.

    The depth that bounds row numbers is one number read from the (small) table of searches.
    """
    depth = searches.agg(F.max(F.greatest("page_offset", F.lit(0)) + F.greatest("page_limit", F.lit(0)))).first()[0] or 0
    w = Window.partitionBy("rep").orderBy("tier", F.desc("rank"), "code", "item_id")
    top = (rows.withColumnRenamed("qid", "rep").withColumn("position", F.row_number().over(w))
           .filter(F.col("position") <= int(depth)))
    low = F.greatest("page_offset", F.lit(0))
    wanted = searches.select("qid", "rep", low.alias("__low"), (low + F.greatest("page_limit", F.lit(0))).alias("__high"))
    return (top.join(wanted, "rep").filter("position > __low and position <= __high")
            .select("qid", "item_id", "code", "tier", "rank", "position"))


def project_hit(page: DataFrame, t: Tables, keep: tuple[str, ...] = ()) -> DataFrame:
    """The one wide row every answer is made of, for a page that carries (item_id, tier, rank)."""
    spark = page.sparkSession
    wide = page.select(*keep, "item_id", "tier", "rank").join(t.items, "item_id")
    # Optional columns an item table may not have are stated as null, never guessed.
    optional = {"ap_seal": "boolean", "availability": "string", "product_url": "string", "line_name": "string"}
    for name, kind in optional.items():
        if name not in wide.columns:
            wide = wide.withColumn(name, F.lit(None).cast(kind))
    cones = V.cones(spark)
    wide = (wide.join(t.makers, "maker_id")
            .join(cones.withColumnsRenamed({"ordinal": "lo", "cone": "range_from"}), "lo", "left")
            .join(cones.withColumnsRenamed({"ordinal": "hi", "cone": "range_to"}), "hi", "left")
            .join(V.surfaces(spark).select("surface", "surface_name"), "surface", "left")
            .join(V.opacities(spark).select("opacity", "opacity_name"), "opacity", "left"))
    rolled = E.roll_up(t.evidence, t.clays, only=page)
    wide = E.with_rollup(wide, rolled)
    renamed = wide.withColumns({
        "line_code": F.col("line"), "line_name": F.coalesce("line_name", "line"), "color_terms": F.col("terms"),
        "food_safe": F.col("flag"), "price_min": F.col("price"),
        "maker_name": F.initcap("maker_key"), "maker_site": F.concat(F.lit("https://"), F.replace("maker_key", F.lit(" "), F.lit("-")), F.lit(".example.com"))})
    return renamed.select(*keep, *HIT_COLUMNS)


def ranked_search(t: Tables, searches: DataFrame, match_floor: float = V.MATCH_RANK_FLOOR, index: SearchIndex | None = None) -> DataFrame:
    """Pages of hits for every search, with (qid, position) in front of the hit columns.

    With a stored ``index`` of the same tables (``search_index.build_index``) its lists are read; without one, postings are made for this batch.
    The chosen pages (at most the sum of the page limits) are stored before anything is looked up for
    them: what follows reads evidence for those items only.
    """
    grouped = stored(collapse(searches), "searches")
    if index is not None:
        from evidex.operators.search_index import index_pages

        return project_hit(stored(index_pages(index, grouped, match_floor), "pages"), t, keep=("qid", "position"))
    from evidex.operators.search_index import pages as list_pages

    chosen = stored(list_pages(t, batch_source(t), grouped, match_floor, once=False), "pages")
    return project_hit(chosen, t, keep=("qid", "position"))


def batch_source(t: Tables, places: DataFrame | None = None) -> Source:
    """Texts looked up in postings (``places``, or made here) and spellings that are made for this batch."""
    from evidex.operators import search_pages as G

    places = stored(item_postings(t.items), "places") if places is None else places

    def lacks(barred: DataFrame, texts: DataFrame) -> DataFrame:
        alone = barred.select("qid", "grp").distinct().withColumn("makers", F.lit(None).cast("array<int>"))
        return T.lacking(places, barred, _listed(t, alone, ["qid", "grp"]), "item_id").select("qid", "item_id", F.lit(0.0).alias("ts_rank"))

    def close(texts: DataFrame) -> DataFrame:
        floors = {"name": V.NAME_SIMILARITY_FLOOR, "code": V.CODE_SIMILARITY_FLOOR}
        return reduce(DataFrame.unionByName, [similar_texts(texts, "text", t.items, kind, floor).select("text", F.lit(kind).alias("kind"), F.col(f"{kind}_match").alias("spelling"), F.col("similarity").alias("near"))
                                              for kind, floor in floors.items()]).join(texts, "text")

    return G.Source(G.build_groups(t.items, places, G.RARE_ROWS),
                    lambda terms, texts: T.matches(places, terms, "item_id").select("qid", "item_id", F.col("cover_rank").alias("ts_rank")), lacks, close)
