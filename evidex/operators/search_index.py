"""A stored search index, and ranked pages read from it with bounds.

The index is written once: postings (one row per term and item, with its places), the words of each item in order, spellings by
trigram, and items by spelling. Each table is bucketed and sorted by what it is looked up by, so a batch of searches shuffles itself
and what it finds, never the index. A list that is long is cut into shards by the item, as many as its
length asks for, and shards are part of the bucket key; rows carry their facets, so filters apply where rows are read.

An alternative of a search reads the list of its rarest required term only; its other terms are looked for in the items
that it finds there. From counts, first places and least and greatest field weights every candidate has a lower and an upper bound of
its rank. A search keeps those that can still reach its own first ``offset + limit`` rows, and only they are
ranked exactly, equal occurrences once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex import vocabulary as V
from evidex.functions.text import trigram_similarity, trigrams
from evidex.operators import filters as P
from evidex.operators import postings as T
from evidex.operators import search as S
from evidex.operators import search_pages as G
from evidex.operators.fuzzy import shared_grams
from evidex.operators.ordered import top_per_key
from evidex.session import shared_dir, spread, stored

#: Rows of one list in one shard.
SHARD_ROWS = 100_000
_FACETS = ["code", "name", "maker_id", "line", "surface", "opacity", "lo", "hi", "flag"]
_WANTS = ["makers", "lines", "surfaces", "opacities", "want_lo", "want_hi", "want_flag"]
_FLOORS = {"name": V.NAME_SIMILARITY_FLOOR, "code": V.CODE_SIMILARITY_FLOOR}
#: Similarity that is not found by way of the spellings is at most this.
_UNSEEN = max(_FLOORS.values())
#: Spellings of one place in one part.
GRAM_ROWS = 20_000
#: Where spellings are met: a kind, a gram, how many grams they have and how many from this one on.
_PLACE = ["kind", "gram", "n", "rest"]


@dataclass(frozen=True)
class SearchIndex:
    """Bucketed tables: ``terms`` and ``postings`` by term, ``forward`` by item, ``grams``, ``places`` and ``prefixes`` by trigram, ``spelled`` by spelling."""

    tables: S.Tables
    terms: DataFrame
    postings: DataFrame
    forward: DataFrame
    grams: DataFrame
    places: DataFrame
    prefixes: DataFrame
    spelled: DataFrame
    groups: G.Groups
    shard_rows: int = SHARD_ROWS


def _saved(df: DataFrame, keys: Sequence[str], name: str, order: Sequence[str] = ()) -> DataFrame:
    """A table bucketed and sorted by ``keys``, one file a bucket, in the shared folder."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"evidex_{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.option("path", shared_dir(spark, name)).bucketBy(buckets, *keys).sortBy(*keys, *order).saveAsTable(table))
    return spark.table(table)


def _sharded(df: DataFrame, key: str, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(each key's ``seen`` rows and ``shards``, the rows with their ``shard``)."""
    counts = stored(df.groupBy(key).agg(F.count(F.lit(1)).alias("seen")).withColumn("shards", F.ceil(F.col("seen") / shard_rows).cast("int")), f"{key}-counts")
    return counts, df.join(counts, key).withColumn("shard", _shard()).drop("seen", "shards")


def _shard() -> Column:
    return F.pmod(F.xxhash64("item_id"), F.col("shards")).cast("int")


def build_index(t: S.Tables, shard_rows: int = SHARD_ROWS, rare_rows: int = G.RARE_ROWS) -> SearchIndex:
    """Write the index of all items."""
    facets = t.items.select("item_id", *_FACETS)
    places = stored(S.item_postings(t.items), "places")
    groups = G.build_groups(t.items, places, rare_rows, _saved)
    forward = places.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "weight"))).alias("at"))
    lists = places.groupBy("item_id", "term").agg(F.array_sort(F.collect_list(F.struct("pos", "weight"))).alias("at"))
    terms, rows = _sharded(lists.join(facets, "item_id"), "term", shard_rows)
    spellings = stored(t.items.select("item_id", F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("spelling")) for kind in _FLOORS])).alias("s"))
                       .select("s.*").filter("spelling is not null").distinct().withColumn("grams", trigrams(F.col("spelling"))).filter(F.size("grams") > 0), "spellings")
    grams = spellings.select("kind", "spelling", F.explode("grams").alias("gram"))
    seen = stored(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("seen")).withColumn("number", F.monotonically_increasing_id()), "grams")
    by_spelling = t.items.select("item_id", *_FACETS, F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("spelling")) for kind in _FLOORS])).alias("s")).select("*", "s.*").drop("s")
    ids = t.items.filter("item_id is not null").groupBy("item_id").agg((F.count(F.lit(1)) == 1).alias("single"))
    counts, spelled = _sharded(by_spelling.filter("spelling is not null").join(ids, "item_id", "left").withColumn("single", F.coalesce("single", F.lit(False))), "spelling", shard_rows)
    prefixes = stored(_prefixes(_numbered(grams.join(seen, "gram"), ["kind", "spelling"]), ["kind", "spelling"]).filter(_begins()).join(counts.drop("seen"), "spelling"), "prefixes")
    places = prefixes.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("held")).withColumn("parts", F.ceil(F.col("held") / GRAM_ROWS).cast("int")).drop("held")
    return SearchIndex(t, _saved(terms, ["term"], "terms"), _saved(rows, ["term", "shard"], "postings", ["item_id"]), _saved(forward, ["item_id"], "forward"), _saved(seen, ["gram"], "grams"),
                       _saved(places, ["gram"], "places"), _saved(prefixes, _PLACE, "prefixes"), _saved(spelled, ["spelling", "shard"], "spelled", ["item_id"]), groups, shard_rows)


def _numbered(grams: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The grams of a text as numbers, rarest first; those that no spelling has are -1 and come before."""
    ordered = grams.groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("number", F.lit(-1)).alias("number")))).alias("o"))
    return ordered.select(*keep, F.col("o.number").alias("grams"))


def _prefixes(texts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., grams, n, gram, rest): each gram of a text, with the number of its grams from there on."""
    each = texts.select(*keep, "grams", F.size("grams").alias("n"), F.posexplode("grams").alias("at", "gram"))
    return each.withColumn("rest", F.col("n") - F.col("at")).drop("at")


def _floor() -> Column:
    return F.coalesce(*[F.when(F.col("kind") == kind, F.lit(floor)) for kind, floor in _FLOORS.items()])


def _begins() -> Column:
    """Whether a text above the floor of its kind may first be met at this gram (see ``fuzzy``)."""
    return F.col("rest") >= F.ceil(F.col("n") * _floor() - 1e-9)


def _shards() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")


def _wanted(searches: DataFrame) -> DataFrame:
    return searches.select("qid", "text", "makers", "lines", "surfaces", "opacities", F.col("lo").alias("want_lo"), F.col("hi").alias("want_hi"), F.col("flag").alias("want_flag"))


def _plans(terms: DataFrame) -> DataFrame:
    """Per alternative: its required and excluded units, its words, and the words that bar a document."""
    units = terms.groupBy("qid", "grp", "unit", "negated").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("terms"))
    plan = units.groupBy("qid", "grp").agg(F.collect_list(F.when(~F.col("negated"), F.struct("terms"))).alias("required"),
                                           F.collect_list(F.when(F.col("negated"), F.struct("terms"))).alias("excluded"))
    flat = lambda units: F.array_distinct(F.flatten(F.transform(units, lambda u: u["terms"]["term"])))
    return (plan.filter(F.size("required") > 0).withColumn("words", F.array_sort(flat("required"))).withColumn("unwanted", flat("excluded"))
            .withColumn("barred", flat(F.filter("excluded", lambda u: F.size(u["terms"]) == 1))))


def hits(index: SearchIndex, terms: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, grp, item_id, code, name, words, at) of items that satisfy an alternative and pass the search's filters."""
    plan = stored(_plans(terms).withColumn("simple", (F.size("words") == 1) & (F.size("unwanted") == 0) & ~F.exists("required", lambda u: F.size(u["terms"]) > 1)), "search-plans")
    looked = plan.select("qid", "grp", "simple", F.explode("words").alias("term")).join(index.terms, "term", "left")
    # A required word that no item has ends its alternative; of the others the rarest leads.
    lead = looked.groupBy("qid", "grp", "simple").agg(F.min_by(F.struct("term", "shards"), F.struct("seen", "term")).alias("lead"), F.bool_and(F.col("seen").isNotNull()).alias("alive"))
    leads = stored(lead.filter("alive").select("qid", "grp", "simple", "lead.*"), "search-leads")
    first = (leads.select("qid", "grp", "simple", "term", _shards()).join(asked, "qid").join(index.postings, ["term", "shard"]).filter(P.row_passes()))
    single = first.filter("simple").select("qid", "grp", "item_id", "code", "name", F.expr("transform(at, x -> named_struct('pos', x.pos, 'term', term, 'weight', x.weight))").alias("at"))
    # Small on disk, but a row of each side may meet many: both are read in buckets, not one of them in few tasks.
    whole = first.filter("not simple").select("qid", "grp", "item_id", "code", "name").join(index.forward.hint("merge"), "item_id")
    short = plan.select("qid", "grp", "required", "excluded", "words", "barred", F.array_union("words", "unwanted").alias("looked"))
    read = whole.join(short, ["qid", "grp"]).withColumn("at", F.filter("at", lambda x: F.array_contains("looked", x["term"]))).withColumn("held", F.array_distinct(F.transform("at", lambda x: x["term"])))
    read = read.filter((F.size(F.array_except("words", "held")) == 0) & ~F.arrays_overlap("barred", "held")).filter(F.expr(f"forall(required, u -> {T._HOLDS}) and not exists(excluded, u -> {T._HOLDS})"))
    return single.join(plan.select("qid", "grp", "words"), ["qid", "grp"]).unionByName(read.select("qid", "grp", "item_id", "code", "name", "at", "words"))


_MINE = "filter(at, x -> x.term = w)"
_PER_WORD = f"transform(words, w -> named_struct('n', size({_MINE}), 'first', array_min(transform({_MINE}, x -> x.pos)), 'lo', array_min(transform({_MINE}, x -> x.weight)), 'hi', array_max(transform({_MINE}, x -> x.weight))))"
_SUM = "aggregate(filter(at, x -> array_contains(words, x.term)), 0D, (t, x) -> t + x.weight)"
_SPAN = "(array_max(transform(facts, f -> f.first)) - array_min(transform(facts, f -> f.first)) + 1)"
_OF = "(size(words) / aggregate(facts, 0D, (t, f) -> t + 1D / f.{}))"


def with_bounds(rows: DataFrame) -> DataFrame:
    """``low`` and ``high`` of the cover rank of occurrences ``at`` of ``words``.

    At least one cover exists, no wider than from the least to the greatest first place; there are at most as many as occurrences
    less all words but one; and a cover's mean weight lies between those of the words' least and greatest weights.
    One word is exact: each occurrence is a cover.
    """
    exact = F.round(F.expr(_SUM), 6)
    low = F.round(F.expr(f"least(1D, size(words) / {_SPAN}) * {_OF.format('lo')}"), 6) - 2e-6
    high = F.round(F.expr(f"(aggregate(facts, 0, (t, f) -> t + f.n) - size(words) + 1) * {_OF.format('hi')}"), 6) + 2e-6
    one = F.size("words") == 1
    return rows.withColumn("facts", F.expr(_PER_WORD)).withColumns({"low": F.when(one, exact).otherwise(low), "high": F.when(one, exact).otherwise(high)}).drop("facts")


def close_spellings(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """(qid, kind, spelling, near, shards, the filters of ``asked``) of names and codes that are spelled nearly as the search."""
    return stored(_close(index, asked).join(asked, "text").select("qid", "kind", "spelling", "near", *_WANTS, "need", "shards"), "close")


def _close(index: SearchIndex, asked: DataFrame) -> DataFrame:
    """(text, kind, spelling, near, shards) of names and codes that are spelled nearly as a text."""
    grams = asked.select("text").distinct().withColumn("grams", trigrams(F.col("text"))).select("text", F.explode("grams").alias("gram"))
    mine = _prefixes(_numbered(grams.join(index.grams, "gram", "left"), ["text"]), ["text"]).filter("gram >= 0")
    mine = stored(mine.withColumnsRenamed({"grams": "mine", "n": "m", "rest": "left"}), "asked-grams")
    # Two texts share no more grams than follow where they first meet, so places of spellings that this rules out are not read.
    least = F.ceil(_floor() / (1 + _floor()) * (F.col("m") + F.col("n")) - 1e-9)
    places = mine.join(index.places, "gram").filter((F.col("n") >= F.col("m") * _floor()) & (F.col("m") >= F.col("n") * _floor()) & (F.least("left", "rest") >= least))
    met = spread(places.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("left"), *_PLACE, "part", "text")
    cut = index.prefixes.join(index.places, _PLACE).withColumn("part", F.pmod(F.xxhash64("spelling"), F.col("parts")).cast("int")).drop("parts")
    pairs = met.join(cut, [*_PLACE, "part"]).select("text", "kind", "spelling", "shards", "gram", shared_grams("mine", "grams").alias("s"))
    similar = pairs.filter(F.col("s.first") == F.col("gram")).withColumn("near", F.col("s.similarity")).drop("s", "gram")
    above = reduce(Column.__or__, [(F.col("kind") == kind) & (F.col("near") > floor) for kind, floor in _FLOORS.items()])
    return similar.filter(above)


def near(index: SearchIndex, close: DataFrame, have: DataFrame, depths: DataFrame | None, found: DataFrame) -> DataFrame:
    """(qid, item_id, code, name, near) of items that are spelled nearly as the search, filters applied.

    With ``depths`` only those that may stand in the first rows of their search, and those that are ``found`` otherwise: of rows that are
    spellings alone, one goes when as many others as the depth are before it at its best. An id that several items have is not counted, and its rows stay.
    """
    looked = lambda some: (spread(some.select("*", _shards()), "spelling", "shard").join(index.spelled.withColumnRenamed("kind", "of"), ["spelling", "shard"])
                           .filter("kind = of").filter(P.row_passes()).select("qid", "kind", "item_id", "code", "name", "near", "single", "need"))
    bound = looked(close.filter("need <> 0")).join(have, ["qid", "item_id"]).filter("have = need").drop("have")
    rows = looked(close.filter("need = 0")).unionByName(bound).drop("need")
    if depths is not None:
        less = lambda value: -F.round(value, 6)
        worst = _first(rows.filter("single").withColumn("less", less(F.col("near"))).select("qid", "kind", "less", "code", "item_id"), depths, [F.col(c) for c in ("less", "code", "item_id")], "nth", ["qid", "kind"])
        last = stored(worst.filter("nth = depth").groupBy("qid").agg(F.min(F.struct("less", "code", "item_id")).alias("last")), "last-spellings")
        best = F.struct(less(F.greatest("near", F.lit(_UNSEEN))).alias("less"), "code", "item_id")
        rows = rows.join(last, "qid", "left").filter(F.col("last").isNull() | ~F.col("single") | (best <= F.col("last"))).drop("last")
        kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("spelling")) for kind in _FLOORS])).alias("s")
        also = found.select("qid", "item_id", "code", "name", kinds).select("*", "s.*").join(close.select("qid", "kind", "spelling", "near"), ["qid", "kind", "spelling"])
        rows = rows.unionByName(also.select("qid", "kind", "item_id", "code", "name", "near"), allowMissingColumns=True)
    return rows.select("qid", "item_id", "code", "name", "near")


def _first(rows: DataFrame, depths: DataFrame, order: Sequence[Column], number: str, keys: Sequence[str] = ("qid",)) -> DataFrame:
    """The first rows of every search, each to its own depth.

    Depths are dealt to powers of four, so a task hands on at most four times the rows that a search asks for.
    """
    steps = sorted(r[0] for r in depths.filter("depth > 0").select(F.ceil(F.log("depth") / F.log(F.lit(4.0))).cast("int")).distinct().collect())
    parts = []
    for step in steps:
        mine = depths.filter((F.col("depth") <= 4**step) & (F.col("depth") > (4 ** (step - 1) if step else 0)))
        parts.append(top_per_key(rows.join(mine, "qid"), list(keys), order, 4**step, number).filter(F.col(number) <= F.col("depth")))
    return reduce(DataFrame.unionByName, parts) if parts else rows.join(depths, "qid").withColumn(number, F.lit(0)).filter("false")


def survivors(rows: DataFrame, depths: DataFrame) -> DataFrame:
    """Of (qid, item_id, code, tier_low, low, tier_high, high, ...) those that may stand in the first rows of their search.

    A row goes when as many others as the search's depth are before it even at their worst and its best.
    """
    worst = _first(rows.select("qid", "item_id", "code", "tier_low", "low"), depths, [F.col("tier_low"), F.desc("low"), F.col("code"), F.col("item_id")], "nth")
    last = worst.filter("nth = depth").select("qid", F.struct(F.col("tier_low").alias("tier"), (-F.col("low")).alias("less"), "code", "item_id").alias("last"))
    best = F.struct(F.col("tier_high").alias("tier"), (-F.col("high")).alias("less"), "code", "item_id")
    return rows.join(last, "qid", "left").filter(F.col("last").isNull() | (best <= F.col("last"))).drop("last")


def ranked(rows: DataFrame, match_floor: float) -> DataFrame:
    """(qid, item_id, code, tier, rank): the exact rank of (qid, item_id, code, name, text, is_hit, near, alts); equal occurrences are ranked once."""
    alts = rows.select("qid", "item_id", F.explode("alts").alias("a")).select("qid", "item_id", "a.*")
    covers = stored(alts.select("words", "at").distinct(), "covers").withColumn("ts_rank", F.expr(T._COVER_RANK))
    scores = alts.join(covers, ["words", "at"]).groupBy("qid", "item_id").agg(F.max("ts_rank").alias("ts_rank"))
    known = F.greatest(F.coalesce("ts_rank", F.lit(0.0)), F.coalesce("near", F.lit(0.0)))
    close = F.greatest(trigram_similarity(F.col("text"), F.col("name")), trigram_similarity(F.col("text"), F.col("code")))
    best = F.when(known >= _UNSEEN, known).otherwise(F.greatest(known, close))
    tier = F.when(F.col("is_hit") & (F.coalesce("ts_rank", F.lit(0.0)) >= match_floor), "match").otherwise("near")
    return rows.join(scores, ["qid", "item_id"], "left").select("qid", "item_id", "code", tier.alias("tier"), F.round(best, 6).alias("rank"))


def candidates(index: SearchIndex, searches: DataFrame, match_floor: float = V.MATCH_RANK_FLOOR, depths: DataFrame | None = None) -> DataFrame:
    """(qid, item_id, code, name, text, is_hit, near, alts, tier_low, low, tier_high, high) of all that answers searches with text.

    With ``depths``, spellings that cannot stand in the first rows of their search are left out (see ``near``).
    """
    t = index.tables
    texted = searches.filter(F.coalesce(F.trim("text"), F.lit("")) != "")
    asked = stored(_wanted(texted), "asked")
    terms = stored(T.clauses(texted), "clauses")
    have, need = S._permits(t, searches)
    found = with_bounds(spread(hits(index, terms, asked), "qid", "item_id")).select("qid", "item_id", "code", "name", F.struct("words", "at").alias("alt"), "low", "high", F.lit(True).alias("is_hit"), F.lit(None).cast("double").alias("near"))
    rows = found
    barred = T.exclusions(terms)
    if not barred.isEmpty():  # planned only where a search is made of exclusions alone
        lacks = _lacking(index, stored(barred, "barred"), asked)
        rows = rows.unionByName(lacks.withColumns({"low": F.lit(0.0), "high": F.lit(0.0), "is_hit": F.lit(True)}), allowMissingColumns=True)
    rows = stored(rows, "found")
    spelled = near(index, close_spellings(index, asked.join(need, "qid")), have, depths, rows.select("qid", "item_id", "code", "name").distinct())
    rows = rows.unionByName(spelled.withColumn("is_hit", F.lit(False)), allowMissingColumns=True)
    whole = spread(rows, "qid", "item_id").groupBy("qid", "item_id").agg(
        F.max("code").alias("code"), F.max("name").alias("name"), F.bool_or("is_hit").alias("is_hit"), F.max("near").alias("near"), F.collect_list("alt").alias("alts"),
        F.max("low").alias("ts_low"), F.max("high").alias("ts_high"))
    whole = whole.join(have, ["qid", "item_id"], "left").join(need, "qid").filter(F.coalesce("have", F.lit(0)) == F.col("need")).drop("have", "need")
    low = F.greatest(F.coalesce("ts_low", F.lit(0.0)), F.coalesce("near", F.lit(0.0)))
    high = F.greatest(F.coalesce("ts_high", F.lit(0.0)), F.coalesce("near", F.lit(0.0)))
    tier = lambda bound: F.when(F.col("is_hit") & (F.coalesce(bound, F.lit(0.0)) >= match_floor), "match").otherwise("near")
    return whole.join(asked.select("qid", "text"), "qid").withColumns({
        "low": F.round(low, 6), "high": F.round(F.when(low >= _UNSEEN, high).otherwise(F.greatest(high, F.lit(_UNSEEN))), 6), "tier_low": tier("ts_low"), "tier_high": tier("ts_high")}).drop("ts_low", "ts_high")


def _lacking(index: SearchIndex, barred: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, item_id, code, name) of the items that the filters allow and that hold no unit of an alternative made of exclusions."""
    t = index.tables
    alone = barred.select("qid", "grp").distinct().join(asked, "qid")
    listed = S._listed(t, alone, ["qid", "grp", *[w for w in _WANTS if w != "makers"]], _FACETS).withColumn("makers", F.lit(None).cast("array<int>")).filter(P.row_passes())
    each = barred.select("qid", F.struct("grp", "unit").alias("grp"), "unit", F.lit(False).alias("negated"), "place", "term")
    held = hits(index, each, asked).select("qid", F.col("grp.grp").alias("grp"), "item_id")
    return listed.join(held, ["qid", "grp", "item_id"], "left_anti").select("qid", "item_id", "code", "name").distinct()


def browsed(index: SearchIndex, searches: DataFrame) -> DataFrame:
    """(qid, item_id, code, tier, rank) of what blank searches list; filters apply before rows move."""
    t = index.tables
    blank = searches.filter(F.coalesce(F.trim("text"), F.lit("")) == "")
    listed = S._listed(t, _wanted(blank), ["qid", *[w for w in _WANTS if w != "makers"]], _FACETS).withColumn("makers", F.lit(None).cast("array<int>")).filter(P.row_passes())
    have, need = S._permits(t, blank)
    allowed = listed.select("qid", "item_id", "code").join(need, "qid").join(have, ["qid", "item_id"], "left").filter(F.coalesce("have", F.lit(0)) == F.col("need"))
    return allowed.select("qid", "item_id", "code", F.lit("match").alias("tier"), F.lit(1.0).alias("rank"))


def _source(index: SearchIndex) -> G.Source:
    """Texts looked up in the stored index; nothing is filtered yet."""
    def asked(texts: DataFrame) -> DataFrame:
        whole = reduce(lambda df, c: df.withColumn(c, F.lit(None).cast("int" if c in ("want_lo", "want_hi") else "boolean" if c == "want_flag" else "array<string>" if c == "lines" else "array<int>")), _WANTS, texts)
        return stored(whole, "asked-texts")

    def found(terms: DataFrame, texts: DataFrame) -> DataFrame:
        at = stored(hits(index, terms, asked(texts)).select("qid", "item_id", "words", "at"), "found")
        covers = at.select("words", "at").distinct().withColumn("ts_rank", F.expr(T._COVER_RANK))
        return at.join(covers, ["words", "at"]).select("qid", "item_id", "ts_rank")

    return G.Source(index.groups, found, lambda barred, texts: _lacking(index, barred, asked(texts)).select("qid", "item_id", F.lit(0.0).alias("ts_rank")),
                    lambda texts: _close(index, texts).join(texts, "text"))


def index_pages(index: SearchIndex, grouped: DataFrame, match_floor: float = V.MATCH_RANK_FLOOR) -> DataFrame:
    """(qid, item_id, code, tier, rank, position) of the page of every search; ``grouped`` comes from ``collapse``."""
    return pages(index.tables, _source(index), grouped, match_floor, once=True)


def pages(t: S.Tables, source: G.Source, grouped: DataFrame, match_floor: float, once: bool) -> DataFrame:
    """(qid, item_id, code, tier, rank, position) of the page of every search (see ``search_pages``)."""
    low = F.greatest("page_offset", F.lit(0))
    wanted = grouped.select("qid", "rep", low.alias("__low"), (low + F.greatest("page_limit", F.lit(0))).alias("__high"))
    depths = stored(wanted.filter("__high > __low").groupBy(F.col("rep").alias("qid")).agg(F.max("__high").cast("long").alias("depth")), "depths")
    reps = stored(grouped.filter("qid = rep").drop("rep").join(depths.select("qid"), "qid"), "reps")
    each = stored(reps.dropDuplicates(["qid"]), "each")
    rows = G.chosen(source, each, depths, S._permits(t, each), match_floor, _first, once)
    # A search that stands several times in its table meets itself: its rows come that often squared.
    copies = reps.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("copies"))
    order = [F.col("tier"), F.desc("rank"), F.col("code"), F.col("item_id")]
    told = rows.select("qid", "item_id", "code", "tier", "rank").join(copies, "qid").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies") * F.col("copies")))).drop("copies", "copy")
    return (_first(told, depths, order, "position").drop("depth").withColumnRenamed("qid", "rep").join(wanted, "rep").filter("position > __low and position <= __high")
            .select("qid", "item_id", "code", "tier", "rank", "position"))


def search(index: SearchIndex, searches: DataFrame, match_floor: float = V.MATCH_RANK_FLOOR) -> DataFrame:
    """Pages of hits for every search from the stored index."""
    return S.ranked_search(index.tables, searches, match_floor, index)
