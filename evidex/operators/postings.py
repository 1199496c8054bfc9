"""Weighted postings and matching of many searches at once.

A *search* is free text: terms are all required, ``"a b"`` is a phrase, ``-x`` excludes, ``or``
separates alternatives. ``clauses`` turns a table of texts into rows with two patterns; everything
after that is joins and aggregates on term, search and document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import stemmed, tokens
from evidex.session import spread, stored

# --- fixed values: English stop words left out of the index -------------------------------------
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
              "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they",
              "this", "to", "was", "will", "with"]
UNIT = r'-?"[^"]*"|\S+'


def terms_of(col: Column) -> Column:
    """Index terms of a text: stemmed tokens, stop words kept in place as null so positions hold."""
    return F.transform(tokens(col), lambda t: F.when(~t.isin(STOP_WORDS), stemmed(t)))


def postings(docs: DataFrame, doc_id: str, fields: Sequence[tuple[Column, float]]) -> DataFrame:
    """(doc, pos, term, weight): fields follow one another in one position space.

    Tokens are exploded first and stemmed as plain columns, inside generated code.
    """
    named = [f"__f{i}" for i in range(len(fields))]
    split = docs.select(F.col(doc_id), *[F.coalesce(tokens(col), F.array().cast("array<string>")).alias(n) for n, (col, _) in zip(named, fields, strict=True)])
    ends, total = [], F.lit(0)
    for n in named:
        total = total + F.size(n)
        ends.append(total)
    placed = split.select(doc_id, *[e.alias(f"__e{i}") for i, e in enumerate(ends)], F.posexplode(F.concat(*named)).alias("pos", "token"))
    weight = F.lit(fields[-1][1])
    for i in reversed(range(len(fields) - 1)):
        weight = F.when(F.col("pos") < F.col(f"__e{i}"), fields[i][1]).otherwise(weight)
    # As an exploded value a term is worked out once; as a plain column it would be again in every filter and key that reads it.
    return placed.filter(~F.col("token").isin(STOP_WORDS)).select(
        doc_id, "pos", F.explode(F.array(stemmed(F.col("token")))).alias("term"), weight.alias("weight"))


def clauses(searches: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """(qid, grp, unit, negated, place, term): alternatives, their units, and the terms of each unit.

    A bare ``or`` separates alternatives; inside quotes it is a word like any other.
    ``place`` is the offset of a term inside its unit (0 unless the unit is a phrase).
    """
    units = F.regexp_extract_all(F.lower(F.trim(F.col(text))), F.lit(f"({UNIT})"), 1)
    before = F.slice("__units", F.lit(1), F.col("__n"))
    grp = F.size(F.filter(before, lambda u: u == "or"))
    since = F.array_position(F.reverse(before), "or").cast("int")
    return (searches.select(qid, units.alias("__units"))
            .select(qid, "__units", F.posexplode("__units").alias("__n", "__u")).filter("__u <> 'or'")
            .select(qid, grp.alias("grp"), F.when(since > 0, since - 1).otherwise(F.col("__n")).alias("unit"), F.col("__u").startswith("-").alias("negated"),
                    F.posexplode(terms_of(F.col("__u"))).alias("place", "term"))
            .filter("term is not null"))


#: Does a document's ordered occurrence list ``at`` hold unit ``u``, its terms at their offsets?
_HOLDS = """exists(at, x -> x.term = u.terms[0].term and forall(u.terms, k -> k.place = u.terms[0].place
    or exists(at, y -> y.term = k.term and y.pos = x.pos + k.place - u.terms[0].place)))"""

_STATE = "struct<seen:array<struct<pos:int,weight:double>>,start:int,score:double>"
_COVER_RANK = f"""aggregate(filter(at, x -> array_contains(words, x.term)),
    cast(named_struct('seen', transform(words, w -> named_struct('pos', cast(null as int), 'weight', cast(null as double))),
                      'start', -1, 'score', 0D) as {_STATE}),
    (acc, x) -> aggregate(
        array(transform(acc.seen, (v, i) -> if(words[i] = x.term, named_struct('pos', x.pos, 'weight', x.weight), v))),
        acc,
        (a, seen) -> aggregate(
            array(if(exists(seen, v -> v.pos is null), null, array_min(transform(seen, v -> v.pos)))),
            a,
            (b, s) -> cast(if(s > b.start,
                named_struct('seen', seen, 'start', s, 'score', b.score
                    + least(1D, size(words) / (x.pos - s + 1))
                    * size(words) / aggregate(seen, 0D, (t, v) -> t + 1D / v.weight)),
                named_struct('seen', seen, 'start', b.start, 'score', b.score)) as {_STATE}))),
    acc -> round(acc.score, 6))"""


def matches(index: DataFrame, terms: DataFrame, doc_id: str) -> DataFrame:
    """(qid, grp, doc, cover_rank) of documents that satisfy an alternative of a search.

    Alternatives made of exclusions only have no words to look up and give no row here; see ``lacking``.

    The rank is cover density (Clarke, Cormack, Tudhope): a cover is a shortest span holding all K
    required terms; it scores ``min(1, K / span)`` times the harmonic mean of the field weights of
    the K positions that realise it.

    Asked words are counted first, which moves one number a word and task. Then their postings are gathered by document, once. A document
    meets only the alternatives whose rarest required word it holds; their other words are looked for in the words it holds, and phrases
    and covers are read off its own list of occurrences, so no row is made per word of a search.
    """
    known = terms.select("term").distinct()
    asked = index.join(known, "term", "left_semi")
    vocabulary = stored(asked.groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
                        .withColumn("number", F.monotonically_increasing_id()), "vocabulary")
    # Words are numbers from here on; a word that no document has is -1, which no document holds.
    numbered = terms.join(vocabulary, "term", "left").withColumn("number", F.coalesce("number", F.lit(-1)))
    plan, leads = _alternatives(numbered)
    lead_words = leads.select(F.col("lead").alias("number")).distinct().withColumn("leads", F.lit(True))
    marked = asked.join(vocabulary.join(lead_words, "number", "left").select("term", "number", "leads"), "term")
    held = (spread(marked.select(doc_id, "pos", "number", "weight", "leads"), doc_id).groupBy(doc_id)
            .agg(F.array_sort(F.collect_list(F.struct("pos", F.col("number").alias("term"), "weight"))).alias("at"),
                 F.collect_set(F.when(F.col("leads"), F.col("number"))).alias("leading")))
    met = (held.withColumn("held", F.array_distinct("at.term")).select(doc_id, "at", "held", F.explode("leading").alias("lead"))
           .join(leads, "lead").join(plan, ["qid", "grp"])
           .filter((F.size(F.array_except("words", "held")) == 0) & ~F.arrays_overlap("barred", "held")))
    # Presence settles single words; only phrases need places.
    passed = met.filter(F.expr(f"not phrased or (forall(required, u -> {_HOLDS}) and not exists(excluded, u -> {_HOLDS}))"))
    alone = F.round(F.expr("aggregate(filter(at, x -> x.term = words[0]), 0D, (t, x) -> t + x.weight)"), 6)
    return (passed.filter(F.col("easy") | F.col(doc_id).isNotNull())
            .select("qid", "grp", doc_id, F.when(F.col("easy"), alone).otherwise(F.expr(_COVER_RANK)).alias("cover_rank")))


def _alternatives(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alternatives that require a word: units, words and barred words; (qid, grp, lead): the rarest required word of each)."""
    units = numbered.groupBy("qid", "grp", "unit", "negated").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("number").alias("term")))).alias("terms"))
    plan = units.groupBy("qid", "grp").agg(
        F.collect_list(F.when(~F.col("negated"), F.struct("terms"))).alias("required"),
        F.collect_list(F.when(F.col("negated"), F.struct("terms"))).alias("excluded"))
    flat = lambda units: F.array_distinct(F.flatten(F.transform(units, lambda u: u["terms"]["term"])))
    plan = (plan.filter(F.size("required") > 0)
            .withColumn("words", F.array_sort(flat("required")))
            .withColumn("barred", flat(F.filter("excluded", lambda u: F.size(u["terms"]) == 1)))
            .withColumn("phrased", F.exists(F.concat("required", "excluded"), lambda u: F.size(u["terms"]) > 1))
            .withColumn("easy", (F.size("words") == 1) & ~F.arrays_overlap("words", "barred") & ~F.col("phrased")))
    leads = numbered.filter("not negated").groupBy("qid", "grp").agg(F.min_by("number", F.struct(F.coalesce("seen", F.lit(0)), "number")).alias("lead"))
    return stored(plan, "alternatives"), stored(leads, "leads")


def exclusions(terms: DataFrame) -> DataFrame:
    """The terms of alternatives that are made of exclusions only."""
    return terms.join(terms.filter("not negated").select("qid", "grp"), ["qid", "grp"], "left_anti")


def lacking(index: DataFrame, barred: DataFrame, listed: DataFrame, doc_id: str) -> DataFrame:
    """Rows of ``listed`` (qid, grp, doc) that hold no unit of their alternative in ``barred`` (see ``exclusions``).

    Every barred unit is looked up as an alternative of its own; what holds one is taken off the list.
    """
    each = barred.select("qid", F.struct("grp", "unit").alias("grp"), "unit", F.lit(False).alias("negated"), "place", "term")
    held = matches(index, each, doc_id).select("qid", F.col("grp.grp").alias("grp"), doc_id)
    return listed.join(held, ["qid", "grp", doc_id], "left_anti")
