"""One query per operator of this subpackage over the given tables, and the SQL for those that SQL can say.

Each maps a table to the entities of the library (``documents`` to items with descriptions, ``pages`` to
snapshots) and the operator's result back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.session import configure


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr("doc_id as item_id", "text as description")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.bpe import recode_descriptions

    coded = recode_descriptions(_items(spark, sf_dir), _tokenizer())
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select(F.col("item_id").alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.quality import score_items, train

    items = _items(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("item_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    reviews = _table(spark, sf_dir, "labels").selectExpr("doc_id as item_id", "quality as accepted").filter(~held_out)
    scored = score_items(items, train(items, reviews))
    return scored.select(F.col("item_id").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.substrings import strip_repeated_passages

    return strip_repeated_passages(_items(spark, sf_dir)).select(
        F.col("item_id").alias("doc_id"), "n_words", "n_removed", F.sha2("description", 256).alias("kept_sha256"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.neardup import near_duplicate_items

    return near_duplicate_items(_items(spark, sf_dir), shingle_words=2, percent=80).withColumnRenamed("item_id", "doc_id")


def op5_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.leaks import leaked_passages

    passages = _table(spark, sf_dir, "benchmark").selectExpr("item_id as passage_id", "text")
    return leaked_passages(_items(spark, sf_dir), passages).withColumnsRenamed({"item_id": "doc_id", "passage_id": "item_id"})


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.order import with_next
    from evidex.llm.winnow import as_text, fingerprints, likeness

    items = _items(spark, sf_dir).withColumns({"description": F.coalesce("description", F.lit("")), "falling": -F.col("item_id")})
    marked = with_next(fingerprints(items), "falling", [F.col("description")], ["description", "prints"], wrap=True, keys=items)
    n = F.char_length("description")
    cut = (n / 3).cast("int")
    edited = F.concat(F.substring("description", F.lit(1), n - cut), F.substring(F.col("next.description"), F.lit(1), cut))
    both = fingerprints(marked.withColumn("n_chars", n.cast("long")).withColumn("edited", edited), "edited", "edited_prints")
    return both.select(F.col("item_id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("prints")).alias("fingerprint"),
                       as_text(F.col("edited_prints")).alias("edited_fingerprint"), likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
                       likeness(F.col("prints"), F.col("next.prints")).alias("near_next"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a full response and, a day later under another spelling of its URL, as a 304 about it.

    Of the 304s some carry a weak tag, some a date, some neither, and some the tag of another body; every eleventh page
    has its 304 before any full response.
    """
    from evidex.llm.revisits import resolve_revisits

    pages = _table(spark, sf_dir, "pages").withColumns({
        "at": F.timestamp_seconds(1_704_067_200 + (F.col("page_id") * 7919) % 86_400), "tag": F.concat(F.lit('"'), F.md5("html"), F.lit('"')),
        "date": F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))})
    full = pages.select(
        (F.col("page_id") * 2).alias("snapshot_id"), "url", F.col("at").alias("fetched_at"), F.lit(200).alias("http_status"), F.col("tag").alias("etag"),
        F.col("date").alias("last_modified"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"), F.col("html").alias("body"))
    late = F.when(F.col("page_id") % 11 == 0, F.col("at") - F.expr("interval 2 days")).otherwise(F.col("at") + F.expr("interval 1 day"))
    tag = F.expr("case when page_id % 7 = 0 then '\"stale\"' when page_id % 5 in (0, 1) then null when page_id % 3 = 1 then concat('W/', tag) else tag end")
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("snapshot_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), late.alias("fetched_at"), F.lit(304).alias("http_status"),
        tag.alias("etag"), F.when(F.col("page_id") % 5 == 0, F.col("date")).alias("last_modified"),
        F.create_map(F.lit("cache-control"), F.concat(F.lit("max-age="), F.col("page_id").cast("string")), F.lit("content-type"), F.lit("text/plain")).alias("headers"), F.lit(None).cast("string").alias("body"))
    found = resolve_revisits(full.unionByName(again))
    return found.select(((F.col("snapshot_id") - 1) / 2).cast("long").alias("page_id"), "canonical_url", "outcome", (F.col("source_id") / 2).cast("long").alias("source_page"),
                        F.md5("body").alias("body_md5"), F.char_length("body").cast("long").alias("n_chars"), F.try_element_at("headers", F.lit("cache-control")).alias("cache_control"),
                        F.try_element_at("headers", F.lit("content-type")).alias("content_type"))


#: Rules and a small labelled table of URLs: the query's parameters.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
UNWANTED = """
    http://www.cheap-pills.example.com/en/12 https://cheap-pills.example.org/fr/907 https://m.buy-pills.example.com/es/4 http://pills-online.example.org/en/88.html
    https://casino-win.example.com/de/5 http://blog.casino-win.example.org/en/640 https://best-casino.example.com/fr/71/ http://win-big.example.org/es/32
    https://free-bets.example.org/en/18 http://www.free-bets.example.com/fr/450 https://sports-bets.example.com/de/6 http://free-spins.example.org/en/203
    https://spam-farm.example.com/en/7 http://m.spam-farm.example.org/es/99 https://link-farm.example.com/en/311 http://www.spam-links.example.org/de/58
    https://adult-x.example.com/en/20 http://blog.adult-x.example.org/fr/118 https://adult-cams.example.org/es/3 http://x-rated.example.com/en/540
    https://ads-track.example.org/en/61 http://www.ads-track.example.com/es/777 https://track-clicks.example.com/fr/9 http://ads-server.example.org/en/415
""".split()
WANTED = """
    http://www.therin.example.com/en/12 https://thether.example.org/fr/907 https://m.ththan.example.com/es/4 http://tionsh.example.org/en/88.html
    https://thered.example.com/de/5 http://blog.ththor.example.org/en/640 https://thonth.example.com/fr/71/ http://theran.example.org/es/32
    https://pottery.example.org/en/18 http://www.glazes.example.com/fr/450 https://studio.example.com/de/6 http://kiln.example.org/en/203
    https://tionble.example.com/en/7 http://m.thernd.example.org/es/99 https://library.example.com/en/311 http://www.weather.example.org/de/58
    https://therha.example.com/en/20 http://blog.ththea.example.org/fr/118 https://museum.example.org/es/3 http://gardens.example.com/en/540
    https://news.example.org/en/61 http://www.recipes.example.com/es/777 https://theron.example.com/fr/9 http://ththly.example.org/en/415
""".split()


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.urls import judge_urls

    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    examples = spark.createDataFrame([(u, 1) for u in UNWANTED] + [(u, 0) for u in WANTED], "url string, unwanted int")
    snapshots = _table(spark, sf_dir, "pages").selectExpr("page_id as snapshot_id", "url")
    return judge_urls(snapshots, rules, examples).withColumnRenamed("snapshot_id", "page_id")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.tokenfile import read_token_files, token_file_folder, write_token_files

    folder = token_file_folder(spark)
    write_token_files(_items(spark, sf_dir), _tokenizer(), 2, folder)
    return read_token_files(spark, folder).select(F.col("item_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.maintext import main_text

    found = main_text(_table(spark, sf_dir, "pages").selectExpr("page_id as snapshot_id", "url", "html as body"))
    return found.select(F.col("snapshot_id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.distinct import distinct_items

    return distinct_items(_items(spark, sf_dir)).withColumnRenamed("item_id", "doc_id")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.manifest import manifest

    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    met = F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", seen={"n_chars": met})


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evidex.llm.negatives import hard_negatives

    readings = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("line"),
        F.col("embedding").alias("lab"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    return hard_negatives(readings)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
for _fn in (op1_bpe, op2_quality, op3_substrings, op4_near_duplicates, op5_leaks, op6_fingerprints, op7_revisits, op8_urls, op9_token_files, op10_main_text, op11_exact_duplicates, op12_manifest, op13_hard_negatives, pipeline):
    def _run(spark: SparkSession, sf_dir: str, fn=_fn) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[_fn.__name__] = _run

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_CANONICAL = r"""(select h || p || case when q <> '' then '?' || q else '' end from (select
    regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), ':(80|443)?$', '') h, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') p,
    array_to_string(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&') q
    from (select regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') rest)))"""
#: CRC-32 of a whole number's digits, bit by bit: each byte is mixed in and followed by eight shifts (-1).
_CRC = """xor(list_reduce(list_prepend(cast(4294967295 as bigint), flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda c: list_prepend(cast(ord(c) as bigint), list_transform(range(8), lambda i: cast(-1 as bigint)))))),
 lambda c, e: case when e >= 0 then xor(c, e) else xor(c >> 1, case when c % 2 = 1 then cast(3988292384 as bigint) else 0 end) end), cast(4294967295 as bigint))"""
_TOUCHED = f"case when {_CRC} % 7 = 0 then n_chars + 1 else n_chars end"


def _leaf(n_chars: str) -> str:
    parts = [f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return f"sha256({' || '.join(parts)})"


#: The next level of lists of nodes, and one step of a record up to it.
_NEXT = "select {g}lvl + 1, list_transform(range(0, (len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) from {t} where len(nodes) > 1"
_SIBLING = "coalesce(a.nodes[f.k + case when f.k % 2 = 1 then 1 else -1 end], '')"
_UP = f"""0 as stage, f.lvl + 1 as lvl, (f.k + 1) // 2 as k, sha256(case when f.k % 2 = 1 then f.now || {_SIBLING} else {_SIBLING} || f.now end) as now,
                f.proof || {_SIBLING} as proof, len(up.nodes) = 1 as done"""
ORACLES: dict[str, str] = {
    "op3_substrings": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        p as (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
        h as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k from p),
        f as (select k, min(doc_id) as first from h group by k having min(doc_id) < max(doc_id)),
        s as (select h.doc_id, h.i from h join f using (k) where h.doc_id > f.first),
        g as (select doc_id, list(distinct c) as gone from (select doc_id, unnest(range(i, i + 50)) as c from s) group by doc_id),
        r as (select d.doc_id, w, coalesce(gone, []) as gone from d left join g using (doc_id)),
        k as (select doc_id, w, gone, list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)) as kept from r)
        select doc_id, cast(len(w) as bigint) as n_words, cast(len(gone) as bigint) as n_removed,
               sha256(coalesce(array_to_string(list_transform(kept, lambda i: w[i]), ' '), '')) as kept_sha256 from k""",
    "op4_near_duplicates": rf"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select doc_id, case when len(w) >= 2 then list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) else w end as x from d),
        n as (select doc_id, x, len(x) as n from s),
        l as (select a.doc_id as a, b.doc_id as b, len(list_intersect(a.x, b.x)) as i, a.n + b.n as t
              from n a join n b on a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) and a.n > 0),
        e as (select a, b from l where 100 * i >= 80 * (t - i)), u as (select a, b from e union all select b, a from e),
        r as (select doc_id as a, doc_id as b from d union select r.a, u.b from r join u on r.b = u.a)
        select r.a as doc_id, cast(any_value(n.n) as bigint) as n_shingles, min(r.b) as component_id, r.a = min(r.b) as kept from r join n on n.doc_id = r.a group by r.a""",
    "op7_revisits": f"""
        with p as (select page_id, url, html, to_timestamp(1704067200 + (page_id * 7919) % 86400) as ts, '"' || md5(html) || '"' as tag, 'day ' || (page_id % 28) as date from pages),
        f as (select page_id, {_CANONICAL} as c, ts, tag, date, html from p),
        v as (select page_id, {_CANONICAL} as c, case when page_id % 11 = 0 then ts - interval 2 day else ts + interval 1 day end as ts,
                     case when page_id % 7 = 0 then '"stale"' when page_id % 5 in (0, 1) then null when page_id % 3 = 1 then 'W/' || tag else tag end as tag,
                     case when page_id % 5 = 0 then date end as date from p),
        j as (select v.page_id, v.c, v.tag, v.date, arg_max({{'id': f.page_id, 'tag': f.tag, 'date': f.date, 'html': f.html}}, (f.ts, f.page_id)) filter (f.page_id is not null) as s
              from v left join f on v.c = f.c and f.ts < v.ts group by all),
        o as (select *, case when s is null then 'missing' when tag is not null then case when regexp_replace(tag, '^W/', '') = s.tag then 'resolved' else 'changed' end
                     when date is not null then case when date = s.date then 'resolved' else 'changed' end else 'resolved' end as outcome from j)
        select page_id, c as canonical_url, outcome, s.id as source_page, case when outcome = 'resolved' then md5(s.html) end as body_md5,
               case when outcome = 'resolved' then cast(length(s.html) as bigint) end as n_chars, case when outcome = 'resolved' then 'max-age=' || page_id end as cache_control,
               case when outcome = 'resolved' then 'text/html' end as content_type from o""",
    "op11_exact_duplicates": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as x from documents)
        select doc_id, min(doc_id) over (partition by x) as keep_id, count(*) over (partition by x) as group_size,
               doc_id is not distinct from min(doc_id) over (partition by x) as kept, sha256(x) as text_sha256 from t""",
    "op12_manifest": f"""
        with recursive h as (select doc_id, lang, {_leaf("n_chars")} as leaf, {_leaf(_TOUCHED)} as seen from documents),
        o as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) as k from h),
        a as (select lang, 0 as lvl, list(leaf order by k) as nodes from o group by lang union all {_NEXT.format(t="a", g="lang, ")}),
        s as (select lang, nodes[1] as subroot, row_number() over (order by lang is not null, lang) as k from a where len(nodes) = 1),
        b as (select 0 as lvl, list(subroot order by k) as nodes from s union all {_NEXT.format(t="b", g="")}),
        f as (select o.doc_id, o.lang, o.leaf, o.k as id, 0 as stage, 0 as lvl, o.k as k, o.seen as now, '' as proof, len(a.nodes) = 1 as done
              from o join a on a.lvl = 0 and a.lang is not distinct from o.lang
              union all select doc_id, lang, leaf, id, stage, lvl, k, now, proof, done from (
                select f.doc_id, f.lang, f.leaf, f.id, {_UP} from f join a on f.stage = 0 and not f.done and a.lvl = f.lvl and a.lang is not distinct from f.lang
                  left join a as up on up.lvl = f.lvl + 1 and up.lang is not distinct from f.lang
                union all select f.doc_id, f.lang, f.leaf, f.id, 1, 0, s.k, f.now, f.proof, len(a.nodes) = 1 from f join s on f.stage = 0 and f.done and s.lang is not distinct from f.lang join b as a on a.lvl = 0
                union all select f.doc_id, f.lang, f.leaf, f.id, {_UP.replace("0 as stage", "1 as stage")} from f join b as a on f.stage = 1 and not f.done and a.lvl = f.lvl left join b as up on up.lvl = f.lvl + 1))
        select doc_id, leaf, s.subroot, b.nodes[1] as root, sha256(proof) as proof_sha256, now as folded_root, now = b.nodes[1] as verified
        from f join s on f.stage = 1 and f.done and s.lang is not distinct from f.lang join b on len(b.nodes) = 1""",
    "op13_hard_negatives": """
        with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
                   where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
                     cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * coalesce(b.v[i], 0))) as bigint) as score
              from r a join r b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
        p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
        from p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * score and score <= positive_score
        qualify rank <= 5""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
