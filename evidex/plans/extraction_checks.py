"""Sources and bulk extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.color import centre_box, inset_box
from evidex.operators import filenames as N
from evidex.operators import replay as replay_of
from evidex.operators.snapshots import newest
from evidex.plans.registry import check
from evidex.plans.views import Catalog
from evidex.session import shared_dir, spread
from evidex.sources import files
from evidex.sources import html_pages as H
from evidex.sources import json_products as J
from evidex.sources import sitemap


@check("sitemap_scan", """select url, case when page_id % 7 = 0 then null when page_id % 3 = 0 then null else cast(epoch(timestamp '2024-01-01 10:00:00' + to_days(cast(page_id as integer))) as bigint) end mod_s
 from pages where url like '%/en/%'""")
def sitemap_scan(c: Catalog) -> DataFrame:
    listing = c.table("pages").selectExpr("url", """case when page_id % 7 = 0 then 'last tuesday' when page_id % 3 <> 0 then
        concat(date_format(timestamp '2024-01-01 10:00:00' + make_dt_interval(cast(page_id as int)), "yyyy-MM-dd'T'HH:mm:ss"), 'Z') end as lastmod""")
    path = shared_dir(c.spark, "sitemap")
    sitemap.write_sitemaps(listing, path)
    return sitemap.read_sitemaps(c.spark, path, "/en/").select("url", F.unix_seconds("lastmod").alias("mod_s"))


@check("json_products", """select p_partkey, case when p_partkey % 3 < 2 then 'SW-' || p_partkey else 'NT' || substr('ABCDE', 1 + cast(p_partkey % 5 as integer), 1) end code,
 p_name || ' & co®' as name, p_type || ': ' || p_brand description, replace(p_name, ' ', '-') || '-' || p_partkey external_id,
 case p_partkey % 5 when 0 then 'flux' when 1 then 'ritual' when 3 then 'raku' when 4 then 'raku' end line_code,
 case p_partkey % 5 when 0 then 'Flux' when 1 then 'ritual' when 3 then 'Raku' when 4 then 'Raku & Pit' end line_name,
 case p_partkey % 5 when 0 then 'flux' when 1 then 'ritual' end range_category,
 case when p_partkey % 2 = 0 then 'InStock' else 'OutOfStock' end availability
 from part where p_partkey % 29 <> 0 and not (p_partkey % 31 = 0 and (p_partkey % 4 = 0 or p_partkey % 6 <> 0))""")
def json_products(c: Catalog) -> DataFrame:
    rows = J.product_rows(J.parse_products(c.json_products), ["p_partkey"])
    return rows.select("p_partkey", "code", "name", "description", "external_id", "line_code", "line_name", "range_category", "availability")


@check("json_dead_letters", """select p_partkey, case when p_partkey % 29 = 0 then 'unreadable payload' else 'price without scale' end reason from part
 where p_partkey % 29 = 0 or (p_partkey % 31 = 0 and (p_partkey % 4 = 0 or p_partkey % 6 <> 0))""")
def json_dead_letters(c: Catalog) -> DataFrame:
    parsed = J.parse_products(c.json_products)
    return parsed.select("p_partkey", J.dead_letter_reason(F.col("product")).alias("reason")).filter("reason is not null")


@check("badge_merge", """select p_partkey, 'dinnerware_safe' badge, p_partkey % 2 = 0 as value from part where p_partkey % 29 <> 0
 union all select p_partkey, case p_partkey % 4 when 2 then 'food_safe' else 'ap_seal' end, p_partkey % 4 <> 1 from part where p_partkey % 29 <> 0 and p_partkey % 4 <> 3""")
def badge_merge(c: Catalog) -> DataFrame:
    values = J.attribute_values(J.parse_products(c.json_products), ["p_partkey"])
    return J.badges(values, ["p_partkey"])


@check("badge_unknown", "select p_partkey, 'foodsafe=who-knows' as unknown from part where p_partkey % 29 <> 0 and p_partkey % 4 = 3")
def badge_unknown(c: Catalog) -> DataFrame:
    return J.unknown_attributes(J.attribute_values(J.parse_products(c.json_products), ["p_partkey"]), ["p_partkey"])


@check("value_token", """select p_partkey, 'foodsafe' as key, unnest(case p_partkey % 4 when 0 then ['ap-acmi'] when 1 then ['cl-acmi', 'ap-acmi'] when 2 then ['food-safe'] else ['non-toxic', 'who-knows'] end) token from part where p_partkey % 29 <> 0
 union all select p_partkey, 'dinnerwaresafe', case when p_partkey % 2 = 0 then 'dinnerware-safe' else 'not-dinnerware-safe' end from part where p_partkey % 29 <> 0""")
def value_token(c: Catalog) -> DataFrame:
    return J.attribute_values(J.parse_products(c.json_products), ["p_partkey"])


@check("line_of", """select p_partkey, case p_partkey % 5 when 0 then 'flux' when 1 then 'ritual' else 'raku' end line, case when p_partkey % 5 = 0 then '6' end range_from, case when p_partkey % 5 = 0 then '10' end range_to
 from part where p_partkey % 29 <> 0 and p_partkey % 5 <> 2""")
def line_of(c: Catalog) -> DataFrame:
    table = F.create_map(*[x for k, (lo, hi) in J.LINE_RANGES.items() for x in (F.lit(k), F.array(F.lit(lo), F.lit(hi)))])
    lined = J.parse_products(c.json_products).withColumn("line", J.line_of(F.col("product.categories"))["slug"]).filter("line is not null")
    found = F.try_element_at(table, F.col("line"))
    return lined.select("p_partkey", "line", found[0].alias("range_from"), found[1].alias("range_to"))


_NAV = r"(?is)<nav[^>]*>(.*?)</nav>"


@check("page_fields", """select page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')), '') title,
 nullif(regexp_extract(html, '(?i)<html[^>]*\\blang="([^"]*)"', 1), '') lang,
 len(regexp_extract_all(regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), '(?is)<a\\b[^>]*href="[^"]+"')) n_nav,
 len(regexp_extract_all(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?i)<p>')) n_paragraphs,
 length(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)) article_chars from pages""")
def page_fields(c: Catalog) -> DataFrame:
    fields = H.page_fields(c.table("pages"))
    return fields.select("page_id", F.nullif("title", F.lit("")).alias("title"), "lang", *[F.col(n).cast("bigint").alias(n) for n in ("n_nav", "n_paragraphs", "article_chars")])


@check("page_links", """with l as (select page_id, regexp_extract_all(regexp_extract(html, '(?is)<nav[^>]*>(.*?)</nav>', 1), '(?is)<a\\b[^>]*>') tags from pages),
 u as (select page_id, unnest([regexp_extract(t, 'href="([^"]+)"', 1) for t in tags]) source_url, generate_subscripts(tags, 1) - 1 place from l)
 select page_id, cast(place as integer) place, source_url, regexp_extract(regexp_extract(source_url, '^([^?#]*)', 1), '([^/]*)$', 1) raw_filename from u where source_url <> ''""")
def page_links(c: Catalog) -> DataFrame:
    return H.gallery_images(c.table("pages"), ["page_id"], container=_NAV, tag=r"(?is)<a\b[^>]*>")


@check("filename_facts", """with f as (select *, p % 4 k, 'SW-' || d1 c1, 'SW-' || d2 c2, 'SW-' || (d2 + 1) c3 from filenames),
 g as (select *, case k when 0 then c1 when 1 then c2 end as top, case k when 0 then c2 when 1 then c1 end as base from f),
 h as (select *, case when base is not null and product_code <> base then base end layered_over from g),
 r as (select *, case when layered_over is null and k = 3 then c1 || ',' || c2 || ',' || c3 when layered_over is null and k in (0, 1) then c1 || ',' || c2 else '' end combination,
   case when p % 6 = 0 then 'bowl' when p % 6 = 1 then 'flat_tile' end form, case when p_size % 3 = 0 then cast(1 + p_size % 14 as varchar) when p_size % 3 = 1 then '06' when alt is not null then '5' end cone,
   case when p % 5 = 0 then '1234' end coats, array_to_string([w for w in [case when p % 9 = 0 then 'glossy' end, case when alt is not null then 'white' end, case when alt is not null then 'clay' end, case when alt is not null then 'oxidation' end] if w is not null], ',') unmatched from h)
 select image_id, layered_over, combination, coalesce(top, case when product_code in (c1, case when k = 3 then c2 end) then product_code end, c1) subject, cone, coats, form, unmatched,
 case when p % 23 = 0 then 'line_chart' when layered_over is not null then 'layered' when combination <> '' or coats is not null then 'other' when form = 'bowl' then 'in_use' else 'label_chip' end as role,
 case when combination <> '' then 'low' when unmatched <> '' then 'medium' else 'high' end confidence from r""", "filenames")
def filename_facts(c: Catalog) -> DataFrame:
    facts = N.source_b_facts(c.filenames)
    return facts.select("image_id", "layered_over", F.array_join("combination", ",").alias("combination"), "subject", "cone", "coats", "form",
                        F.array_join("unmatched", ",").alias("unmatched"), "role", "confidence")


@check("filename_evidence", """with f as (select *, p % 4 k, 'SW-' || d1 c1, 'SW-' || d2 c2, 'SW-' || (d2 + 1) c3 from filenames)
 select image_id, c1 || case when k <> 2 then ',' || c2 else '' end || case when k = 3 then ',' || c3 else '' end codes,
 case k when 0 then c1 || ' over ' || c2 when 1 then c2 || ' over ' || c1 end layering, case k when 0 then 'over' when 1 then 'under' when 3 then 'over' end direction,
 case when k = 1 or (k = 0 and p % 10 = 0) then case k when 0 then c1 else c2 end end layered_under, case when p_size % 3 = 2 and alt is not null then 'cone 5' end cone_from_alt, case when p % 23 = 0 then 'lineup' end line_image from f""", "filenames")
def filename_evidence(c: Catalog) -> DataFrame:
    facts = N.source_b_facts(c.filenames)
    e = {"codes": "glaze_code", "layering": "layering", "direction": "layering_direction", "layered_under": "layered_under", "cone_from_alt": "cone_from_alt", "line_image": "line_image"}
    return facts.select("image_id", *[F.try_element_at("evidence", F.lit(key)).alias(out) for out, key in e.items()])


@check("filename_facts_a", """with f as (select p_partkey, p_partkey % 6 k, 1 + p_partkey % 97 d1, 1 + p_partkey % 53 d2, p_name, string_split(p_name, ' ') w from part)
 select p_partkey, case k when 0 then 'layered' when 1 then 'layered' when 2 then 'label_chip' when 3 then 'in_use' when 4 then 'coats_composite' else 'line_chart' end as role,
 case k when 5 then null else 'PC-' || d1 end subject, case when k in (0, 1) then 'SM-' || d2 end layered_over, case when k = 3 then 16 end clay, case when k = 0 then '6' when k = 2 then '05' end cone,
 case when k = 3 and w[2] = 'plate' then 'plate' when k = 3 then 'vase' when k = 2 then 'flat_tile' end form, case when k = 2 then '4x4' end tile_size,
 case when k = 4 then 'jenh' else '' end unmatched, case when k = 5 then 'low' when k = 4 then 'medium' else 'high' end confidence from f""")
def filename_facts_a(c: Catalog) -> DataFrame:
    names = c.table("part").selectExpr("p_partkey", "p_name as product_name", "concat('PC-', 1 + p_partkey % 97) as product_code", """concat(case p_partkey % 6
        when 0 then concat('PC-', 1 + p_partkey % 97, '_over_SM-', lpad(1 + p_partkey % 53, 2, '0'), '_Cone6')
        when 1 then concat('pc-', 1 + p_partkey % 97, 'oversm-', 1 + p_partkey % 53)
        when 2 then concat('PC-', lpad(1 + p_partkey % 97, 3, '0'), '_', replace(p_name, ' ', ''), '_cone05_4x4_chip-hires')
        when 3 then concat('PC-', 1 + p_partkey % 97, '_16M_Vase_', replace(p_name, ' ', '_'))
        when 4 then concat('pc-', 1 + p_partkey % 97, '-application-tiles_JenH')
        else 'Potters_Color-Chart' end, case when p_partkey % 2 = 0 then '__54961.1659532780' else '' end, '.jpg') as filename""")
    facts = N.source_a_facts(names.withColumn("filename", F.replace("filename", F.lit("Potters_"), F.lit(""))))
    return facts.select("p_partkey", "role", "subject", "layered_over", "clay", "cone", "form", "tile_size", F.array_join("unmatched", ",").alias("unmatched"), "confidence")


@check("residual_tokens", """select image_id, unnest([w for w in [case when p % 9 = 0 then 'glossy' end, case when alt is not null then 'white' end, case when alt is not null then 'clay' end, case when alt is not null then 'oxidation' end] if w is not null]) token from filenames""", "filenames")
def residual_tokens(c: Catalog) -> DataFrame:
    return N.source_b_facts(c.filenames).select("image_id", F.explode("unmatched").alias("token"))


@check("bulk_replay", """with b as (select p_partkey, p_partkey % 29 <> 0 ok, p_partkey % 31 = 0 and (p_partkey % 4 = 0 or p_partkey % 6 <> 0) bad from part)
 select 'payloads' metric, count(*) n from b union all select 'products', count(*) from b where ok and not bad union all select 'dead_letters', count(*) from b where not ok or bad
 union all select 'images', sum(case when p_partkey % 7 = 0 then 1 else 2 end)::bigint from b where ok and not bad
 union all select 'badges', sum(case when p_partkey % 4 = 3 then 1 else 2 end)::bigint from b where ok and not bad union all select 'unknown_attributes', count(*) from b where ok and not bad and p_partkey % 4 = 3""")
def bulk_replay(c: Catalog) -> DataFrame:
    """The newest payload of every product to all its tables, counted from one parsed table."""
    log = c.json_products.selectExpr("p_partkey as url", "explode(array(0, 1)) as n", "body").selectExpr(
        "url", "n as id", "n as fetched_s", "case when n = 0 then '[]' else body end as body")
    return replay(newest(log), "url").select("metric", "n")


def replay(log: DataFrame, key: str) -> DataFrame:
    from evidex.session import stored

    parsed = stored(J.parse_products(log.select(key, "body")).drop("body").withColumn("reason", J.dead_letter_reason(F.col("product"))), "parsed")
    good = parsed.filter("reason is null")
    values = J.attribute_values(good, [key])
    parts = {"payloads": parsed, "products": J.product_rows(good, [key]), "dead_letters": parsed.filter("reason is not null"),
             "images": J.images(good, [key]), "badges": J.badges(values, [key]), "unknown_attributes": J.unknown_attributes(values, [key])}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@check("crop_boxes", """with w as (select page_id, cast(200 + length(html) % 900 as integer) w, cast(100 + length(html) % 700 as integer) h from pages)
 select page_id, w // 2 - cast(floor(w * 0.4 / 2) as integer) cx0, h // 2 + cast(floor(h * 0.4 / 2) as integer) cy1, 10 + cast(floor((w - 10) * 0.18) as integer) ix0, 20 + cast(floor((h - 20) * 0.62) as integer) iy1 from w""")
def crop_boxes(c: Catalog) -> DataFrame:
    sized = c.table("pages").selectExpr("page_id", "200 + length(html) % 900 as w", "100 + length(html) % 700 as h")
    boxes = sized.select("page_id", centre_box(F.col("w"), F.col("h")).alias("c"), inset_box(F.lit(10), F.lit(20), F.col("w"), F.col("h")).alias("i"))
    return boxes.select("page_id", F.col("c.left").alias("cx0"), F.col("c.bottom").alias("cy1"), F.col("i.left").alias("ix0"), F.col("i.bottom").alias("iy1"))


@check("content_files", r"""select 'p/' || substr(h, 1, 2) || '/' || h || '.jpg' storage_key, bytes, count(*) n_paths, count(distinct s_suppkey) n_owner, min(s_suppkey) first_owner from (
 select s_suppkey, sha256(b || chr(10)) h, octet_length(encode(b)) + 1 bytes from (select s_suppkey, n_name || ' 0x' || (s_suppkey % 3) b from supplier join nation on n_nationkey = s_nationkey)) group by all""")
def content_files(c: Catalog) -> DataFrame:
    """A picture file per supplier, many of them with one content, landed below a folder each."""
    root = shared_dir(c.spark, "pictures")
    pictures = c.table("supplier").join(c.table("nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").selectExpr(
        "s_suppkey as owner", "concat(n_name, ' 0x', s_suppkey % 3) as content")
    # Many small files: written by all tasks, and put in place by the tasks themselves, not one after another by the driver.
    spread(pictures, "owner").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("owner").text(root)
    found = files.read_files(c.spark, root, "part-*").withColumn("owner", F.regexp_extract("path", "/owner=([0-9]+)/", 1).cast("bigint"))
    first = found.groupBy("sha256").agg(F.min("owner").alias("first_owner"))
    return files.stored_once(found, "owner").join(first, "sha256").select("storage_key", "bytes", "n_paths", "n_owner", "first_owner")


_PAGE = """pp as (select p_partkey p, p_name, p_type, p_brand, p_retailprice price, lpad(cast(1 + p_partkey % 97 as varchar), 2, '0') n, ['PC', 'SM', 'pcf', 'C'][1 + p_partkey % 4] pre, p_partkey % 13 = 0 bare, p_partkey % 7 = 0 untold from part)"""


@check("page_products", f"""with {_PAGE} select p p_partkey, case when bare then '' else pre || '-' || n || ' ' end || p_name || ' & co' as name, case when bare then p_name || ' & co' else upper(pre) || '-' || (1 + p % 97) end code,
 case when not bare then upper(pre) end line_code, case when not bare then ['Potter''s Choice', 'Satin Matte', 'Potter''s Choice Flux', 'Celadon'][1 + p % 4] end line_name,
 case when p % 8 <> 1 then 'Mid & High' end range_category, case when p % 8 = 1 then 3 else 5 end n_crumbs, case when not untold then 'Fires at 1222°C. ' || p_brand end description,
 case when not untold and p % 3 < 2 then cast(price as decimal(18, 2)) end price_min, case when not untold and p % 3 < 2 then cast(case when p % 3 = 0 then price * 2 else price end as decimal(18, 2)) end price_max,
 case when not untold and p % 2 = 0 then 'InStock' end availability from pp""")
def page_products(c: Catalog) -> DataFrame:
    rows = H.product_fields(c.product_pages, ["p_partkey"], "body")
    return rows.select("p_partkey", "name", "code", "line_code", "line_name", "range_category", F.size("breadcrumb").alias("n_crumbs"), "description", "price_min", "price_max", "availability")


@check("page_gallery", f"""with {_PAGE} select p p_partkey, 0 as place, 'PC-' || n || '_Chip.jpg' raw_filename from pp union all select p, 1, 'Vase.jpg' from pp where p % 2 = 0""")
def page_gallery(c: Catalog) -> DataFrame:
    return H.gallery_images(c.product_pages, ["p_partkey"], "body").select("p_partkey", "place", "raw_filename")


_ICONS = """ic as (select p_partkey, k, (p_partkey + k) % 6 i from part cross join (values (0), (1), (2), (3)) v(k) where k <= p_partkey % 4)"""


@check("icon_badges", f"""with {_ICONS}, b as (select p_partkey, k, ['opacity', 'ap_seal', 'ap_seal', 'food_safe', 'prop65'][1 + i] badge, ['opaque', 'true', 'false', 'false', 'true'][1 + i] as v from ic where i < 5)
 select p_partkey, badge, arg_max(v, k) as value from b group by all""")
def icon_badges(c: Catalog) -> DataFrame:
    return H.icon_badges(c.product_pages, ["p_partkey"], "body")[0]


@check("icon_unknown", f"with {_ICONS} select p_partkey, 'new-icon.png' as unknown from ic where i = 5")
def icon_unknown(c: Catalog) -> DataFrame:
    return H.icon_badges(c.product_pages, ["p_partkey"], "body")[1]


@check("value_token_entities", """select p_partkey, case p_partkey % 4 when 0 then 'food-oven-safe' when 1 then 'caf-safe' when 2 then 'a-b-1222-c' else replace(p_name, ' ', '-') || '-3' end token from part""")
def value_token_entities(c: Catalog) -> DataFrame:
    """Values with character references, as prose, as an address and as an image tag."""
    raw = F.expr("""case p_partkey % 4 when 0 then 'Food &amp; Oven&#45;Safe' when 1 then 'https://cdn.example.com/i/Caf&eacute;-safe.png?z=1' when 2 then '<img src="/i/A&nbsp;B-1222&deg;C.png">'
        else concat(p_name, ' &lt;3&gt;') end""")
    return c.table("part").select("p_partkey", J.value_token(raw).alias("token"))


def _payload_log(c: Catalog) -> DataFrame:
    """Two payloads of every product, of which the later one counts."""
    log = c.json_products.selectExpr("p_partkey as url", "explode(array(0, 1)) as n", "body").selectExpr("url", "n as id", "n as fetched_s", "case when n = 0 then '[]' else body end as body")
    return newest(log)


def _rows_of(found: replay_of.Replay) -> DataFrame:
    """All tables of a replay as (kind, url, detail)."""
    parts = {"product": (found.products, "code"), "image": (found.images, "concat_ws('|', raw_filename, role, subject, confidence)"), "badge": (found.badges, "concat(badge, '=', value)"),
             "unknown": (found.unknown, "unknown"), "dead": (found.dead_letters, "reason")}
    out = None
    for kind, (df, detail) in parts.items():
        one = df.select(F.lit(kind).alias("kind"), F.col("url"), F.expr(detail).alias("detail"))
        out = one if out is None else out.unionByName(one)
    return out


_GOOD = """gd as (select p_partkey p, p_type t, p_partkey % 29 <> 0 ok, p_partkey % 31 = 0 and (p_partkey % 4 = 0 or p_partkey % 6 <> 0) bad,
   case when p_partkey % 3 < 2 then 'SW-' || p_partkey else 'NT' || substr('ABCDE', 1 + cast(p_partkey % 5 as integer), 1) end code from part),
 im as (select p, code, 'sw' || p || '_cone6-300x300.jpg' f, p < 10000 as read from gd where ok and not bad union all select p, code, 'line-' || t || '.jpg', false from gd where ok and not bad and p % 7 <> 0),
 fa as (select p, f, case when read then 'label_chip' else 'other' end as role, case when read then 'SW-' || p else code end subject,
   case when f like 'line-%' or not read then 'medium' else 'high' end confidence from im)"""


@check("replay_rows", f"""with {_GOOD} select 'product' kind, p url, code detail from gd where ok and not bad
 union all select 'image', p, f || '|' || role || '|' || subject || '|' || confidence from fa
 union all select 'badge', p, 'dinnerware_safe=' || (p % 2 = 0) from gd where ok and not bad union all select 'badge', p, case p % 4 when 2 then 'food_safe=' else 'ap_seal=' end || (p % 4 <> 1) from gd where ok and not bad and p % 4 <> 3
 union all select 'unknown', p, 'foodsafe=who-knows' from gd where ok and not bad and p % 4 = 3
 union all select 'dead', p, case when not ok then 'unreadable payload' else 'price without scale' end from gd where not ok or bad""")
def replay_rows(c: Catalog) -> DataFrame:
    return _rows_of(replay_of.replay_payloads(_payload_log(c)))


@check("replay_funnel", f"""with {_GOOD} select 'bodies' step, count(*) n from gd union all select 'products', count(*) from gd where ok and not bad union all select 'dead_letters', count(*) from gd where not ok or bad
 union all select 'images', count(*) from fa union all select 'high', count(*) from fa where confidence = 'high' union all select 'medium', count(*) from fa where confidence = 'medium' union all select 'low', 0""")
def replay_funnel(c: Catalog) -> DataFrame:
    """The counts that the writes of a replay observed."""
    return _funnel(c, replay_of.replay_payloads(_payload_log(c)))


def _funnel(c: Catalog, found: replay_of.Replay) -> DataFrame:
    from evidex.session import literal_table

    return literal_table(c.spark, "step string, n bigint", list(found.funnel.items()))


@check("replay_pages", f"""with {_PAGE}, {_ICONS}, im as (select p, 'PC-' || n || '_Chip.jpg' f, 'PC-' || (1 + p % 97) c, 'label_chip' as role, true own from pp union all select p, 'Vase.jpg', null, 'in_use', false from pp where p % 2 = 0),
 co as (select p, case when bare then p_name || ' & co' else upper(pre) || '-' || (1 + p % 97) end code from pp),
 b as (select p_partkey, k, ['opacity', 'ap_seal', 'ap_seal', 'food_safe', 'prop65'][1 + i] badge, ['opaque', 'true', 'false', 'false', 'true'][1 + i] as v from ic where i < 5)
 select 'product' kind, p url, code detail from co
 union all select 'image', im.p, f || '|' || role || '|' || coalesce(c, co.code) || '|' || case when own then 'high' else 'low' end from im join co on co.p = im.p
 union all select 'badge', p_partkey, badge || '=' || arg_max(v, k) from b group by p_partkey, badge
 union all select 'unknown', p_partkey, 'new-icon.png' from ic where i = 5""")
def replay_pages(c: Catalog) -> DataFrame:
    return _rows_of(replay_of.replay_pages(c.product_pages.withColumnRenamed("p_partkey", "url")))
