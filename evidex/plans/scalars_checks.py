"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.evidence_map import fact, has_fact, with_fact
from evidex.functions import codes, labels, urls
from evidex.functions.color import hex_of, with_delta_e, with_lab
from evidex.functions.hashing import content_hash
from evidex.functions.text import array_text, clean_text
from evidex.operators.evidence import sections
from evidex.plans import sqltext as Q
from evidex.plans.registry import check
from evidex.plans.views import Catalog
from evidex.plans.windows_checks import NOISE


@check("clean_text", """select page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))) digest from pages""")
def clean_text_check(c: Catalog) -> DataFrame:
    return c.table("pages").select("page_id", F.sha2(clean_text(F.col("html")), 256).alias("digest"))


@check("stem", """select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '\\.[^./]*$', ''), '__[0-9]+\\.[0-9]+$', ''), '-[0-9]{2,4}x[0-9]{2,4}$', ''), '-scaled$', '') stem
 from (select page_id, case page_id % 3 when 0 then 'Pic-' || page_id || '-300x300.JPG' when 1 then 'pic' || page_id || '-scaled.png' else 'PIC_' || page_id || '__54961.1659532780.jpg' end name from pages)""")
def stem(c: Catalog) -> DataFrame:
    named = c.table("pages").selectExpr("page_id", """case page_id % 3 when 0 then concat('Pic-', page_id, '-300x300.JPG')
        when 1 then concat('pic', page_id, '-scaled.png') else concat('PIC_', page_id, '__54961.1659532780.jpg') end as name""")
    return named.select("page_id", urls.stem_of(F.col("name")).alias("stem"))


@check("url_identity", """with u as (select page_id, url, case page_id % 3 when 0 then 'https://shop.example.com/product/item-' || page_id || '/' when 1 then 'https://api.example.com/v1/products?slug=item-' || page_id || '&x=1' else 'item-' || page_id end item_url from pages)
 select page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') ref,
 regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) tail, 'item-' || page_id slug from u""")
def url_identity(c: Catalog) -> DataFrame:
    u = c.table("pages").selectExpr("page_id", "url", """case page_id % 3 when 0 then concat('https://shop.example.com/product/item-', page_id, '/')
        when 1 then concat('https://api.example.com/v1/products?slug=item-', page_id, '&x=1') else concat('item-', page_id) end as item_url""")
    slug = urls.slug_of(F.col("item_url"))
    return u.select("page_id", urls.url_host(F.col("url")).alias("host"), urls.url_path(F.col("url")).alias("path"),
                    urls.query_value(F.col("url"), "ref").alias("ref"), urls.basename(F.col("url")).alias("tail"), urls.slug_of(slug).alias("slug"))


@check("normalize_code", """select p_partkey, 'SW-' || lpad(cast(p_partkey % 1000 as varchar), 3, '0') kept, 'PC-' || (p_partkey % 1000) stripped, 'SW-' || p_partkey sku from part""")
def normalize_code(c: Catalog) -> DataFrame:
    p = c.table("part").selectExpr("p_partkey", "lpad(p_partkey % 1000, 3, '0') as d", "concat(case when p_partkey % 2 = 0 then ' sw-' else 'SW' end, p_partkey, case when p_partkey % 3 = 0 then '-15649' else '' end) as sku")
    name = F.concat(F.lit(" pc_"), "d", F.lit(" Charcoal"))
    return p.select("p_partkey", codes.zero_kept(F.lit("sw"), F.col("d")).alias("kept"), codes.name_code(name).alias("stripped"), codes.sku_code(F.col("sku")).alias("sku"))


@check("canonical_hash", "select url, id, sha256(regexp_replace(body, '<!-- sid:[0-9]+ -->', '', 'g')) hash from snapshots", "snapshots")
def canonical_hash(c: Catalog) -> DataFrame:
    return c.snapshots.select("url", "id", content_hash(F.col("body"), NOISE).alias("hash"))


@check("srgb_to_lab", """with c as (select vec_id, i, [case when x / 255.0 <= 0.04045 then x / 255.0 / 12.92 else pow((x / 255.0 + 0.055) / 1.055, 2.4) end for x in [r, g, b]] l from pixels),
 x as (select vec_id, i, (0.4124*l[1] + 0.3576*l[2] + 0.1805*l[3]) / (0.3127/0.3290) x, 0.2126*l[1] + 0.7152*l[2] + 0.0722*l[3] y, (0.0193*l[1] + 0.1192*l[2] + 0.9505*l[3]) / ((1-0.3127-0.3290)/0.3290) z from c),
 f as (select vec_id, i, [case when t > 216.0/24389 then cbrt(t) else (24389.0/27*t + 16) / 116 end for t in [x, y, z]] f from x)
 select vec_id, i, round(116*f[2] - 16, 4) lab_l, round(500*(f[1]-f[2]), 4) lab_a, round(200*(f[2]-f[3]), 4) lab_b from f""", "pixels")
def srgb_to_lab(c: Catalog) -> DataFrame:
    lab = with_lab(c.pixels, "r", "g", "b")
    return lab.select("vec_id", "i", *[(F.round(n, 4) + 0.0).alias(n) for n in ("lab_l", "lab_a", "lab_b")])


@check("delta_e", f"with {Q.delta_e_ctes('readings', 'vec_id')} select vec_id, round(de, 5) delta_e from de", "readings")
def delta_e(c: Catalog) -> DataFrame:
    return with_delta_e(c.readings, ("l1", "a1", "b1"), ("l2", "a2", "b2")).select("vec_id", F.round("delta_e", 5).alias("delta_e"))


@check("to_hex", "select vec_id, i, printf('#%02x%02x%02x', cast(round_even(greatest(0, least(255, r * 1.5)), 0) as integer), cast(round_even(g / 2, 0) as integer), cast(round_even(greatest(0, b - 10.5), 0) as integer)) hex from pixels", "pixels")
def to_hex(c: Catalog) -> DataFrame:
    return c.pixels.select("vec_id", "i", hex_of(F.col("r") * 1.5, F.col("g") / 2, F.col("b") - 10.5).alias("hex"))


@check("array_to_text", "select item_id, array_to_string(terms, ' ') words from items", "items")
def array_to_text(c: Catalog) -> DataFrame:
    return c.items.select("item_id", array_text(F.col("terms")).alias("words"))


@check("evidence_map", """select event_id, cast(json_extract_string(props, '$.k') as bigint) k, event_type kind, json_extract_string(props, '$.k') = '1' is_one, 2 n_keys from events""")
def evidence_map(c: Catalog) -> DataFrame:
    given = F.from_json("props", "map<string,string>")
    merged = with_fact(with_fact(given, "kind", F.lit("?")), "kind", F.col("event_type"))
    m = F.col("m")
    return c.events.select("event_id", merged.alias("m")).select(
        "event_id", fact(m, "k").cast("bigint").alias("k"), fact(m, "kind").alias("kind"), has_fact(m, "k", "1").alias("is_one"), F.size("m").alias("n_keys"))


@check("display_labels", """select i.item_id, case when lo is null and hi is null then 'Cone not stated' when lo is not null and hi is not null and lo <> hi then 'Cone ' || lo || '–' || hi else 'Cone ' || coalesce(lo, hi) end range_text,
 printf('From $%.2f', cast(price as decimal(18,2))) price_text, case when length(line) <= 6 then line || ' · ' || name else name end line_text, 'Photograph © ' || m.maker_key credit, name as bare
 from items i join makers m on m.maker_id = i.maker_id""", "items makers")
def display_labels(c: Catalog) -> DataFrame:
    text = c.items.join(c.makers, "maker_id").withColumn("titled", F.concat_ws(" - ", F.upper("code"), "name"))
    return text.select(
        "item_id", labels.range_label(F.col("lo").cast("string"), F.col("hi").cast("string")).alias("range_text"), labels.price_label(F.col("price")).alias("price_text"),
        labels.line_label(F.col("line"), F.col("name")).alias("line_text"), labels.credit_label(F.col("maker_key")).alias("credit"), labels.bare_name(F.col("code"), F.col("titled")).alias("bare"))


@check("relative_time", """with a as (select o_orderkey, epoch_ms(o_orderdate) ms, (select epoch_ms(max(o_orderdate)) from orders) + 43200000 + 60000 as_of from orders)
 select o_orderkey, case when as_of - ms < 60000 then 'Just now' when as_of - ms < 3600000 then ((as_of - ms) // 60000) || 'm ago' when as_of - ms < 86400000 then ((as_of - ms) // 3600000) || 'h ago'
 when as_of - ms < 172800000 then 'Yesterday' when as_of - ms < 604800000 then ((as_of - ms) // 86400000) || 'd ago'
 when year(make_timestamp(ms * 1000)) = year(make_timestamp(as_of * 1000)) then strftime(make_timestamp(ms * 1000), '%b %-d') else strftime(make_timestamp(ms * 1000), '%b %-d, %Y') end age,
 strftime(make_timestamp(ms * 1000), '%B %-d, %Y · %-I:%M %p') full_text from a""")
def relative_time(c: Catalog) -> DataFrame:
    orders = c.table("orders").select("o_orderkey", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))
    newest = orders.agg((F.max("ms") + 43_200_000 + 60_000).alias("v")).first().v
    return orders.select("o_orderkey", labels.relative_time(F.col("ms"), F.lit(newest)).alias("age"), labels.full_time(F.col("ms")).alias("full_text"))


@check("lenient_ts", """select event_id, case event_id % 4 when 3 then null else epoch(date_trunc('second', ts))::bigint - case when event_id % 4 = 1 then 7200 else 0 end end sec,
 strftime(date_trunc('second', ts), '%a, %d %b %Y %H:%M:%S GMT') http from events""")
def lenient_ts(c: Catalog) -> DataFrame:
    written = c.events.selectExpr("event_id", "ts", """case event_id % 4 when 0 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") when 1 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'")
        when 2 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') else date_format(ts, "EEEE yyyy") end as text""")
    return written.select("event_id", F.unix_seconds(labels.lenient_timestamp(F.col("text"))).alias("sec"), labels.http_date(F.col("ts")).alias("http"))


@check("section_rows", """with f as (select item_id, bool_or(coat is not null) has_coat, min(ev_id) filter (role = 'coats_composite') first from ev group by item_id),
 r as (select e.*, f.has_coat, f.first from ev e join f on f.item_id = e.item_id),
 s as (select item_id, 'coats' section from r where coat is not null union all select item_id, 'unsplit' from r where not has_coat and role = 'coats_composite' and ev_id = first
  union all select item_id, 'on_clay' from r where clay is not null union all select item_id, 'layered' from r where layered_over is not null
  union all select item_id, 'plain' from r where coat is null and clay is null and layered_over is null and role <> 'line_chart' and not (not has_coat and role = 'coats_composite'))
 select item_id, section, count(*) n from s group by all""".replace("with f as", "with ev as (select * replace (case when item_id % 5 = 0 then null else coat end as coat) from evidence), f as"), "evidence")
def section_rows(c: Catalog) -> DataFrame:
    some = c.evidence.withColumn("coat", F.when(F.col("item_id") % 5 != 0, F.col("coat")))
    return sections(some).groupBy("item_id", "section").agg(F.count(F.lit(1)).alias("n"))
