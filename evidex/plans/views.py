"""Catalog-shaped views over the test tables, in Spark and as an SQL prelude for the oracles.

The two halves state the same formulas twice on purpose: a check compares a Spark plan with an SQL
query, and both must start from equal inputs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex import vocabulary as V
from evidex.session import spread
from evidex.sources.tables import read_table


class Catalog:
    """The given tables and the views derived from them; nothing is read before it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def makers(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").alias("maker_id"), F.lower("r_name").alias("maker_key"))

    @cached_property
    def items(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey as item_id",
            "cast(p_partkey % 4 as int) as maker_id",
            "concat('PC-', p_partkey div 4) as code",
            "p_name as name",
            "p_type as line",
            "split(p_name, ' ') as terms",
            "concat(p_type, ' ', p_brand) as description",
            "nullif(p_size % 4, 0) as surface",
            "nullif(p_size % 5, 0) as opacity",
            "case when p_partkey % 10 <> 0 then 1 + p_size % 30 end as lo",
            "case when p_partkey % 11 <> 0 then 1 + p_size % 30 + cast(p_partkey % 7 as int) end as hi",
            "case p_partkey % 3 when 0 then true when 1 then false end as flag",
            "p_retailprice as price")

    @cached_property
    def evidence(self) -> DataFrame:
        role = """case when l_returnflag = 'R' then 'label_chip'
                       when l_returnflag = 'A' then 'coats_composite'
                       when l_linestatus = 'O' then 'layered' else 'other' end"""
        return self.table("lineitem").selectExpr(
            "concat_ws('-', lpad(l_orderkey, 12, '0'), l_linenumber, lpad(l_partkey, 11, '0'),"
            " lpad(l_suppkey, 10, '0')) as ev_id",
            "l_partkey as item_id",
            f"{role} as role",
            "nullif(l_linenumber % 5, 0) as coat",
            "case when l_quantity < 10 then l_suppkey end as clay",
            "case when l_linenumber <> 3 then concat('#', lower(lpad(hex(l_partkey), 6, '0'))) end as hex",
            f"case when {role} = 'layered' then concat('PC-', l_suppkey) end as base_code",
            f"case when {role} = 'layered' and l_suppkey * 4 + l_partkey % 4 <> l_partkey"
            " then l_suppkey * 4 + l_partkey % 4 end as layered_over",
            "concat('img/', l_orderkey, '/', l_linenumber, '.jpg') as source_url",
            "concat('p/', l_suppkey % 256, '/', l_orderkey) as storage_path",
            "l_orderkey as source_key")

    @cached_property
    def clay_vocab(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey as clay", "s_name as clay_name", "cast(s_suppkey % 4 as int) as maker_id")

    @cached_property
    def line_vocab(self) -> DataFrame:
        return self.items.groupBy("line").agg(
            F.min("lo").alias("line_lo"), F.max("hi").alias("line_hi"),
            F.min("item_id").alias("line_id"))

    @cached_property
    def searches(self) -> DataFrame:
        """One saved search per supplier: text of eight shapes, and a mix of filters."""
        part = self.table("part").select("p_partkey", "p_name", "p_type")
        sup = self.table("supplier").select("s_suppkey")
        w1, w2 = "split(p_name, ' ')[0]", "split(p_name, ' ')[1]"
        return sup.join(part, sup.s_suppkey == part.p_partkey).selectExpr(
            "s_suppkey as qid",
            f"""case s_suppkey % 8
                when 0 then ' '
                when 1 then p_name
                when 2 then concat('"', p_name, '"')
                when 3 then concat({w1}, ' -', {w2})
                when 4 then concat(substr({w2}, 1, 2), substr({w2}, 4))
                when 5 then concat({w1}, ' or ', {w2})
                when 6 then concat('pc-', s_suppkey)
                else concat({w2}, ' ', lower(p_type)) end as text""",
            "case when s_suppkey % 3 = 0 then array(0, 1) end as makers",
            "case when s_suppkey % 9 = 1 then array('SMALL', 'LARGE') end as lines",
            "case when s_suppkey % 7 = 0 then array(1, 2) end as surfaces",
            "cast(null as array<int>) as opacities",
            "case when s_suppkey % 5 = 0 then 10 end as lo",
            "case when s_suppkey % 5 = 0 then 20 end as hi",
            "case when s_suppkey % 11 = 0 then true end as flag",
            "case when s_suppkey % 13 = 0 then array(s_suppkey, s_suppkey + 1) end as clays",
            "cast(null as array<string>) as codes",
            "cast(null as array<string>) as code_makers",
            "cast(5 + s_suppkey % 3 as int) as page_limit",
            "cast((s_suppkey % 4) * 2 as int) as page_offset")

    @cached_property
    def edge_searches(self) -> DataFrame:
        """Searches at the edges, one per supplier: null text, exclusions alone, a quoted ``or``, identity lists (short, empty), every filter."""
        part = self.table("part").select("p_partkey", "p_name", "p_type")
        sup = self.table("supplier").select("s_suppkey", "s_nationkey")
        w1, w2 = "split(p_name, ' ')[0]", "split(p_name, ' ')[1]"
        return sup.join(part, sup.s_suppkey == part.p_partkey).selectExpr(
            "s_suppkey as qid",
            f"""case s_suppkey % 10 when 0 then null when 1 then concat('-', {w1}) when 2 then concat('"', {w1}, ' or ', {w2}, '"')
                when 3 then concat({w1}, ' or -', {w2}) when 4 then concat(' ', {w2}, ' ', {w1}) when 5 then concat('-', {w1}, ' -', lower(p_type))
                when 6 then '' when 7 then {w1} when 8 then concat('"', {w1}, ' ', {w2}, '" ', lower(p_type)) else concat({w2}, ' of pc') end as text""",
            "case when s_suppkey % 4 = 1 then array(1, 3) end as makers",
            "case when s_suppkey % 9 = 2 then array('SMALL', 'LARGE') end as lines",
            "case when s_suppkey % 7 = 3 then array(1, 2) end as surfaces",
            "case when s_suppkey % 3 = 1 then array(1, 2, 4) end as opacities",
            "case when s_suppkey % 5 = 2 then 8 end as lo",
            "case when s_suppkey % 5 in (2, 3) then 22 end as hi",
            "case when s_suppkey % 11 = 5 then false end as flag",
            "case when s_suppkey % 13 = 4 then array(s_suppkey, s_suppkey + 1) end as clays",
            "case when s_suppkey % 10 in (6, 7) then case when s_suppkey % 30 = 7 then cast(array() as array<string>) else"
            " array(concat(' pc-', s_suppkey), concat('PC-', s_suppkey + 1), 'pc-3') end end as codes",
            "case when s_suppkey % 10 in (6, 7) then case when s_suppkey % 20 = 6 then array('asia', 'EUROPE ') else array('america', 'asia', 'nobody') end end as code_makers",
            "cast(4 + s_suppkey % 5 as int) as page_limit",
            "cast(case when s_suppkey % 6 = 5 then -3 else (s_suppkey % 3) * 3 end as int) as page_offset")

    @cached_property
    def doc_searches(self) -> DataFrame:
        """Searches over documents: words of the benchmark passages as AND, phrase and negation."""
        words = "filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> '')"
        return self.table("benchmark").selectExpr("item_id", f"{words} as w").selectExpr(
            "item_id as qid",
            """case item_id % 4 when 0 then concat(w[0], ' ', w[1]) when 1 then concat('"', w[0], ' ', w[1], ' ', w[2], '"')
               when 2 then concat(w[0], ' -', w[1]) else concat(w[0], ' ', w[1], ' ', w[2]) end as text""")

    @cached_property
    def passage_searches(self) -> DataFrame:
        """Every whole benchmark passage as AND (form 0), phrase (1), its first word without the passage (2) and without its other words (3)."""
        words = "filter(split(lower(text), '[^\\\\p{L}\\\\p{N}]+'), w -> w <> '')"
        return self.table("benchmark").selectExpr("item_id", f"{words} as w", "explode(array(0, 1, 2, 3)) as form").selectExpr(
            "item_id * 4 + form as qid",
            """case form when 0 then array_join(filter(w, x -> x <> 'or'), ' ') when 1 then concat('"', array_join(w, ' '), '"')
               when 2 then concat(w[0], ' -"', array_join(w, ' '), '"')
               else concat(w[0], ' ', array_join(transform(filter(w, x -> x <> w[0]), x -> concat('-', x)), ' ')) end as text""")

    @cached_property
    def snapshots(self) -> DataFrame:
        """Four fetches of every page: volatile noise on each, real edits on some, one withdrawal."""
        return (
            self.table("pages")
            .selectExpr("*", "explode(array(0, 1, 2, 3)) as n")
            .selectExpr(
                "concat(url, '#', page_id) as url",
                "page_id * 4 + n as id",
                "cast(page_id % 4 as int) as maker_id",
                "1704067200 + n * 86400 + page_id as fetched_s",
                "case when page_id % 17 = 0 and n = 3 then 404 when page_id % 19 = 0 and n = 2 then 304"
                " when page_id % 23 = 0 and n = 1 then 503 else 200 end as status",
                "concat(html, '<!-- sid:', n, ' -->',"
                " case when page_id % 3 = 0 and n >= 2 then ' v2' else '' end) as body"))

    @cached_property
    def filenames(self) -> DataFrame:
        d1, d2 = "(100 + p_partkey % 900)", "(100 + (p_partkey * 7 + 3) % 900)"
        return self.table("part").selectExpr(
            "p_partkey as image_id",
            f"""concat(
                case p_partkey % 4
                  when 0 then concat('sw', {d1}, '_over_sw', {d2})
                  when 1 then concat('sw', {d1}, '_under_sw', {d2})
                  when 2 then concat('SW-', {d1})
                  else concat('sw', {d1}, '_over_sw', {d2}, '_sw', {d2} + 1) end,
                case p_size % 3 when 0 then concat('_cone', 1 + p_size % 14) when 1 then '_cone06' else '' end,
                case when p_partkey % 5 = 0 then '_1234coats' else '' end,
                case p_partkey % 6 when 0 then '_bowl' when 1 then '_tile' else '' end,
                case when p_partkey % 7 = 0 then '_final' else '' end,
                case when p_partkey % 9 = 0 then '_glossy' else '' end,
                case when p_partkey % 23 = 0 then '_lineup' else '' end,
                case when p_partkey % 8 = 0 then '-scaled' else '' end, '.jpg') as filename""",
            f"concat('SW-', case when p_partkey % 10 = 0 then {d2} else {d1} end) as product_code",
            "case when p_partkey % 3 = 0 then 'White Clay, cone 5 oxidation' end as alt")

    @cached_property
    def readings(self) -> DataFrame:
        e = [f"cast(embedding[{i}] as double)" for i in range(6)]
        return self.table("embeddings").selectExpr(
            "vec_id", "label as owner",
            f"50 + 100 * {e[0]} as l1", f"100 * {e[1]} as a1", f"100 * {e[2]} as b1",
            f"50 + 100 * {e[3]} as l2", f"100 * {e[4]} as a2", f"100 * {e[5]} as b2")

    @cached_property
    def all_readings(self) -> DataFrame:
        """Every number of a vector in one of 22 readings of three; the last goes on at the front."""
        return (self.table("embeddings").selectExpr("vec_id", "embedding as e", "explode(sequence(0, 21)) as k")
                .selectExpr("vec_id * 22 + k as reading_id", "vec_id", "50 + 100 * cast(e[(3 * k) % 64] as double) as l1", "100 * cast(e[(3 * k + 1) % 64] as double) as a1",
                            "100 * cast(e[(3 * k + 2) % 64] as double) as b1"))

    @cached_property
    def all_pixels(self) -> DataFrame:
        """Every number of a vector as a channel of one of 22 pixels."""
        def channel(k: int) -> str:
            return f"least(255, cast(floor(512 * abs(cast(embedding[(3 * i + {k}) % 64] as double))) as int))"

        return (self.table("embeddings").selectExpr("vec_id", "embedding", "explode(sequence(0, 21)) as i")
                .selectExpr("vec_id", "i", f"{channel(0)} as r", f"{channel(1)} as g", f"{channel(2)} as b"))

    @cached_property
    def pixels(self) -> DataFrame:
        def channel(k: int) -> str:
            return f"least(255, cast(floor(512 * abs(cast(embedding[3 * i + {k}] as double))) as int))"

        return (
            self.table("embeddings")
            .selectExpr("vec_id", "embedding", "explode(sequence(0, 20)) as i")
            .selectExpr("vec_id", "i", f"{channel(0)} as r", f"{channel(1)} as g", f"{channel(2)} as b"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").selectExpr("*", "unix_micros(cast(ts as timestamp)) as us")

    @cached_property
    def marks_log(self) -> DataFrame:
        return self.events.selectExpr(
            "user_id as key", "us", "event_id",
            "case event_type when 'view' then 'own' when 'purchase' then 'wish' when 'click' then 'toggle'"
            " when 'signup' then 'note' else 'clear' end as action",
            "case when event_type = 'signup' then case when event_id % 10 = 0 then '  ' else props end end as note")

    @cached_property
    def stage_log(self) -> DataFrame:
        return self.events.selectExpr(
            "user_id as piece", "us", "event_id",
            "case event_type when 'view' then 'throwing' when 'purchase' then 'firing'"
            " when 'click' then 'bisque' when 'signup' then 'note' else"
            " case when value > 60 then 'finished' else 'greenware' end end as stage",
            "case when event_id % 3 = 0 then concat('photo-', event_id) end as photo")

    @cached_property
    def product_pages(self) -> DataFrame:
        """Product pages of the first source: JSON-LD with odd blocks beside it, a gallery beside other links, property icons."""
        n = "lpad(1 + p_partkey % 97, 2, '0')"
        name = f"concat(case when p_partkey % 13 = 0 then '' else concat(array('PC', 'SM', 'pcf', 'C')[p_partkey % 4], '-', {n}, ' ') end, p_name, ' &amp; co')"
        offer = """named_struct('lowPrice', case when p_partkey % 3 = 0 then cast(p_retailprice as string) end, 'highPrice', case when p_partkey % 3 = 0 then cast(p_retailprice * 2 as string) end,
            'price', case when p_partkey % 3 = 1 then cast(p_retailprice as string) end, 'availability', case when p_partkey % 2 = 0 then 'https://schema.org/InStock' end)"""
        crumbs = "transform(slice(array('Home', 'Glazes', 'Mid &amp; High', p_type, p_name), 1, if(p_partkey % 8 = 1, 3, 5)), x -> named_struct('item', named_struct('name', x)))"
        icon = "array('opaque-icon-web.png', 'ap-logo.png', 'cl-logo.png', 'no-words-notfoodsafe-web-icon.png', 'p65-icon-web-2.png', 'new-icon.png')"
        return spread(self.table("part"), "p_partkey").selectExpr("p_partkey", f"""concat('<html><head><title>', {name}, ' | Shop</title>',
            case when p_partkey % 11 = 0 then '<script type="application/ld+json">{{"@type": </script>' else '' end,
            case when p_partkey % 7 = 0 then '' else concat('<script type="application/ld+json">', case when p_partkey % 5 = 0
                then to_json(array(named_struct('@type', 'Product', 'name', {name}, 'description', concat('Fires  at 1222&deg;C. ', p_brand), 'offers', array({offer}))))
                else to_json(named_struct('@type', 'Product', 'name', {name}, 'description', concat('Fires  at 1222&deg;C. ', p_brand), 'offers', {offer})) end, '</script>') end,
            '<script type="application/ld+json">', to_json(named_struct('@type', 'BreadcrumbList', 'itemListElement', {crumbs})), '</script></head><body>',
            '<section data-image-gallery><a href="https://cdn.example.com/i/PC-', {n}, '_Chip__1234.567.jpg" data-fancybox="image-gallery"></a>',
            case when p_partkey % 2 = 0 then '<a data-fancybox="image-gallery" href="https://cdn.example.com/i/Vase.jpg?x=1"></a>' else '' end,
            '<a href="/zoom.jpg">zoom</a></section><section><a href="https://cdn.example.com/i/other.jpg" data-fancybox="image-gallery"></a></section>',
            array_join(transform(sequence(0, cast(p_partkey % 4 as int)), k -> concat('<img src="/content/image-manager/', {icon}[cast((p_partkey + k) % 6 as int)], '?v=1">')), ''), '</body></html>') as body""")

    @cached_property
    def full_evidence(self) -> DataFrame:
        """Evidence with everything a detail page shows."""
        return self.evidence.selectExpr(
            "*", "cast(nullif(source_key % 37, 0) as int) as cone_no", "case source_key % 4 when 1 then 'flat_tile' when 2 then 'cup' when 3 then 'bowl' end as form",
            "case when coat = 2 then hex end as hex2", "element_at(array('high', 'medium', 'low'), cast(1 + source_key % 3 as int)) as confidence",
            "case when role = 'label_chip' then 'Photograph © the maker' end as credit",
            "case when role = 'coats_composite' then named_struct('left', cast(source_key % 50 as int), 'top', 0, 'right', cast(source_key % 50 + 100 as int), 'bottom', 90) end as crop_box",
            "cast(200 + source_key % 900 as int) as image_width", "cast(100 + source_key % 700 as int) as image_height")

    @cached_property
    def clay_families(self) -> DataFrame:
        return self.clay_vocab.selectExpr("clay", "clay_name", "element_at(array('white', 'buff', 'brown'), cast(1 + clay % 3 as int)) as clay_family")

    @cached_property
    def json_products(self) -> DataFrame:
        """Product payloads: a one-element JSON array per item, every 29th payload broken."""
        return self.table("part").selectExpr(
            "p_partkey",
            """case when p_partkey % 29 = 0 then '[{"sku": ' else to_json(array(named_struct(
                'sku', case p_partkey % 3 when 0 then concat('SW', p_partkey)
                       when 1 then concat('sw-', p_partkey, '-15649') else concat('NT', substr('ABCDE', 1 + cast(p_partkey % 5 as int), 1)) end,
                'name', concat(' ', p_name, ' &amp; co&#174;'),
                'permalink', concat('https://shop.example.com/product/', replace(p_name, ' ', '-'), '-', p_partkey, '/'),
                'short_description', concat('<p><strong>', p_type, ':</strong> ', p_brand, '</p>'),
                'is_in_stock', p_partkey % 2 = 0,
                'prices', named_struct(
                    'price', case when p_partkey % 6 = 0 then '0' else cast(cast(round(p_retailprice * 100) as bigint) as string) end,
                    'currency_minor_unit', case when p_partkey % 31 = 0 then null else 2 end,
                    'price_range', case when p_partkey % 4 = 0 then named_struct(
                        'min_amount', cast(cast(round(p_retailprice * 100) as bigint) as string),
                        'max_amount', cast(cast(round(p_retailprice * 200) as bigint) as string)) end),
                'categories', case p_partkey % 5
                    when 0 then array(named_struct('slug', 'flux', 'name', 'Flux', 'link', 'https://shop.example.com/product-category/color/fired/flux/'))
                    when 1 then array(named_struct('slug', 'bead', 'name', 'Bead', 'link', 'https://shop.example.com/product-category/color/fired/ritual/bead/'))
                    when 2 then array(named_struct('slug', 'tools', 'name', 'Tools', 'link', 'https://shop.example.com/product-category/tools/'))
                    when 3 then array(named_struct('slug', 'product-kits', 'name', 'Kits', 'link', 'https://shop.example.com/product-category/color/fired/kits/'),
                                      named_struct('slug', 'raku', 'name', 'Raku', 'link', 'https://shop.example.com/product-category/color/fired/raku/'))
                    else array(named_struct('slug', 'fired', 'name', 'Fired', 'link', 'https://shop.example.com/product-category/color/fired/'),
                               named_struct('slug', 'raku', 'name', 'Raku &amp; Pit', 'link', 'https://shop.example.com/product-category/color/fired/raku/')) end,
                'images', array(
                    named_struct('src', concat('https://cdn.example.com/up/sw', p_partkey, '_cone6-300x300.jpg?v=', p_size), 'alt', '', 'name', 'one'),
                    named_struct('src', case when p_partkey % 7 = 0 then 'https://cdn.example.com/Image-Coming-Soon.jpg'
                        else concat('https://cdn.example.com/up/line-', p_type, '.jpg') end, 'alt', 'Two', 'name', '')),
                'attributes', array(
                    named_struct('name', 'Food Safe', 'terms', case p_partkey % 4
                        when 0 then array(named_struct('name', 'https://cdn.example.com/i/ap-acmi.png'))
                        when 1 then array(named_struct('name', 'CL ACMI'), named_struct('name', 'AP ACMI'))
                        when 2 then array(named_struct('name', '<img src="https://cdn.example.com/i/food-safe.png">'))
                        else array(named_struct('name', 'Non-Toxic'), named_struct('name', 'Who Knows')) end),
                    named_struct('name', 'Country Of Origin', 'terms', array(named_struct('name', 'US'))),
                    named_struct('name', 'Dinnerware Safe', 'terms', case when p_partkey % 2 = 0
                        then array(named_struct('name', 'Dinnerware Safe')) else array(named_struct('name', 'Not Dinnerware Safe')) end))
            ))) end as body""")


_ROLE = """case when l_returnflag = 'R' then 'label_chip' when l_returnflag = 'A' then 'coats_composite'
 when l_linestatus = 'O' then 'layered' else 'other' end"""

#: name -> (views it reads, SQL)
VIEW_SQL: dict[str, tuple[str, str]] = {
    "makers": ("", "select r_regionkey maker_id, lower(r_name) maker_key from region"),
    "items": ("", """select p_partkey item_id, cast(p_partkey % 4 as integer) maker_id, 'PC-' || (p_partkey // 4) code,
 p_name as name, p_type line, string_split(p_name, ' ') terms, p_type || ' ' || p_brand description,
 nullif(p_size % 4, 0) surface, nullif(p_size % 5, 0) opacity,
 case when p_partkey % 10 <> 0 then 1 + p_size % 30 end lo,
 cast(case when p_partkey % 11 <> 0 then 1 + p_size % 30 + p_partkey % 7 end as integer) hi,
 case p_partkey % 3 when 0 then true when 1 then false end flag, p_retailprice price from part"""),
    "evidence": ("", f"""select lpad(cast(l_orderkey as varchar), 12, '0') || '-' || l_linenumber || '-' ||
 lpad(cast(l_partkey as varchar), 11, '0') || '-' || lpad(cast(l_suppkey as varchar), 10, '0') ev_id,
 l_partkey item_id, {_ROLE} as role, nullif(l_linenumber % 5, 0) coat,
 case when l_quantity < 10 then l_suppkey end clay,
 case when l_linenumber <> 3 then printf('#%06x', l_partkey) end hex,
 case when {_ROLE} = 'layered' then 'PC-' || l_suppkey end base_code,
 case when {_ROLE} = 'layered' and l_suppkey * 4 + l_partkey % 4 <> l_partkey then l_suppkey * 4 + l_partkey % 4 end layered_over,
 'img/' || l_orderkey || '/' || l_linenumber || '.jpg' source_url,
 'p/' || (l_suppkey % 256) || '/' || l_orderkey storage_path, l_orderkey source_key from lineitem"""),
    "clay_vocab": ("", "select s_suppkey clay, s_name clay_name, cast(s_suppkey % 4 as integer) maker_id from supplier"),
    "line_vocab": ("items", "select line, min(lo) line_lo, max(hi) line_hi, min(item_id) line_id from items group by line"),
    "surfaces": ("", f"select * from {V.sql_values(V.SURFACES)} t(surface, surface_key, surface_name)"),
    "opacities": ("", f"select * from {V.sql_values(V.OPACITIES)} t(opacity, opacity_key, opacity_name)"),
    "coats": ("", f"select * from {V.sql_values(V.COATS)} t(coat, coat_key, coat_name)"),
    "cones": ("", f"select * from {V.sql_values(list(enumerate(V.CONE_NAMES, start=1)))} t(ordinal, cone)"),
    "color_terms": ("", "select * from " + V.sql_values([(i, *r) for i, r in enumerate(V.COLOR_TERMS, start=1)])
                    + " t(ord, term, l, a, b, radius, specialised, family)"),
    "searches": ("", """select s_suppkey qid, case s_suppkey % 8 when 0 then ' ' when 1 then p_name when 2 then '"' || p_name || '"'
 when 3 then w[1] || ' -' || w[2] when 4 then substr(w[2], 1, 2) || substr(w[2], 4) when 5 then w[1] || ' or ' || w[2]
 when 6 then 'pc-' || s_suppkey else w[2] || ' ' || lower(p_type) end as text,
 case when s_suppkey % 3 = 0 then [0, 1] end makers, case when s_suppkey % 9 = 1 then ['SMALL', 'LARGE'] end lines,
 case when s_suppkey % 7 = 0 then [1, 2] end surfaces, cast(null as integer[]) opacities,
 case when s_suppkey % 5 = 0 then 10 end lo, case when s_suppkey % 5 = 0 then 20 end hi,
 case when s_suppkey % 11 = 0 then true end flag,
 case when s_suppkey % 13 = 0 then [s_suppkey, s_suppkey + 1] end clays,
 cast(5 + s_suppkey % 3 as integer) page_limit, cast((s_suppkey % 4) * 2 as integer) page_offset
 from supplier join (select *, string_split(p_name, ' ') w from part) on s_suppkey = p_partkey"""),
    "edge_searches": ("", """select s_suppkey qid, case s_suppkey % 10 when 0 then null when 1 then '-' || w[1] when 2 then '"' || w[1] || ' or ' || w[2] || '"'
 when 3 then w[1] || ' or -' || w[2] when 4 then ' ' || w[2] || ' ' || w[1] when 5 then '-' || w[1] || ' -' || lower(p_type)
 when 6 then '' when 7 then w[1] when 8 then '"' || w[1] || ' ' || w[2] || '" ' || lower(p_type) else w[2] || ' of pc' end as text,
 case when s_suppkey % 4 = 1 then [1, 3] end makers, case when s_suppkey % 9 = 2 then ['SMALL', 'LARGE'] end lines,
 case when s_suppkey % 7 = 3 then [1, 2] end surfaces, case when s_suppkey % 3 = 1 then [1, 2, 4] end opacities,
 case when s_suppkey % 5 = 2 then 8 end lo, case when s_suppkey % 5 in (2, 3) then 22 end hi, case when s_suppkey % 11 = 5 then false end flag,
 case when s_suppkey % 13 = 4 then [s_suppkey, s_suppkey + 1] end clays,
 case when s_suppkey % 10 in (6, 7) then case when s_suppkey % 30 = 7 then [] else [' pc-' || s_suppkey, 'PC-' || (s_suppkey + 1), 'pc-3'] end end codes,
 case when s_suppkey % 10 in (6, 7) then case when s_suppkey % 20 = 6 then ['asia', 'EUROPE '] else ['america', 'asia', 'nobody'] end end code_makers,
 cast(4 + s_suppkey % 5 as integer) page_limit, case when s_suppkey % 6 = 5 then 0 else cast((s_suppkey % 3) * 3 as integer) end page_offset
 from supplier join (select *, string_split(p_name, ' ') w from part) on s_suppkey = p_partkey"""),
    "doc_searches": ("", """select item_id qid, case item_id % 4 when 0 then w[1] || ' ' || w[2]
 when 1 then '"' || w[1] || ' ' || w[2] || ' ' || w[3] || '"' when 2 then w[1] || ' -' || w[2]
 else w[1] || ' ' || w[2] || ' ' || w[3] end as text
 from (select item_id, [x for x in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') if x <> ''] w from benchmark)"""),
    "passage_searches": ("", """select item_id * 4 + form qid, case form when 0 then array_to_string([x for x in w if x <> 'or'], ' ')
 when 1 then '"' || array_to_string(w, ' ') || '"' when 2 then w[1] || ' -"' || array_to_string(w, ' ') || '"'
 else w[1] || ' ' || array_to_string(['-' || x for x in w if x <> w[1]], ' ') end as text
 from (select item_id, [x for x in regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') if x <> ''] w from benchmark)
 cross join (values (0), (1), (2), (3)) f(form)"""),
    "snapshots": ("", """select url || '#' || page_id url, page_id * 4 + n id, cast(page_id % 4 as integer) maker_id,
 1704067200 + n * 86400 + page_id fetched_s,
 case when page_id % 17 = 0 and n = 3 then 404 when page_id % 19 = 0 and n = 2 then 304
 when page_id % 23 = 0 and n = 1 then 503 else 200 end status,
 html || '<!-- sid:' || n || ' -->' || case when page_id % 3 = 0 and n >= 2 then ' v2' else '' end body
 from pages cross join (values (0), (1), (2), (3)) v(n)"""),
    "filenames": ("", """select p_partkey image_id, p_partkey p, p_size, 100 + p_partkey % 900 d1, 100 + (p_partkey * 7 + 3) % 900 d2,
 case p_partkey % 4 when 0 then 'sw' || (100 + p_partkey % 900) || '_over_sw' || (100 + (p_partkey * 7 + 3) % 900)
 when 1 then 'sw' || (100 + p_partkey % 900) || '_under_sw' || (100 + (p_partkey * 7 + 3) % 900)
 when 2 then 'SW-' || (100 + p_partkey % 900)
 else 'sw' || (100 + p_partkey % 900) || '_over_sw' || (100 + (p_partkey * 7 + 3) % 900) || '_sw' || (101 + (p_partkey * 7 + 3) % 900) end
 || case p_size % 3 when 0 then '_cone' || (1 + p_size % 14) when 1 then '_cone06' else '' end
 || case when p_partkey % 5 = 0 then '_1234coats' else '' end
 || case p_partkey % 6 when 0 then '_bowl' when 1 then '_tile' else '' end
 || case when p_partkey % 7 = 0 then '_final' else '' end || case when p_partkey % 9 = 0 then '_glossy' else '' end
 || case when p_partkey % 23 = 0 then '_lineup' else '' end || case when p_partkey % 8 = 0 then '-scaled' else '' end || '.jpg' filename,
 'SW-' || case when p_partkey % 10 = 0 then 100 + (p_partkey * 7 + 3) % 900 else 100 + p_partkey % 900 end product_code,
 case when p_partkey % 3 = 0 then 'White Clay, cone 5 oxidation' end alt from part"""),
    "readings": ("", """select vec_id, label as owner, 50 + 100 * cast(embedding[1] as double) l1, 100 * cast(embedding[2] as double) a1,
 100 * cast(embedding[3] as double) b1, 50 + 100 * cast(embedding[4] as double) l2, 100 * cast(embedding[5] as double) a2,
 100 * cast(embedding[6] as double) b2 from embeddings"""),
    "all_readings": ("", """select vec_id * 22 + k reading_id, vec_id, 50 + 100 * cast(embedding[1 + (3 * k) % 64] as double) l1, 100 * cast(embedding[1 + (3 * k + 1) % 64] as double) a1,
 100 * cast(embedding[1 + (3 * k + 2) % 64] as double) b1 from embeddings cross join (select cast(unnest(range(0, 22)) as integer) k)"""),
    "all_pixels": ("", """select vec_id, i, least(255, cast(floor(512 * abs(cast(embedding[1 + (3 * i) % 64] as double))) as integer)) r,
 least(255, cast(floor(512 * abs(cast(embedding[1 + (3 * i + 1) % 64] as double))) as integer)) g,
 least(255, cast(floor(512 * abs(cast(embedding[1 + (3 * i + 2) % 64] as double))) as integer)) b from embeddings cross join (select cast(unnest(range(0, 22)) as integer) i)"""),
    "pixels": ("", """select vec_id, i, least(255, cast(floor(512 * abs(cast(embedding[3 * i + 1] as double))) as integer)) r,
 least(255, cast(floor(512 * abs(cast(embedding[3 * i + 2] as double))) as integer)) g,
 least(255, cast(floor(512 * abs(cast(embedding[3 * i + 3] as double))) as integer)) b
 from embeddings cross join (select cast(unnest(range(0, 21)) as integer) i)"""),
    "evs": ("", "select *, epoch_us(ts) us from events"),
    "marks_log": ("evs", """select user_id as key, us, event_id, case event_type when 'view' then 'own' when 'purchase' then 'wish'
 when 'click' then 'toggle' when 'signup' then 'note' else 'clear' end as action,
 case when event_type = 'signup' then case when event_id % 10 = 0 then '  ' else props end end note from evs"""),
    "stage_log": ("evs", """select user_id piece, us, event_id, case event_type when 'view' then 'throwing' when 'purchase' then 'firing'
 when 'click' then 'bisque' when 'signup' then 'note' else case when value > 60 then 'finished' else 'greenware' end end stage,
 case when event_id % 3 = 0 then 'photo-' || event_id end photo from evs"""),
}


def prelude(needs: list[str], sql: str) -> str:
    """Prefix ``sql`` with the CTEs of the views it reads (and theirs)."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in VIEW_SQL[name][0].split():
            visit(dep)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return sql
    ctes = ",\n".join(f"{name} as ({VIEW_SQL[name][1]})" for name in order)
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {ctes},\n{body[len('with recursive'):].lstrip()}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:].lstrip()}"
    return f"with {ctes}\n{body}"
