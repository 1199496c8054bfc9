"""Fields of stored HTML pages, extracted in bulk with patterns (no page is parsed into a tree).

Links are taken from one container only: pages also list other items, and an unscoped scan would
pick those up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.codes import LINE_NAMES, name_code
from evidex.functions.text import clean_text
from evidex.functions.urls import CACHE_BUSTER, basename

# --- fixed values: page patterns and icon vocabulary of the first source -------------------------
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
JSON_LD = r'(?is)<script type="application/ld\+json">(.*?)</script>'
GALLERY = r"(?is)<[a-z]+[^>]*data-image-gallery[^>]*>(.*?)</section>"
GALLERY_LINK = r"""(?is)<a\b[^>]*data-fancybox=['"]image-gallery['"][^>]*>"""
HREF = r"""(?is)\bhref=["']([^"']+)["']"""
ICON = r"""(?i)/image-manager/([^/?"']+\.png)"""
#: icon -> (field, value); a later icon of a field replaces an earlier one
ICONS = [
    ("opaque-icon-web.png", "opacity", "opaque"), ("semitransparent-icon-web.png", "opacity", "translucent"),
    ("transparent-icon-web.png", "opacity", "transparent"), ("ap-logo.png", "ap_seal", "true"), ("cl-logo.png", "ap_seal", "false"),
    ("cone-logo.png", "cone_declared", "true"), ("cone05-logo.png", "cone_declared", "true"), ("spray-logo.png", "spray_safe", "true"),
    ("no-word-spray-logo.png", "spray_safe", "false"), ("no-words-spray-logo.png", "spray_safe", "false"),
    ("food-safe-logo-with-tm-with-words-black.png", "food_safe", "true"),
    ("no-words-c1294f51-0570-4c25-b629-7544961a7b2b.png", "food_safe", "true"),
    ("foodsafeunderaglaze-web.png", "food_safe_under_glaze", "true"), ("mixable-logo.png", "mixable", "true"),
    ("layering-logo-black.png", "layerable", "true"), ("layerinicon-web.png", "layerable", "true"), ("dippingicon-web.png", "is_dipping", "true"),
    ("no-words-notsafe-spray-symbol-black-tm-2014.png", "spray_safe", "false"), ("notsafe-spray-symbol-black-tm-2014.png", "spray_safe", "false"),
    ("no-words-notfoodsafe-web-icon.png", "food_safe", "false"),
    ("food-safe-logo-not-with-tm-with-words-black-red-thick-line.png", "food_safe", "false"),
    ("foodsafe-appliedoverceladons-web-final.png", "food_safe_under_glaze", "true"),
    ("foodsafe-butnotdurable-web-final.png", "food_safe_not_durable", "true"), ("conformstoastm-d-4236-web.png", "astm_d4236", "true"),
]
WARNING_PREFIX, WARNING_SUFFIX = "p65-icon-web", "prop65warnings.png"

LD = """struct<`@type`:string,name:string,description:string,offers:variant,
  itemListElement:array<struct<item:struct<name:string>>>>"""


def _text(pattern: str, html: Column) -> Column:
    found = F.regexp_extract(html, pattern, 1)
    return F.when(found != "", clean_text(found))


def scoped(html: Column, container: str) -> Column:
    """The inside of one container, empty when the page has none."""
    return F.regexp_extract(html, container, 1)


def links(html: Column, container: str, tag: str = r"(?is)<a\b[^>]*>") -> Column:
    """Link targets inside the container, in page order."""
    tags = F.regexp_extract_all(scoped(html, container), F.lit(tag), 0)
    return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, HREF, 1)), lambda h: h != "")


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, heading, language, counts of links and paragraphs, plain text of the article."""
    h = F.col(html)
    article = F.regexp_extract(h, r"(?is)<article[^>]*>(.*?)</article>", 1)
    return pages.withColumns({
        "title": _text(TITLE, h), "heading": _text(r"(?is)<h1[^>]*>(.*?)</h1>", h),
        "lang": F.nullif(F.regexp_extract(h, r'(?i)<html[^>]*\blang="([^"]*)"', 1), F.lit("")),
        "n_nav": F.size(links(h, r"(?is)<nav[^>]*>(.*?)</nav>")),
        "n_paragraphs": F.regexp_count(article, F.lit("(?i)<p>")), "article_chars": F.length(article),
    })


def ld_blocks(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Readable JSON-LD blocks, lists opened; a malformed block costs only itself."""
    bodies = F.regexp_extract_all(F.col(html), F.lit(JSON_LD), 1)
    opened = (pages.select(*keep, F.posexplode(bodies).alias("block", "__b"))
              .filter(F.try_parse_json("__b").isNotNull()))
    listed = F.when(F.ltrim("__b").startswith("["), F.from_json("__b", f"array<{LD}>")).otherwise(F.array(F.from_json("__b", LD)))
    return opened.select(*keep, "block", F.explode(listed).alias("ld"))


def product_fields(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """Product facts of the first source's pages: JSON-LD first, the title as a fallback for the name."""
    blocks = ld_blocks(pages, keep, html)
    kind = F.col("ld.@type")
    per_page = blocks.groupBy(*keep).agg(
        F.min_by("ld", F.when(kind == "Product", F.col("block"))).alias("p"),
        F.max_by("ld", F.when(kind == "BreadcrumbList", F.col("block"))).alias("c"))
    # What is read off pages is far larger than the files that they come from say, so it is never sent whole to the driver.
    rows = pages.select(*keep, _text(TITLE, F.col(html)).alias("__title")).join(per_page.hint("merge"), keep, "left")
    name = F.coalesce(F.nullif(clean_text(F.col("p.name")), F.lit("")), F.trim(F.split("__title", r"\|")[0]))
    crumbs = F.transform("c.itemListElement", lambda i: clean_text(F.coalesce(i["item"]["name"], F.lit(""))))

    def offer(key: str) -> Column:
        return F.coalesce(F.try_variant_get(F.col("p.offers"), f"$.{key}", "string"), F.try_variant_get(F.col("p.offers"), f"$[0].{key}", "string"))

    prices = F.filter(F.transform(F.array(*[offer(k) for k in ("lowPrice", "highPrice", "price")]), lambda v: v.try_cast("decimal(18,2)")), lambda v: v.isNotNull())
    code = name_code(name)
    line = F.regexp_extract(code, "^([A-Z]+)-", 1)
    return rows.select(
        *keep, name.alias("name"), F.coalesce(code, name).alias("code"), line.alias("line_code"), F.try_element_at(F.create_map(*[F.lit(x) for pair in LINE_NAMES.items() for x in pair]), line).alias("line_name"),
        crumbs.alias("breadcrumb"), F.when(F.size(crumbs) > 3, crumbs[2]).alias("range_category"), clean_text(F.col("p.description")).alias("description"),
        F.array_min(prices).alias("price_min"), F.array_max(prices).alias("price_max"),
        F.nullif(F.regexp_extract(offer("availability"), "([^/]*)$", 1), F.lit("")).alias("availability"))


def gallery_images(pages: DataFrame, keep: list[str], html: str = "html", container: str = GALLERY, tag: str = GALLERY_LINK) -> DataFrame:
    """Full-size image links of the page's own gallery, upload stamps stripped from the names."""
    return named_images(pages.select(*keep, F.posexplode(links(F.col(html), container, tag)).alias("place", "source_url")))


def named_images(links: DataFrame) -> DataFrame:
    """Links with ``raw_filename``: the last part of the address without its upload stamp."""
    return links.withColumn("raw_filename", F.regexp_replace(basename(F.col("source_url")), CACHE_BUSTER, ""))


def icons(html: Column) -> Column:
    """Distinct property icons in page order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(ICON), 1))


def icon_badges(pages: DataFrame, keep: list[str], html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(badges, unknown icons): a later icon of a field replaces an earlier one on the page."""
    return badges_of(pages.select(*keep, F.posexplode(icons(F.col(html))).alias("place", "icon")), keep)


def badges_of(seen: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same from icons with their places on the page."""
    from evidex.session import literal_table

    spec = F.broadcast(literal_table(seen.sparkSession, "icon string, badge string, value string", ICONS))
    warning = F.lower("icon").startswith(WARNING_PREFIX) | F.lower("icon").endswith(WARNING_SUFFIX)
    mapped = seen.join(spec, "icon", "left").withColumns({
        "badge": F.when(warning, "prop65").otherwise(F.col("badge")), "value": F.when(warning, "true").otherwise(F.col("value"))})
    badges = mapped.filter("badge is not null").groupBy(*keep, "badge").agg(F.max_by("value", "place").alias("value"))
    return badges, mapped.filter("badge is null").select(*keep, F.col("icon").alias("unknown"))
