"""JSON product payloads to nested product rows.

A payload is a list holding one product, or the product itself. It is read with a fixed schema; a
payload that does not parse, carries no stock number or prices without a scale becomes a dead
letter, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.codes import sku_code
from evidex.functions.seal import seal
from evidex.functions.text import clean_text, unescape
from evidex.functions.urls import basename, slug_of
from evidex.session import literal_table

PRODUCT = """struct<sku:string,name:string,permalink:string,short_description:string,description:string,is_in_stock:boolean,
  prices:struct<price:string,currency_minor_unit:int,price_range:struct<min_amount:string,max_amount:string>>,
  categories:array<struct<slug:string,name:string,link:string>>,
  images:array<struct<src:string,alt:string,name:string>>,
  attributes:array<struct<name:string,terms:array<struct<name:string>>>>>"""

# --- fixed values: category and attribute vocabularies of the second source ---------------------
FIRED_PATH = "/product-category/color/fired/"
FIRED_CHILD = r"/product-category/color/fired/([^/]+)/"
EXCLUDED_CATEGORIES = ["product-kits", "non-fired"]
NOT_A_LINE = ["color", "fired", "new-colors", "new-stoneware-glazes-colors", "discontinued-products"]
NO_RANGE_STATED = ["raku"]
PLACEHOLDER = "(?i)image-coming-soon"
#: line slug -> stated range
LINE_RANGES = {
    "stoneware": ("6", "10"), "stoneware-specialty": ("6", "10"), "stoneware-clear": ("6", "10"), "stoneware-engobes": ("04", "10"),
    "stroke-coat": ("06", "10"), "speckled-stroke-coat": ("06", "10"), "foundations": ("06", "6"), "jungle-gems": ("06", "6"),
    "fundamentals-underglaze": ("06", "10"), "e-z-stroke-translucent-underglazes": ("06", "10"),
    "elements-and-elements-chunkies": ("06", "6"), "ritual-glazes": ("04", "10"), "designer-liner": ("06", "6"), "washes": ("06", "10"),
    "flux": ("6", "10"), "classic-crackles": ("06", "6"), "cobblestone": ("06", "10"), "snow-gems": ("06", "10"), "snowfall": ("06", "6"),
    "french-dimensions": ("06", "6"), "pottery-cascade": ("06", "6"), "rapid-roll": ("06", "06"),
    "low-fire-clear-glaze-brushing": ("06", "6"), "low-fire-clear-glaze-dipping": ("06", "6"),
}
#: (attribute key, value token) -> (badge, value)
BADGE_VALUES = [
    ("dinnerwaresafe", "dinnerware-safe", "dinnerware_safe", True), ("dinnerwaresafe", "not-dinnerware-safe", "dinnerware_safe", False),
    ("dinnerwaresafe", "dinnerware-safe-with-clear-glaze", "food_safe_under_glaze", True), ("foodsafe", "food-safe", "food_safe", True),
    ("foodsafe", "ap-acmi", "ap_seal", True), ("foodsafe", "cl-acmi", "ap_seal", False),
]
SAYS_NOTHING = [("foodsafe", "non-toxic")]
IGNORED_ATTRIBUTES = ["countryoforigin", "sizeunitofmeasure", "countsizeunitofmeasure", "navitemnumber"]


def parse_products(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Add ``product``; it is null where the payload cannot be read."""
    listed = F.from_json(F.col(body), f"array<{PRODUCT}>", {"mode": "PERMISSIVE"})
    single = F.from_json(F.col(body), PRODUCT, {"mode": "PERMISSIVE"})
    is_list = F.ltrim(F.col(body)).startswith("[")
    whole = F.try_parse_json(F.col(body)).isNotNull()
    product = F.when(whole & is_list, F.try_element_at(listed, F.lit(1))).when(whole, single)
    return seal(payloads.withColumn("product", product), "product")


def dead_letter_reason(product: Column) -> Column:
    """Why a payload yields no product; null when it does."""
    return (F.when(product.isNull(), "unreadable payload")
            .when(F.coalesce(F.trim(product["sku"]), F.lit("")) == "", "no stock number")
            .when(price_without_scale(product["prices"]), "price without scale"))


def _amount(raw: Column, unit: Column) -> Column:
    """Minor units to money; zero and text that is no integer mean "no price"."""
    whole = F.when(F.trim(raw).rlike(r"^[+-]?\d+$"), F.trim(raw).try_cast("decimal(18,0)"))
    value = (whole / F.pow(F.lit(10), unit).cast("decimal(10,0)")).cast("decimal(18,4)")
    return F.when(whole != 0, value)


def price_span(prices: Column) -> tuple[Column, Column]:
    """Cheapest and dearest variant; a flat price is both."""
    unit = prices["currency_minor_unit"]
    low, high = (_amount(prices["price_range"][f], unit) for f in ("min_amount", "max_amount"))
    flat = _amount(prices["price"], unit)
    ranged = low.isNotNull() | high.isNotNull()
    return F.when(ranged, low).otherwise(flat), F.when(ranged, high).otherwise(flat)


def price_without_scale(prices: Column) -> Column:
    stated = [prices["price"], prices["price_range"]["min_amount"], prices["price_range"]["max_amount"]]
    priced = F.exists(F.array(*stated), lambda raw: F.coalesce(raw.try_cast("decimal(18,0)") != 0, F.lit(False)))
    return prices["currency_minor_unit"].isNull() & priced


def line_of(categories: Column) -> Column:
    """(slug, name) of the direct child of the fired branch; else the child a deeper link runs through."""
    named = F.transform(F.filter(categories, lambda c: ~F.coalesce(c["slug"].isin(NOT_A_LINE), F.lit(False))), lambda c: F.struct(
        c["slug"].alias("slug"), c["name"].alias("name"), F.regexp_extract(c["link"], FIRED_CHILD, 1).alias("child")))
    direct = F.try_element_at(F.filter(named, lambda c: (c["child"] != "") & (c["child"] == c["slug"])), F.lit(1))
    deeper = F.try_element_at(F.filter(named, lambda c: c["child"] != ""), F.lit(1))["child"]
    return (F.when(direct.isNotNull(), F.struct(direct["slug"].alias("slug"), clean_text(F.coalesce(direct["name"], direct["slug"])).alias("name")))
            .when(deeper.isNotNull(), F.struct(deeper.alias("slug"), deeper.alias("name"))))


def attribute_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def value_token(value: Column) -> Column:
    """One token for an icon address, prose, or an image tag that state the same fact; character references are decoded first."""
    text = F.trim(value)
    src = F.regexp_extract(text, r"""(?i)src\s*=\s*["']([^"']+)["']""", 1)
    inner = F.when(src != "", src).otherwise(text)
    is_file = F.contains(inner, F.lit("//")) | F.lower(inner).rlike(r"\.(png|jpg|gif|svg)$")
    name = F.when(is_file, F.regexp_replace(basename(inner), r"(?i)\.[a-z]{3,4}$", "")).otherwise(inner)
    return F.trim(F.regexp_replace(F.lower(unescape(name)), "[^a-z0-9]+", "-"), F.lit("-"))


def attribute_values(products: DataFrame, keep: list[str]) -> DataFrame:
    """(key, token) rows; an attribute without a value has a null token."""
    return (products.select(*keep, F.explode("product.attributes").alias("__a"))
            .select(*keep, attribute_key(F.col("__a.name")).alias("key"), F.explode_outer("__a.terms").alias("__t"))
            .filter(~F.col("key").isin([*IGNORED_ATTRIBUTES, ""]))
            .select(*keep, "key", value_token(F.col("__t.name")).alias("token")))


def badges(values: DataFrame, keep: list[str]) -> DataFrame:
    """(badge, value) of every product; of contradicting statements the denial stands."""
    mapped = _mapped(values)
    return mapped.filter("badge is not null").groupBy(*keep, "badge").agg(F.bool_and("badge_value").alias("value"))


def unknown_attributes(values: DataFrame, keep: list[str]) -> DataFrame:
    """Attribute statements no rule knows, for the review queue."""
    silent = F.lit(False)
    for key, token in SAYS_NOTHING:
        silent = silent | ((F.col("key") == key) & F.coalesce(F.col("token") == token, F.lit(False)))
    label = F.when(F.coalesce(F.col("token"), F.lit("")) == "", F.col("key")).otherwise(F.concat("key", F.lit("="), "token"))
    return _mapped(values).filter(F.col("badge").isNull() & ~silent).select(*keep, label.alias("unknown")).distinct()


def _mapped(values: DataFrame) -> DataFrame:
    from evidex.session import literal_table

    spec = F.broadcast(literal_table(values.sparkSession, "key string, token string, badge string, badge_value boolean", BADGE_VALUES))
    return values.join(spec, ["key", "token"], "left")


def images(products: DataFrame, keep: list[str]) -> DataFrame:
    """Gallery images at full size, the placeholder left out."""
    shown = F.filter("product.images", lambda i: (F.coalesce(i["src"], F.lit("")) != "") & ~i["src"].rlike(PLACEHOLDER))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return (products.select(*keep, F.posexplode(shown).alias("place", "__i"))
            .select(*keep, "place", F.col("__i.src").alias("source_url"), basename(F.col("__i.src")).alias("raw_filename"),
                    blank(F.col("__i.alt")).alias("alt"), blank(F.col("__i.name")).alias("title")))


def product_rows(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """The flat product of every readable payload."""
    p = F.col("product")
    low, high = price_span(p["prices"])
    line = line_of(p["categories"])
    code = sku_code(p["sku"])
    name = clean_text(p["name"])
    text = F.coalesce(F.nullif(clean_text(p["short_description"]), F.lit("")), F.nullif(clean_text(p["description"]), F.lit("")))
    return parsed.filter(dead_letter_reason(p).isNull()).select(
        *keep, slug_of(p["permalink"]).alias("external_id"), p["permalink"].alias("product_url"), code.alias("code"),
        F.coalesce(F.nullif(name, F.lit("")), code).alias("name"), line["slug"].alias("line_code"), line["name"].alias("line_name"),
        F.when(~line["slug"].isin(NO_RANGE_STATED), line["slug"]).alias("range_category"), text.alias("description"),
        low.alias("price_min"), high.alias("price_max"),
        F.when(p["is_in_stock"], "InStock").otherwise("OutOfStock").alias("availability"),
        F.array_join(F.transform(p["categories"], lambda c: clean_text(c["name"])), " > ").alias("breadcrumb"))
