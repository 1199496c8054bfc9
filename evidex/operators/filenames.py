"""Facts stated by image file names, as column expressions (one pass, no shuffle).

Two sources have two grammars; what differs between them are the patterns, word lists and a few rules
stated below. Nothing is guessed: a word no rule claims is reported and lowers the confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.codes import LINE_PREFIXES, longest_first, zero_kept, zero_stripped
from evidex.functions.seal import seal
from evidex.functions.urls import CACHE_BUSTER, stem_of
from evidex.vocabulary import CLAY_NUMBERS

# --- fixed values: patterns and word lists of the second source ---------------------------------
B_CODE = r"(?<![a-z0-9])([a-z]{1,3})-?(\d{1,4})(?![0-9])"
B_CONE = r"(?<![a-z0-9])cone[-_ ]?(0?\d{1,2})(?![0-9])"
B_COATS = r"(?<![a-z0-9])(\d{1,4})[-_ ]?coats?(?![a-z])"
B_BETWEEN = r"^[-_ ]*(over|under)[-_ ]*$"
B_FORMS = {"bowl": "bowl", "bowls": "bowl", "mug": "mug", "cup": "cup", "plate": "plate", "vase": "vase",
           "tile": "flat_tile", "tiles": "flat_tile", "testtile": "flat_tile"}
B_NOISE = ["web", "crop", "cropped", "final", "copy", "edit", "edited", "new", "small", "large", "hires", "lores", "img", "image",
           "photo", "scaled", "labeled", "label", "release", "test", "igtall", "igsquare", "ig", "insta", "instagram", "sample",
           "swatch", "and", "the", "with", "on", "of", "in", "fired"]
B_LINE_WORDS = ["lineup"]
B_ALT_WORDS = ["oxidation", "reduction", "soda", "salt", "wood", "clay", "body", "white", "brown", "dark", "speckled", "red"]

# --- fixed values: patterns and word lists of the first source ----------------------------------
A_CODE = rf"(?<![a-z0-9])({longest_first(LINE_PREFIXES)})[-_ ]?(\d{{1,3}})(?![0-9])"
A_CONE = r"(?<![a-z0-9])cone[-_ ]?(0\d|\d{1,2})(?![0-9])"
A_CLAY = r"(?<![a-z0-9])(\d{1,2})[-_ ]?m(?![a-z0-9])"
A_COMPOSITE = r"application[-_ ]?tiles?"
A_CHART = r"colou?r[-_ ]?chart"
A_TILE = r"(?<![a-z0-9])(\d{1,2})\s?x\s?(\d{1,2})(?![0-9x])"
A_PIXELS = r"\d{3,4}\s?px(?:x\d{3,4}px)?"
A_GLUED = r"(?<=[a-z0-9])over(?=[a-z])"
#: in precedence order; a later vessel replaces an earlier tile
A_FORMS = {"fishtile": "textured_tile", "labeltile": "textured_tile", "squaretile": "flat_tile", "tile": "flat_tile", "chip": "flat_tile",
           "swatch": "flat_tile", "sake": "cup", "cup": "cup", "bowl": "bowl", "mug": "mug", "mugs": "mug", "plate": "plate",
           "vase": "vase", "basket": "basket"}
A_SWATCH_WORDS = ["chip", "swatch", "labeltile", "tile", "fishtile", "squaretile"]
A_NOISE = ["web", "website", "websiteswatch", "hires", "hi", "res", "large", "small", "jpg", "jpeg", "png", "gif", "productpage",
           "productimages", "sized", "original", "copy", "final", "new", "updated", "px", "label", "sample", "glaze", "glazes", "and",
           "the", "with", "on", "square", "x"]


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _present(text: Column) -> Column:
    return F.when(text != "", text)


def _codes(stem: Column, pattern: str, spell) -> Column:
    prefixes = F.regexp_extract_all(stem, F.lit(pattern), 1)
    digits = F.regexp_extract_all(stem, F.lit(pattern), 2)
    return F.zip_with(prefixes, digits, spell)


def _blank_first(text: Column, needle: Column) -> Column:
    """``text`` with the first ``needle`` blanked out; a null needle matches nothing.

    ``text`` is written once, so blanking several needles in a row stays linear.
    """
    literal = F.coalesce(F.concat(F.lit(r"\Q"), needle, F.lit(r"\E")), F.lit("(?!)"))
    return F.array_join(F.split(text, literal, 2), " ")


def _evidence(rules: dict[str, Column]) -> Column:
    """Rule -> the words that fired it; rules that did not fire are absent."""
    pairs = [x for name, value in rules.items() for x in (F.lit(name), value)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _facts(df: DataFrame, given: list[str]) -> DataFrame:
    out = df.drop(*[c for c in df.columns if c.startswith("__")])
    return seal(out, *[c for c in out.columns if c not in given])


def source_b_facts(images: DataFrame, filename: str = "filename", product_code: str = "product_code", alt: str = "alt") -> DataFrame:
    """Add role, subject, layered_over, combination, cone, coats, form, confidence, unmatched, evidence."""
    df = images.withColumn("__stem", stem_of(F.col(filename)))
    stem, product = F.col("__stem"), F.col(product_code)
    df = df.withColumns({
        "__codes": _codes(stem, B_CODE, zero_kept),
        "__pieces": F.split(stem, B_CODE, -1),
        "__cone_text": _present(F.regexp_extract(stem, B_CONE, 0)),
        "__coat_text": _present(F.regexp_extract(stem, B_COATS, 0)),
        "__alt_cone": _present(F.regexp_extract(F.lower(alt), B_CONE, 0)),
        "__words": F.split(stem, "[^a-z0-9]+"),
    })
    codes, n = F.col("__codes"), F.size("__codes")
    # What stands between two codes orders them only if, its cone aside, it is exactly over or under.
    gaps = F.slice("__pieces", F.lit(2), F.greatest(n - 1, F.lit(0)))
    ways = F.transform(gaps, lambda g: F.regexp_extract(F.regexp_replace(g, B_CONE, ""), B_BETWEEN, 1))
    df = df.withColumn("__gaps", gaps).withColumn("__ways", ways)
    df = df.withColumn("__way", F.when(n == 2, _present(F.col("__ways")[0])))
    over = F.col("__way") == "over"
    df = df.withColumns({
        "__top": F.when(F.col("__way").isNotNull(), F.when(over, codes[0]).otherwise(codes[1])),
        "__base": F.when(F.col("__way").isNotNull(), F.when(over, codes[1]).otherwise(codes[0])),
        "__any_way": F.when(n > 1, F.try_element_at(F.filter("__ways", lambda w: w != ""), F.lit(1))),
        # pieces[i + 1] is the first gap that stated a direction
        "__way_at": F.when(n > 1, F.array_position(F.transform("__ways", lambda w: w != ""), True).cast("int")),
    })
    # On the base's own page the pair says "something is on me", which is no layering of this item.
    on_base = F.coalesce(product == F.col("__base"), F.lit(False))
    df = df.withColumn("layered_over", F.when(~on_base, F.col("__base")))
    df = df.withColumn("combination", F.when(F.col("layered_over").isNull() & (n > 1), codes).otherwise(F.array().cast("array<string>")))
    df = df.withColumns({
        "subject": F.coalesce("__top", F.when(F.coalesce(F.array_contains("__codes", product), F.lit(False)), product), F.try_element_at("__codes", F.lit(1)), product),
        "cone": F.coalesce(_present(F.regexp_extract(stem, B_CONE, 1)), _present(F.regexp_extract(F.lower(alt), B_CONE, 1))),
        "coats": _present(F.regexp_extract(stem, B_COATS, 1)),
        "__form_word": F.try_element_at(F.filter("__words", lambda w: w.isin(list(B_FORMS))), F.lit(1)),
        "__line_word": F.try_element_at(F.filter("__words", lambda w: w.isin(B_LINE_WORDS)), F.lit(-1)),
    })
    df = df.withColumn("form", F.try_element_at(_lookup(B_FORMS), F.col("__form_word")))
    # Residue: pieces between codes without the gap that gave a direction, first cone and coats blanked.
    kept = F.filter("__pieces", lambda p, i: F.col("__way_at").isNull() | (F.col("__way_at") == 0) | (i != F.col("__way_at")))
    residue = _blank_first(_blank_first(F.array_join(kept, " "), F.col("__cone_text")), F.col("__coat_text"))
    known = [*B_NOISE, *B_LINE_WORDS, *B_FORMS]
    leftover = F.filter(F.split(residue, "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~w.isin(known) & ~w.rlike(r"^\d+[a-z]?$"))
    alt_words = F.filter(F.split(F.lower(alt), "[^a-z0-9]+"), lambda w: w.isin(B_ALT_WORDS))
    # Alt words are merged as a set; without alt the residue keeps its repeats.
    df = df.withColumn("unmatched", F.when(F.coalesce(F.col(alt), F.lit("")) == "", leftover).otherwise(
        F.array_distinct(F.concat(leftover, alt_words))))
    combined, read = F.size("combination") > 0, n > 0
    df = df.withColumns({
        "role": (F.when(F.col("__line_word").isNotNull(), "line_chart").when(F.col("layered_over").isNotNull(), "layered")
                 .when(combined | F.col("coats").isNotNull(), "other")
                 .when(F.coalesce(F.col("form") != "flat_tile", F.lit(False)), "in_use")
                 .when((n == 1) | F.coalesce(F.col("form") == "flat_tile", F.lit(False)), "label_chip").otherwise("other")),
        "confidence": (F.when(F.col("subject").isNull() | combined, "low").when(~read, "medium")
                       .when(F.size("unmatched") > 0, "medium").otherwise("high")),
        "evidence": _evidence({
            "glaze_code": F.when(read, F.array_join("__codes", ",")),
            "layering": F.concat("__top", F.lit(" over "), "__base"), "layering_direction": F.col("__any_way"),
            "layered_under": F.when(on_base, F.col("__top")), "cone": F.col("__cone_text"),
            "cone_from_alt": F.when(F.col("__cone_text").isNull(), F.col("__alt_cone")), "coats_unsplit": F.col("__coat_text"),
            "form": F.col("__form_word"), "line_image": F.col("__line_word")}),
    })
    return _facts(df, images.columns)


def source_a_facts(images: DataFrame, filename: str = "filename", product_code: str = "product_code", product_name: str = "product_name") -> DataFrame:
    """Add role, subject, layered_over, combination, cone, clay, tile_size, form, confidence, unmatched, evidence."""
    df = images.withColumn("__stem", F.regexp_replace(stem_of(F.col(filename), (CACHE_BUSTER,)), A_GLUED, "_over_"))
    stem, product = F.col("__stem"), F.col(product_code)

    def word(w: str) -> str:
        return rf"(?<![a-z]){w}(?![a-z])"

    df = df.withColumns({
        "__codes": _codes(stem, A_CODE, zero_stripped), "__pieces": F.split(stem, A_CODE, -1),
        "__cone_text": _present(F.regexp_extract(stem, A_CONE, 0)), "cone": _present(F.regexp_extract(stem, A_CONE, 1)),
        "__clays": F.filter(F.zip_with(F.regexp_extract_all(stem, F.lit(A_CLAY), 1), F.regexp_extract_all(stem, F.lit(A_CLAY), 0),
                                       lambda d, t: F.struct(d.cast("int").alias("number"), t.alias("text"))), lambda c: c["number"].isin(CLAY_NUMBERS)),
        "__comp": _present(F.regexp_extract(stem, A_COMPOSITE, 0)), "__chart": _present(F.regexp_extract(stem, A_CHART, 0)),
        "__tile": _present(F.regexp_extract(stem, A_TILE, 0)),
        "tile_size": F.when(stem.rlike(A_TILE), F.concat(F.regexp_extract(stem, A_TILE, 1), F.lit("x"), F.regexp_extract(stem, A_TILE, 2))),
    })
    codes, n = F.col("__codes"), F.size("__codes")
    gaps = F.slice("__pieces", F.lit(2), F.greatest(n - 1, F.lit(0)))
    df = df.withColumn("__at", F.array_position(F.transform(gaps, lambda g: g.rlike(r"^[-_ ]*over[-_ ]*$")), True).cast("int"))
    pair = F.coalesce(F.col("__at"), F.lit(0)) > 0
    df = df.withColumns({
        "__top": F.when(pair, F.try_element_at(codes, F.col("__at"))), "layered_over": F.when(pair, F.try_element_at(codes, F.col("__at") + 1)),
        "__clay": F.try_element_at("__clays", F.lit(1)),
    })
    df = df.withColumn("clay", F.col("__clay.number"))
    seen = {w: stem.rlike(word(w)) for w in A_FORMS}
    tiles = ("flat_tile", "textured_tile")
    # The first vessel word wins; without one, the last tile word listed.
    vessel = F.coalesce(*[F.when(hit, F.lit(A_FORMS[w])) for w, hit in seen.items() if A_FORMS[w] not in tiles])
    tile = F.coalesce(*[F.when(hit, F.lit(A_FORMS[w])) for w, hit in reversed(seen.items()) if A_FORMS[w] in tiles])
    df = df.withColumn("form", F.coalesce(vessel, tile))
    swatch = F.lit(False)
    for w in A_SWATCH_WORDS:
        swatch = swatch | seen[w]
    df = df.withColumn("role", F.when(F.col("__chart").isNotNull(), "line_chart").when(F.col("__comp").isNotNull(), "coats_composite")
                       .when(F.col("__top").isNotNull(), "layered").when(vessel.isNotNull(), "in_use").when(swatch, "label_chip")
                       .when(n == 1, "label_chip").otherwise("other"))
    df = df.withColumns({
        "subject": F.when(F.col("role") != "line_chart", F.coalesce(
            "__top", F.when(F.coalesce(F.array_contains("__codes", product), F.lit(False)), product), F.when(n == 1, codes[0]), product)),
        "combination": F.when(F.col("__top").isNull() & (n > 1), codes).otherwise(F.array().cast("array<string>")),
    })
    kept = F.filter("__pieces", lambda p, i: ~(F.coalesce(F.col("__at"), F.lit(0)) > 0) | (i != F.col("__at")))
    residue = F.array_join(kept, " ")
    clay_text = F.col("__clay.text")
    for found in (F.col("__cone_text"), clay_text, F.col("__comp"), F.col("__chart"), F.col("__tile")):
        residue = _blank_first(residue, found)
    for w in A_FORMS:
        residue = F.regexp_replace(residue, word(w), " ")
    residue = F.regexp_replace(residue, A_PIXELS, " ")
    df = df.withColumn("__residue", residue)
    # Words of the item's own name say nothing new, alone or run together.
    names = F.filter(F.split(F.lower(F.coalesce(F.col(product_name), F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 1)
    df = df.withColumn("__names", F.when(F.size(names) > 0, F.array_union(names, F.array(F.lit("and")))).otherwise(names))
    built = F.concat(F.lit("^("), F.array_join("__names", "|"), F.lit(")+$"))
    df = df.withColumn("unmatched", F.filter(F.split("__residue", "[-_ ]+"), lambda w: (w != "") & ~w.isin(A_NOISE) & ~w.rlike(r"^\d+[a-z]?$")
                       & ~((F.size("__names") > 0) & F.regexp_like(w, built))))
    combined = F.size("combination") > 0
    return df.withColumns({
        "confidence": F.when(F.col("subject").isNull() | combined | (n == 0), "low").when(F.size("unmatched") > 0, "medium").otherwise("high"),
        "evidence": _evidence({
            "glaze_code": F.when(n > 0, F.array_join("__codes", ",")), "layering": F.concat("__top", F.lit(" over "), "layered_over"),
            "cone": F.col("__cone_text"), "clay_body": clay_text, "coats_composite": F.col("__comp"), "line_chart": F.col("__chart"),
            "tile_size": F.col("tile_size"), "form": F.col("form")}),
    }).transform(_facts, images.columns)
