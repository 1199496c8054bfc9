"""Colour expressions: sRGB to CIE L*a*b* and CIEDE2000.

Each formula is a list of named steps bound to columns: a chain of code-generated projections, in
which no intermediate is computed twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.seal import seal

Get = Callable[[str], Column]
Step = tuple[str, Callable[[Get], Column]]

# --- fixed values: IEC 61966-2-1 matrix, D65 white point (CIE 1931 2 degree observer) -----------
SRGB_TO_XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (0.3127 / 0.3290, 1.0, (1 - 0.3127 - 0.3290) / 0.3290)
EPSILON, KAPPA = 216 / 24389, 24389 / 27


def _linear(channel: Column) -> Column:
    c = channel / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def _f(t: Column) -> Column:
    return F.when(t > EPSILON, F.cbrt(t)).otherwise((KAPPA * t + 16) / 116)


def _lab_steps() -> list[Step]:
    steps: list[Step] = [(f"lin_{c}", lambda g, c=c: _linear(g(c))) for c in "rgb"]
    for axis, row, white in zip("xyz", SRGB_TO_XYZ, WHITE, strict=True):
        steps.append((f"f_{axis}", lambda g, row=row, white=white: _f(
            (row[0] * g("lin_r") + row[1] * g("lin_g") + row[2] * g("lin_b")) / white)))
    return steps


#: outputs of the sRGB conversion, computed from the steps above
_LAB_OUT: list[Step] = [
    ("lab_l", lambda g: 116 * g("f_y") - 16),
    ("lab_a", lambda g: 500 * (g("f_x") - g("f_y"))),
    ("lab_b", lambda g: 200 * (g("f_y") - g("f_z"))),
]


def _hue(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)))


def _cos(deg: Column) -> Column:
    return F.cos(F.radians(deg))


_P7 = 25.0 ** 7


def _ratio7(c: Column) -> Column:
    c7 = F.pow(c, 7)
    return F.sqrt(c7 / (c7 + _P7))


def _hue_gap(g: Get) -> Column:
    d = g("h2") - g("h1")
    turn = F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)
    return F.when(g("c1") * g("c2") == 0, F.lit(0.0)).otherwise(turn)


def _hue_mean(g: Get) -> Column:
    s, gap = g("h1") + g("h2"), F.abs(g("h1") - g("h2"))
    return (F.when(g("c1") * g("c2") == 0, s).when(gap <= 180, s / 2)
            .when(s < 360, (s + 360) / 2).otherwise((s - 360) / 2))


#: CIEDE2000 (Sharma, Wu, Dalal 2005) over fields l1 a1 b1 l2 a2 b2
_DELTA_STEPS: list[Step] = [
    ("k", lambda g: 1.5 - 0.5 * _ratio7(
        (F.sqrt(g("a1") * g("a1") + g("b1") * g("b1")) + F.sqrt(g("a2") * g("a2") + g("b2") * g("b2"))) / 2)),
    ("p1", lambda g: g("a1") * g("k")),
    ("p2", lambda g: g("a2") * g("k")),
    ("c1", lambda g: F.sqrt(g("p1") * g("p1") + g("b1") * g("b1"))),
    ("c2", lambda g: F.sqrt(g("p2") * g("p2") + g("b2") * g("b2"))),
    ("h1", lambda g: _hue(g("p1"), g("b1"))),
    ("h2", lambda g: _hue(g("p2"), g("b2"))),
    ("dh", lambda g: 2 * F.sqrt(g("c1") * g("c2")) * F.sin(F.radians(_hue_gap(g) / 2))),
    ("hm", _hue_mean),
    ("lm", lambda g: F.pow((g("l1") + g("l2")) / 2 - 50, 2)),
    ("cm", lambda g: (g("c1") + g("c2")) / 2),
    ("t", lambda g: 1 - 0.17 * _cos(g("hm") - 30) + 0.24 * _cos(2 * g("hm"))
        + 0.32 * _cos(3 * g("hm") + 6) - 0.20 * _cos(4 * g("hm") - 63)),
    ("rt", lambda g: -2 * _ratio7(g("cm")) * F.sin(F.radians(60 * F.exp(-F.pow((g("hm") - 275) / 25, 2))))),
    ("xl", lambda g: (g("l2") - g("l1")) / (1 + 0.015 * g("lm") / F.sqrt(20 + g("lm")))),
    ("xc", lambda g: (g("c2") - g("c1")) / (1 + 0.045 * g("cm"))),
    ("xh", lambda g: g("dh") / (1 + 0.015 * g("cm") * g("t"))),
    ("de", lambda g: F.sqrt(g("xl") * g("xl") + g("xc") * g("xc") + g("xh") * g("xh")
                            + g("rt") * g("xc") * g("xh"))),
]


def _with_steps(df: DataFrame, prefix: str, inputs: dict[str, Column], steps: Sequence[Step],
                outputs: dict[str, str]) -> DataFrame:
    get: Get = lambda name: F.col(prefix + name)
    df_cols = df.columns
    out = df.withColumns({prefix + k: v.cast("double") for k, v in inputs.items()})
    for name, step in steps:
        out = out.withColumn(prefix + name, step(get))
    return seal(out.select(*df_cols, *[get(name).alias(alias) for name, alias in outputs.items()]), *outputs.values())


def with_lab(df: DataFrame, r: str, g: str, b: str, out: Sequence[str] = ("lab_l", "lab_a", "lab_b")) -> DataFrame:
    """Add L*, a*, b* (D65) of an sRGB triple of 0..255 channels."""
    return _with_steps(df, "__c_", {"r": F.col(r), "g": F.col(g), "b": F.col(b)}, _lab_steps() + _LAB_OUT,
                       dict(zip(("lab_l", "lab_a", "lab_b"), out, strict=True)))


def with_delta_e(df: DataFrame, first: Sequence[str], second: Sequence[str], out: str = "delta_e") -> DataFrame:
    """Add the CIEDE2000 distance of two L*a*b* column triples."""
    inputs = {f"{n}{i}": F.col(c) for i, cols in ((1, first), (2, second))
              for n, c in zip("lab", cols, strict=True)}
    return _with_steps(df, "__d_", inputs, _DELTA_STEPS, {"de": out})


def reading_words(readings: DataFrame, key: str, colours: Sequence[tuple[str, str, str, int]], vocabulary: Sequence[tuple]) -> DataFrame:
    """(key, hits, words): the terms whose own radius contains a measured colour.

    ``colours`` lists L*, a*, b* columns and how many terms each may give, main colour first. Words
    are each term followed by its family, first occurrence kept. The closed vocabulary is a literal
    array, so every distance is a code-generated projection beside its reading; only hits are
    shuffled, and a reading has at most one per term and colour. Equal distances keep vocabulary
    order.
    """
    terms = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(t).alias("term"), F.lit(tl).alias("l2"), F.lit(ta).alias("a2"),
                 F.lit(tb).alias("b2"), F.lit(radius).alias("radius"), F.lit(family).cast("string").alias("family"))
        for i, (t, tl, ta, tb, radius, _, family) in enumerate(vocabulary, start=1)])
    measured = F.array(*[
        F.struct(F.lit(i).alias("nth"), F.col(cl).alias("l1"), F.col(ca).alias("a1"), F.col(cb).alias("b1"))
        for i, (cl, ca, cb, _) in enumerate(colours)])
    wide = (readings.select(key, F.explode(measured).alias("m")).select(key, "m.*").filter("l1 is not null")
            .select("*", F.explode(terms).alias("t")).select(key, "nth", "l1", "a1", "b1", "t.*"))
    hits = with_delta_e(wide, ("l1", "a1", "b1"), ("l2", "a2", "b2")).filter("delta_e <= radius")
    grouped = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        "nth", F.round("delta_e", 6).alias("distance"), "ord", "term", "family"))).alias("every"))
    # Per colour the first `limit` of its own sorted hits.
    own = [F.slice(F.filter("every", _is_nth(i)), 1, limit)
           for i, (_, _, _, limit) in enumerate(colours)]
    spoken = F.flatten(F.transform("hits", lambda t: F.filter(F.array(t["term"], t["family"]), lambda w: w.isNotNull())))
    return grouped.select(key, F.concat(*own).alias("hits")).withColumn("words", F.array_distinct(spoken))


def _is_nth(i: int) -> Callable[[Column], Column]:
    return lambda h: h["nth"] == i


def hex_of(r: Column, g: Column, b: Column) -> Column:
    """``#rrggbb`` of three real channels: clamped to 0..255, halves rounded to even."""

    def two(c: Column) -> Column:
        byte = F.bround(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)), 0).cast("int")
        return F.lpad(F.hex(byte), 2, "0")

    return F.lower(F.concat(F.lit("#"), two(r), two(g), two(b)))


def centre_box(w: Column, h: Column, fraction: float = 0.4) -> Column:
    """The middle ``fraction`` of each axis as (left, top, right, bottom), by integer arithmetic."""
    half_w = F.floor(w * fraction / 2).cast("int")
    half_h = F.floor(h * fraction / 2).cast("int")
    cx, cy = F.floor(w / 2).cast("int"), F.floor(h / 2).cast("int")
    return F.struct((cx - half_w).alias("left"), (cy - half_h).alias("top"),
                    (cx + half_w).alias("right"), (cy + half_h).alias("bottom"))


def inset_box(left: Column, top: Column, right: Column, bottom: Column,
              inset: float = 0.18, bottom_limit: float = 0.62) -> Column:
    """A sampling box kept off a tile's edges and out of its lower part."""
    w, h = right - left, bottom - top
    dx = F.floor(w * inset).cast("int")
    return F.struct((left + dx).alias("left"), (top + F.floor(h * inset).cast("int")).alias("top"),
                    (right - dx).alias("right"), (top + F.floor(h * bottom_limit).cast("int")).alias("bottom"))


assert math.isclose(WHITE[0], 0.95045593, rel_tol=1e-6)
