"""Closed vocabularies.

Every value below is a fixed value: it must equal the catalog contract's own for results to be
right. All tables here are constants of at most a few dozen rows, which is what makes it safe to
broadcast them or to embed them in an expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.session import literal_table

# --- fixed values: ordered firing scale, coolest first; the position is the ordinal -------------
CONE_NAMES = (
    [f"0{n}" for n in range(22, 9, -1)]
    + [f"0{n}" for n in range(9, 0, -1)]
    + [str(n) for n in range(1, 15)]
)
LOWEST_ORDINAL = 1
HIGHEST_ORDINAL = len(CONE_NAMES)
OPEN_END = 32767

# --- fixed values: (id, key, name) ---------------------------------------------------------------
SURFACES = [(1, "gloss", "Gloss"), (2, "satin", "Satin"), (3, "matte", "Matte")]
OPACITIES = [(1, "opaque", "Opaque"), (2, "translucent", "Translucent"),
             (3, "transparent", "Transparent")]
COATS = [(1, "light", "Light coat"), (2, "slightly_light", "Slightly light coat"),
         (3, "slightly_heavy", "Slightly heavy coat"), (4, "heavy", "Heavy coat")]
#: (key, is_flat)
FORMS = [("flat_tile", True), ("textured_tile", True), ("cup", False), ("bowl", False),
         ("mug", False), ("plate", False), ("vase", False), ("basket", False), ("other", False)]
#: Clay numbers the first source sells; a number outside this set is never a clay.
CLAY_NUMBERS = [11, 16, 25, 30, 32, 38, 46, 67, 77]

# --- fixed values: (term, L, a, b, radius, is_specialised, family) -------------------------------
COLOR_TERMS = [
    ("white", 95.0, 0.0, 0.0, 26.0, False, None),
    ("black", 16.0, 0.0, 0.0, 24.0, False, None),
    ("grey", 55.0, 0.0, 0.0, 20.0, False, None),
    ("cream", 92.0, 1.0, 14.0, 20.0, False, "white"),
    ("red", 45.0, 62.0, 42.0, 26.0, False, None),
    ("orange", 63.0, 40.0, 60.0, 24.0, False, None),
    ("yellow", 86.0, -5.0, 80.0, 26.0, False, None),
    ("green", 52.0, -45.0, 32.0, 28.0, False, None),
    ("teal", 52.0, -30.0, -8.0, 22.0, False, "blue"),
    ("turquoise", 70.0, -35.0, -8.0, 22.0, False, "blue"),
    ("blue", 42.0, 8.0, -48.0, 28.0, False, None),
    ("purple", 38.0, 38.0, -34.0, 24.0, False, None),
    ("pink", 75.0, 30.0, 6.0, 22.0, False, None),
    ("brown", 38.0, 16.0, 26.0, 24.0, False, None),
    ("tan", 70.0, 8.0, 24.0, 20.0, False, "brown"),
    ("celadon", 72.0, -14.0, 8.0, 16.0, True, "green"),
    ("sage", 66.0, -14.0, 14.0, 16.0, True, "green"),
    ("oribe", 48.0, -34.0, 26.0, 15.0, True, "green"),
    ("cobalt", 32.0, 18.0, -52.0, 16.0, True, "blue"),
    ("indigo", 30.0, 6.0, -30.0, 16.0, True, "blue"),
    ("tenmoku", 24.0, 12.0, 16.0, 15.0, True, "brown"),
    ("temmoku", 24.0, 12.0, 16.0, 15.0, True, "brown"),
    ("oxblood", 30.0, 46.0, 24.0, 15.0, True, "red"),
    ("amber", 62.0, 22.0, 54.0, 16.0, True, "orange"),
    ("ochre", 58.0, 14.0, 46.0, 16.0, True, "yellow"),
    ("rust", 44.0, 34.0, 38.0, 16.0, True, "brown"),
    ("iron red", 42.0, 40.0, 32.0, 15.0, True, "red"),
    ("shino", 68.0, 14.0, 30.0, 16.0, True, "orange"),
    ("lavender", 68.0, 16.0, -20.0, 16.0, True, "purple"),
    ("slate", 46.0, -2.0, -8.0, 16.0, True, "grey"),
]

# --- fixed values: weights and floors of ranked search -------------------------------------------
FIELD_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
NAME_SIMILARITY_FLOOR = 0.25
CODE_SIMILARITY_FLOOR = 0.30
MATCH_RANK_FLOOR = 0.02
PAGE_SIZE = 40
#: similarity weights per shared feature
SIMILARITY_WEIGHTS = {"term": 3, "surface": 2, "opacity": 2, "line": 1}
#: display priority of an evidence role; anything else comes after
ROLE_PRIORITY = {"label_chip": 0, "coats_composite": 1}
#: the same for the rows of a detail page
DETAIL_PRIORITY = ROLE_PRIORITY | {"layered": 2}


def cones(spark: SparkSession) -> DataFrame:
    rows = [(i, name) for i, name in enumerate(CONE_NAMES, start=1)]
    return F.broadcast(literal_table(spark, "ordinal int, cone string", rows))


def surfaces(spark: SparkSession) -> DataFrame:
    return F.broadcast(
        literal_table(spark, "surface int, surface_key string, surface_name string", SURFACES))


def opacities(spark: SparkSession) -> DataFrame:
    return F.broadcast(
        literal_table(spark, "opacity int, opacity_key string, opacity_name string", OPACITIES))


def coats(spark: SparkSession) -> DataFrame:
    return F.broadcast(
        literal_table(spark, "coat int, coat_key string, coat_name string", COATS))


def color_terms(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(COLOR_TERMS, start=1)]
    return F.broadcast(literal_table(
        spark,
        "ord int, term string, l double, a double, b double, radius double, "
        "specialised boolean, family string",
        rows))


def sql_values(rows: list[tuple]) -> str:
    """The same constants as a VALUES list, for the SQL oracles."""
    def one(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"
