"""Trigram similarity joins through an inverted index.

Exact prefix filtering (Chaudhuri et al. 2006; Bayardo et al. 2007): grams are ordered rarest
first, and two strings above the threshold must share one of each side's first
``n - ceil(t * n) + 1`` grams. Common grams therefore rarely reach the index, where they meet says how much they can
share at most (Xiao et al. 2008), and candidates are verified on the gram arrays themselves. Equal texts are compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.functions.text import trigrams
from evidex.session import spread, stored

#: Texts under one gram in one part.
GRAM_ROWS = 20_000


def gram_table(texts: DataFrame, text: str) -> DataFrame:
    """Distinct texts with their gram arrays; texts without a word are left out."""
    return (texts.select(F.col(text)).where(F.col(text).isNotNull()).distinct()
            .withColumn("grams", trigrams(F.col(text))).filter(F.size("grams") > 0))


def similar_texts(left: DataFrame, left_text: str, right: DataFrame, right_text: str, threshold: float) -> DataFrame:
    """(left text, right text, similarity) of every distinct pair strictly above ``threshold``."""
    both = gram_table(left, left_text).select(F.lit(0).alias("side"), F.col(left_text).alias("text"), "grams").unionByName(
        gram_table(right, right_text).select(F.lit(1).alias("side"), F.col(right_text).alias("text"), "grams"))
    grams = both.select("side", "text", F.explode("grams").alias("gram"))
    frequency = stored(grams.groupBy("gram").agg(F.count(F.lit(1)).alias("seen")).withColumn("number", F.monotonically_increasing_id()), "gram-counts")
    # Grams are numbers from here on, rarest first; written once, so that no pair splits its texts again.
    ordered = stored(grams.join(frequency, "gram").groupBy("side", "text")
                     .agg(F.array_sort(F.collect_list(F.struct("seen", "number"))).alias("o")).select("side", "text", F.col("o.number").alias("grams")), "gram-lists")
    size = F.size("grams")
    length = size - F.ceil(size * threshold).cast("int") + 1
    prefix = ordered.select("side", "text", "grams", F.posexplode(F.slice("grams", F.lit(1), length)).alias("at", "gram"))
    # A pair is taken where it first meets, so no more grams than follow there are shared.
    prefix = prefix.withColumn("n", size).withColumn("rest", size - F.col("at"))
    a = prefix.filter("side = 0").select("gram", F.col("text").alias("__a"), F.col("grams").alias("ga"), F.col("n").alias("m"), F.col("rest").alias("left"))
    b = prefix.filter("side = 1").select("gram", "n", "rest", F.col("text").alias("__b"), F.col("grams").alias("gb"))
    # Texts on the right stand in places by gram, length and rest; what is looked up comes only to places where enough can be shared. A place
    # that many texts have is cut by their number; what is looked up is repeated for each part.
    place = ["gram", "n", "rest"]
    places = b.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / GRAM_ROWS).cast("int").alias("parts"))
    least = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("m") + F.col("n")) - 1e-9)
    asked = (a.join(places, "gram").filter((F.col("n") >= F.col("m") * threshold) & (F.col("m") >= F.col("n") * threshold) & (F.least("left", "rest") >= least))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "m", "left"))
    filed = b.join(places, place).withColumn("part", F.pmod(F.xxhash64("__b"), F.col("parts")).cast("int")).drop("parts")
    # Each text is filed many times, which the planner's sizes do not know: neither side is sent to the driver.
    met = spread(asked, "__a", *place, "part").hint("merge").join(spread(filed, "__b", "gram"), [*place, "part"])
    return (met.select("__a", "__b", "gram", shared_grams("ga", "gb").alias("s")).filter(F.col("s.first") == F.col("gram")).select("__a", "__b", F.col("s.similarity").alias("similarity"))
            .filter(F.col("similarity") > threshold)
            .select(F.col("__a").alias(left_text), F.col("__b").alias(f"{right_text}_match"), "similarity"))


def shared_grams(left: str, right: str) -> Column:
    """(first, similarity) of two arrays of grams in one order. A pair is taken where its first shared gram is met, so it comes once."""
    return F.expr(f"""transform(array(array_intersect({left}, {right})), x -> named_struct(
        'first', x[0], 'similarity', size(x) / (size({left}) + size({right}) - size(x))))[0]""")
