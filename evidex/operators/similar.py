"""Items like a given item: the k best by shared features, for every anchor at once.

Items with equal features are one profile, which keeps its first k + 1 items in (code, id) order and is asked once. A profile
reads the lists of its own features in falling weight (the shorter list first): who shares none of those read so far shares at most
the weight of the rest. Once its k-th score is above that, nothing unread can enter, and it stops; profiles that go on read the next lists
in another round, half as many again as before. A pair is scored at its first shared list only. Lists that many profiles share are cut by their count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.operators.ordered import top_per_key
from evidex.session import spread, stored
from evidex.vocabulary import SIMILARITY_WEIGHTS

#: Profiles of one list in one shard.
SHARD_ROWS = 10_000
#: Weights are below this.
_WEIGHTS = 1024
#: Features with a weight of their own kind, besides the words.
KINDS = ("surface", "opacity", "line")


def features(items: DataFrame, terms: str = "terms", weights: dict[str, int] = SIMILARITY_WEIGHTS) -> DataFrame:
    """(item_id, code, features): sorted (kind, value, weight) structs; what is not stated is not a feature."""
    def one(kind: str, value) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(weights[kind]).alias("weight"))

    words = F.transform(F.array_distinct(F.coalesce(F.col(terms), F.array().cast("array<string>"))), lambda t: one("term", t))
    scalars = F.array(*[F.when(F.col(kind).isNotNull(), one(kind, F.col(kind))) for kind in KINDS])
    every = F.filter(F.concat(words, scalars), lambda f: f.isNotNull() & f["value"].isNotNull())
    return items.select("item_id", "code", F.array_sort(every).alias("features"))


def _weight(shared: Column) -> Column:
    return F.aggregate(shared, F.lit(0), lambda acc, code: acc + (code % _WEIGHTS).cast("int"))


def _profiles(described: DataFrame, k: int, shard_rows: int) -> tuple[DataFrame, DataFrame]:
    """(profiles with their features in reading order and their first items, the lists of all features).

    A feature is a number there, with its weight in the last places, so that pairs are scored on arrays of numbers.
    """
    first = top_per_key(described, ["features"], [F.col("code"), F.col("item_id")], k + 1, "place")
    held = first.groupBy("features").agg(F.collect_list(F.struct("code", "item_id")).alias("held"))
    # Numbered once and stored, so the numbers do not depend on when they are read.
    numbered = stored(held.withColumn("profile", F.monotonically_increasing_id()), "profiles")
    single = numbered.select("profile", F.explode("features").alias("f"))
    counts = single.groupBy("f").agg(F.count(F.lit(1)).alias("n")).withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int"))
    counts = stored(counts.withColumn("number", F.monotonically_increasing_id() * _WEIGHTS + F.col("f.weight")), "feature-counts")
    order = single.join(counts, "f").groupBy("profile").agg(F.array_sort(F.collect_list(F.struct((-F.col("f.weight")).alias("less"), "n", "number", "shards"))).alias("reading"))
    whole = numbered.join(order, "profile").withColumn("numbers", F.transform("reading", lambda r: r["number"]))
    whole = stored(whole, "readings")
    shard = F.pmod(F.xxhash64("profile"), F.col("r.shards")).cast("int").alias("shard")
    lists = whole.select("held", F.col("numbers").alias("others"), "profile", F.explode("reading").alias("r")).select(F.col("r.number").alias("number"), shard, "others", "held")
    return whole, lists


def _first_items(found: DataFrame, k: int) -> DataFrame:
    return top_per_key(found, ["profile"], [F.desc("score"), F.col("code"), F.col("item_id")], k + 1, "nth").drop("nth")


def similar_items(items: DataFrame, k: int = 12, anchors: DataFrame | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(anchor_id, item_id, score, position), best first by (score desc, code, id); zero scores never appear."""
    described = features(items).filter(F.size("features") > 0)
    asking = described if anchors is None else described.join(anchors.select("item_id"), "item_id", "left_semi")
    profiles, lists = _profiles(described, k, shard_rows)
    longest = profiles.agg(F.max(F.size("features"))).first()[0] or 0
    mine = profiles.select("profile", "features", "numbers", "reading")
    open_ = mine if anchors is None else mine.join(asking.select("features").distinct(), "features", "left_semi")
    best, done, start, end = None, [], 0, 1
    while start < longest:
        found = _read(open_, lists, start, end, k)
        best = stored(_first_items(found if best is None else found.unionByName(best.join(open_.select("profile"), "profile", "left_semi")), k), "best")
        rest = F.aggregate(F.slice("reading", end + 1, longest), F.lit(0), lambda acc, r: acc - r["less"])
        kth = best.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        judged = open_.join(kth, "profile", "left")
        over = (F.size("reading") <= end) | (F.coalesce("n", F.lit(0)) > k) & (F.col("least") > rest)
        done.append(best.join(judged.filter(over).select("profile"), "profile", "left_semi"))
        open_ = stored(judged.filter(~F.coalesce(over, F.lit(False))).select("profile", "features", "numbers", "reading"), "open")
        if open_.isEmpty():
            break
        start, end = end, end + max(1, end // 2)
    every = done[0] if done else None
    for more in done[1:]:
        every = every.unionByName(more)
    if every is None:
        return items.sparkSession.createDataFrame([], "anchor_id long, item_id long, score int, position int")
    answers = every.groupBy("profile").agg(F.collect_list(F.struct("score", "code", "item_id")).alias("held"))
    pairs = (asking.select(F.col("item_id").alias("anchor_id"), "features").join(profiles.select("profile", "features"), "features").join(answers, "profile")
             .select("anchor_id", F.explode("held").alias("h")).select("anchor_id", "h.item_id", "h.code", "h.score").filter("item_id <> anchor_id"))
    w = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "code", "item_id")
    return (pairs.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)
            .select("anchor_id", "item_id", F.col("score").cast("int").alias("score"), "position"))


def _read(open_: DataFrame, lists: DataFrame, start: int, end: int, k: int) -> DataFrame:
    """(profile, score, code, item_id) of what the profiles meet in their lists ``start`` to ``end``."""
    part = open_.select("profile", "numbers", F.posexplode(F.slice("reading", 1, end)).alias("at", "r")).filter(F.col("at") >= start)
    asked = part.select("profile", "numbers", F.col("r.number").alias("number"), F.slice("numbers", F.lit(1), F.col("at")).alias("before"), F.explode(F.sequence(F.lit(0), F.col("r.shards") - 1)).alias("shard"))
    met = spread(asked, "number", "shard").join(lists, ["number", "shard"]).filter(~F.arrays_overlap("before", "others"))
    scored = met.select("profile", _weight(F.array_intersect("numbers", "others")).alias("score"), F.explode("held").alias("h"))
    return _first_items(scored.select("profile", "score", "h.code", "h.item_id"), k)
