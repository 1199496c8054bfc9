"""Evidence: roll-ups per item, listings, resolution, links and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.vocabulary import ROLE_PRIORITY


def role_priority(role: Column, ladder: dict[str, int] = ROLE_PRIORITY) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, rank in ladder.items():
        out = out.when(role == name, F.lit(rank))
    return out.otherwise(F.lit(len(ladder)))


def hero_columns() -> list[Column]:
    """The picture and the colour that stand for an item.

    The colour skips rows without one and only prefers the plain swatch, so it can come from another
    row than the picture. ``min_by`` is combined map-side: a hot item costs one row a task.
    """
    role, ev = F.col("role"), F.col("ev_id")
    picture = F.struct(role_priority(role), ev, F.col("source_url"))
    colour = F.struct(F.when(role == "label_chip", 0).otherwise(1), ev, F.col("hex"))
    return [
        F.min_by("source_url", picture).alias("hero_source_url"),
        F.min_by("storage_path", picture).alias("hero_storage_path"),
        F.min_by("hex", F.when(F.col("hex").isNotNull(), colour)).alias("hero_hex"),
    ]


def count_columns() -> list[Column]:
    """Coat levels seen (a set bounded by its vocabulary) and layered rows."""
    return [
        F.size(F.collect_set("coat")).cast("bigint").alias("coat_levels"),
        F.count_if(F.col("layered_over").isNotNull()).alias("layering_count"),
    ]


def roll_up(evidence: DataFrame, clays: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """One row per item: hero, counts, and the clays it was photographed on.

    ``only`` (a page of items) is semi-joined first, so the fact side shrinks before it is shuffled.
    Clay labels are joined after distinct (item, clay) pairs are formed, never per evidence row.
    """
    if only is not None:
        evidence = evidence.join(only.select("item_id"), "item_id", "left_semi")
    core = evidence.groupBy("item_id").agg(*hero_columns(), *count_columns())
    names = (evidence.filter("clay is not null").select("item_id", "clay").distinct()
             .join(clays.select("clay", "clay_name"), "clay")
             .groupBy("item_id").agg(F.array_sort(F.collect_set("clay_name")).alias("clay_bodies_shown")))
    return core.join(names, "item_id", "left")


def with_rollup(page: DataFrame, rolled: DataFrame) -> DataFrame:
    """Add the roll-up to a page; items without evidence keep zero counts and an empty label set."""
    return (page.join(rolled, "item_id", "left")
            .withColumns({
                "coat_levels": F.coalesce("coat_levels", F.lit(0).cast("bigint")),
                "layering_count": F.coalesce("layering_count", F.lit(0).cast("bigint")),
                "clay_bodies_shown": F.coalesce("clay_bodies_shown", F.array().cast("array<string>")),
            }))


def link_bases(evidence: DataFrame, items: DataFrame) -> DataFrame:
    """Second pass: resolve each row's stated base code to an item of the same maker.

    Never to itself, never over a link that is already set; a base that is not there stays null.
    """
    subject = items.select("item_id", "maker_id")
    base = items.select(F.col("item_id").alias("__base_id"), "maker_id", F.col("code").alias("base_code"))
    # Only rows that state a base travel; the lookup is one pass over distinct (item, base) pairs.
    wanted = (evidence.filter("base_code is not null and base_code <> ''")
              .select("item_id", "base_code").distinct())
    links = (wanted.join(subject, "item_id").join(base, ["maker_id", "base_code"])
             .filter("__base_id <> item_id").select("item_id", "base_code", "__base_id"))
    out = evidence.join(links, ["item_id", "base_code"], "left")
    if "linked_item" in evidence.columns:
        out = out.withColumn("linked_item", F.coalesce("linked_item", "__base_id")).drop("__base_id")
    else:
        out = out.withColumnRenamed("__base_id", "linked_item")
    return out


def resolve(facts: DataFrame, column: str, vocabulary: DataFrame, key: str, value: str, out: str,
            scope: str | None = None) -> DataFrame:
    """Raw value -> vocabulary id, within one maker when ``scope`` names the column."""
    entries = vocabulary.select(F.col(key).alias(column), F.col(value).alias(out), *([scope] if scope else []))
    return facts.join(entries, [column, scope] if scope else [column], "left")


def unresolved(facts: DataFrame, pairs: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """Issue rows (kind, value) for raw values no vocabulary knew; ``pairs`` is kind -> (raw, id)."""
    entries = F.array(*[
        F.when(F.col(raw).isNotNull() & F.col(found).isNull(),
               F.struct(F.lit(kind).alias("kind"), F.col(raw).cast("string").alias("value")))
        for kind, (raw, found) in pairs.items()])
    return facts.select(*keep, F.inline(F.filter(entries, lambda e: e.isNotNull())))


def scope_violations(evidence: DataFrame, items: DataFrame, vocabulary: DataFrame, child: str) -> DataFrame:
    """Evidence naming a vocabulary entry of another maker than its item's."""
    pairs = evidence.filter(F.col(child).isNotNull()).groupBy("item_id", child).agg(F.count(F.lit(1)).alias("n_rows"))
    return (pairs.join(items.select("item_id", F.col("maker_id").alias("item_maker")), "item_id")
            .join(vocabulary.select(child, F.col("maker_id").alias("entry_maker")), child)
            .filter(~F.col("item_maker").eqNullSafe(F.col("entry_maker"))))


def sections(evidence: DataFrame) -> DataFrame:
    """Display sections, a row possibly in several; an unsplit composite shows only where no coats do.

    The per-item "has coats" flag is an aggregate joined back, not a whole-item window. Of several
    unsplit composites the first is shown.
    """
    flags = evidence.groupBy("item_id").agg(
        F.bool_or(F.col("coat").isNotNull()).alias("__has_coat"),
        F.min(F.when(F.col("role") == "coats_composite", F.col("ev_id"))).alias("__first_composite"))
    rows = evidence.join(flags, "item_id")
    composite = F.col("role") == "coats_composite"
    named = {
        "coats": F.col("coat").isNotNull(),
        "unsplit": ~F.col("__has_coat") & composite & (F.col("ev_id") == F.col("__first_composite")),
        "on_clay": F.col("clay").isNotNull(),
        "layered": F.col("layered_over").isNotNull(),
        "plain": F.col("coat").isNull() & F.col("clay").isNull() & F.col("layered_over").isNull()
        & (F.col("role") != "line_chart") & ~(~F.col("__has_coat") & composite),
    }
    names = F.array(*[F.when(cond, F.lit(name)) for name, cond in named.items()])
    return rows.select(*evidence.columns, F.explode(F.filter(names, lambda n: n.isNotNull())).alias("section"))


def fan_out(images: DataFrame, order: list[str]) -> DataFrame:
    """One row per measured region, or one per image without regions; excluded roles yield none.

    A region's ordinal picks its label from ``order``; the label is null when there are too few.
    """
    labels = F.array(*[F.lit(x) for x in order])
    return (images.filter("role <> 'line_chart'")
            .select("*", F.posexplode_outer("regions").alias("region_no", "region"))
            .withColumn("coat_label", F.try_element_at(labels, F.col("region_no") + 1)))


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Rewrite the children of every incoming parent; other parents keep theirs."""
    kept = existing.join(incoming.select(parent).distinct(), parent, "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def carry_forward(incoming: DataFrame, existing: DataFrame, keys: list[str], measured: list[str]) -> DataFrame:
    """A text-only re-run keeps what was measured before, image by image (``keys``).

    Where no new row of an image measured anything but old rows did, the image keeps as many rows as it has
    measured old ones, each with the facts of the new row (of several, the least). All other new rows stay as they are.
    """
    any_measured = F.coalesce(*[F.col(c).cast("string") for c in measured]).isNotNull()
    old = existing.filter(any_measured).select(*keys, *measured)
    facts = [c for c in incoming.columns if c not in (*keys, *measured)]
    images = incoming.groupBy(*keys).agg(F.bool_or(any_measured).alias("__measured"), F.min(F.struct(F.lit(0).alias("__"), *facts)).alias("__facts"))
    carried = images.filter("not __measured").join(old, keys).select(*keys, *measured, *[F.col("__facts")[c].alias(c) for c in facts])
    stay = incoming.join(carried.select(*keys).distinct(), keys, "left_anti")
    return stay.unionByName(carried).select(*incoming.columns)
