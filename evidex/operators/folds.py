"""Folds of event logs: marks, monotone status, debounce, latest-wins, covers.

All of them are order-sensitive per key and therefore built on sliced scans and combinable
aggregates: a key with a third of all events is never one task's work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.operators.ordered import ordered_scan, time_slice

# --- fixed values: stages, the status each leads to (a free note leads to none), and their order ---
STAGE_STATUS = {"throwing": "in_progress", "trimming": "in_progress", "greenware": "in_progress", "bisque": "bisqued",
                "glazing": "glazed", "firing": "glazed", "finished": "finished"}
STATUS_ORDER = ["in_progress", "bisqued", "glazed", "finished"]


def mark_fold(log: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """Current marks from (key, us, event_id, action, note) events.

    A clear forgets everything before it; the last own/wish sets the state; going to the wishlist
    clears the favourite and keeps the note; a toggle counts only while owned; a note counts only
    where a mark exists, and a blank note is no note.

    Each rule asks what the last own, wish or clear before an event was, and whether a clear or wish came later: one scan
    gives both, and the fold is combinable maxima and counts.
    """
    at, action = F.struct("us", "event_id"), F.col("action")
    is_set = action.isin("own", "wish")
    rows = log.select("key", "us", "event_id", "action", "note", at.alias("at"), F.when(is_set | (action == "clear"), action).alias("sets"),
                      F.when(action == "clear", at).alias("clear_at"), F.when(action.isin("clear", "wish"), at).alias("reset_at"))
    live = ordered_scan(rows, ["key"], ["us", "event_id"], time_slice("us", slice_seconds), {
        "__was": ("prior_last", "sets"), "__cleared": ("total_max", "clear_at"), "__reset": ("total_max", "reset_at")})
    live = live.filter((action != "clear") & (F.col("__cleared").isNull() | (F.col("at") > F.col("__cleared"))))
    # Owned without interruption since: after the last wish, and with an own before it.
    toggled = (action == "toggle") & (F.col("__was") == "own") & (F.col("__reset").isNull() | (F.col("at") > F.col("__reset")))
    noted = (action == "note") & F.col("__was").isin("own", "wish")
    folded = live.groupBy("key").agg(
        F.max_by("action", F.when(is_set, F.col("at"))).alias("last_set"),
        F.count_if(toggled).alias("toggles"),
        F.max_by(F.struct(F.nullif(F.trim("note"), F.lit("")).alias("v")), F.when(noted, F.col("at"))).alias("last_note"),
        F.max(F.when(is_set | toggled | noted, F.col("us"))).alias("updated_us"))
    owned_now = F.col("last_set") == "own"
    return folded.filter("last_set is not null").select(
        "key", F.when(owned_now, "owned").otherwise("wishlist").alias("state"),
        (owned_now & (F.col("toggles") % 2 == 1)).alias("favorite"), F.col("last_note.v").alias("note"), "updated_us")


def mark_lists(marks: DataFrame) -> DataFrame:
    """(key, list): the lists that every mark is on, in one pass."""
    rules = {"wishlist": F.col("state") == "wishlist", "owned": F.col("state") == "owned", "favorite": F.col("favorite")}
    named = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])
    return marks.select("key", F.explode(F.filter(named, lambda n: n.isNotNull())).alias("list"))


def rekey_marks(old: DataFrame, maker: str) -> DataFrame:
    """Old-shape marks (code, owned, favorite flags) to (maker, code) rows with one state."""
    return old.select(F.lit(maker).alias("maker"), "code", F.when(F.col("owned"), "owned").otherwise("wishlist").alias("state"),
                      (F.col("favorite") & F.col("owned")).alias("favorite"), "name", "updated_ms", F.lit(None).cast("string").alias("note"))


def _rank_of(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(STATUS_ORDER):
        out = F.when(status == name, i).otherwise(out)
    return out


def status_progress(log: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """Status after every stage of a piece: it only moves forward, and notes never move it."""
    table = F.create_map(*[F.lit(x) for pair in STAGE_STATUS.items() for x in pair])
    ranked = log.withColumn("__rank", F.coalesce(_rank_of(F.try_element_at(table, F.col("stage"))), F.lit(0)))
    run = ordered_scan(ranked, ["piece"], ["us", "event_id"], time_slice("us", slice_seconds), {"__best": ("running_max", "__rank")})
    names = F.array(*[F.lit(s) for s in STATUS_ORDER])
    return run.withColumn("status", F.element_at(names, F.col("__best") + 1)).drop("__rank", "__best")


def cover_pick(log: DataFrame) -> DataFrame:
    """The first photo of the newest entry that has one, per piece."""
    newest = F.struct("us", "event_id")
    return log.groupBy("piece").agg(F.max_by("photo", F.when(F.col("photo").isNotNull(), newest)).alias("cover"))


def debounce(requests: DataFrame, keys: Sequence[str], gap_us: int, slice_seconds: int = 86_400) -> DataFrame:
    """Requests nothing newer follows within the gap."""
    seen = ordered_scan(requests, keys, ["us", "event_id"], time_slice("us", slice_seconds), {"__next": ("lead", "us")})
    return seen.filter(F.col("__next").isNull() | (F.col("__next") - F.col("us") >= gap_us)).drop("__next")


def latest_wins(arrivals: DataFrame, keys: Sequence[str], slice_seconds: int = 86_400) -> DataFrame:
    """Results whose ticket is not older than any that arrived before."""
    seen = ordered_scan(arrivals, keys, ["us", "event_id"], time_slice("us", slice_seconds), {"__newest": ("running_max", "ticket")})
    return seen.filter(F.col("ticket") == F.col("__newest")).drop("__newest")
