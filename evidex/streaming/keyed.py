"""Per-key state machines over event streams.

State is one small row per key in the RocksDB store, a map entry of the group that the key is dealt to: a call of Python serves all keys
of a group that a micro-batch touches, in whole columns, and an entry is written only when it changed. A micro-batch is bounded by the trigger limit of
its source, and so is the part of a hot key a task sees at a time; only the columns the machine needs
travel to Python, never page bodies.

The processor classes live inside functions so that they reach the workers by value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.hashing import content_hash
from evidex.operators.snapshots import STORED, UNCHANGED, status_outcome


#: Groups that the keys of a stream are dealt to. Part of a stream's state: a checkpoint is read with the number it was written with.
GROUPS = 1024


def _dealt(log: DataFrame, key: str):
    """Rows with the key as ``key_name``, by group; rows without a key are a group of their own, so they do not change the type of other keys."""
    name = F.col(key).cast("string")
    group = F.when(name.isNull(), -1).otherwise(F.pmod(F.xxhash64(name), F.lit(GROUPS)).cast("int"))
    return log.select("*", F.coalesce(name, F.lit("")).alias("key_name"), group.alias("key_group")).groupBy("key_group")


def _reader():
    """A function, sent to the workers by value, that reads the entries of the named keys that have one."""
    def held(entries, names) -> dict:
        if not entries.exists():
            return {}
        found = {name: entries.getValue((name,)) for name in names}
        return {name: entry for name, entry in found.items() if entry is not None}

    return held


def change_stream(log: DataFrame, noise: Sequence[str] = ()) -> DataFrame:
    """Outcome of every fetch as it arrives: a 200 is compared with the last stored hash of its url."""
    from pyspark.sql.streaming import StatefulProcessor

    ok = F.col("status").between(200, 299)
    slim = log.select("url", "id", "fetched_s", "status", F.when(ok, content_hash(F.col("body"), noise)).alias("hash"),
                      F.when(~ok, status_outcome(F.col("status"))).alias("settled"))
    stored, unchanged = STORED, UNCHANGED

    held_of = _reader()

    class Detector(StatefulProcessor):
        def init(self, handle):
            self.held = handle.getMapState("held", "url string", "hash string")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            batch = pd.concat(list(rows)).sort_values(["key_name", "fetched_s", "id"]).reset_index(drop=True)
            name = batch["key_name"]
            held = {n: entry[0] for n, entry in held_of(self.held, name.unique()).items()}
            good = batch["hash"].notna()
            # the good fetch of the url before each row of the batch
            before = batch["hash"].where(good).groupby(name).shift().groupby(name).ffill()
            before = before.where(before.notna(), name.map(held)) if held else before
            outcome = batch["settled"].mask(good, stored).mask(good & (before == batch["hash"]), unchanged)
            for n, newest in batch["hash"][good].groupby(name[good]).last().items():
                if held.get(n) != newest:
                    self.held.updateValue((n,), (newest,))
            yield pd.DataFrame({"url": batch["url"], "id": batch["id"], "status": batch["status"], "outcome": outcome})

        def close(self):
            pass

    return _dealt(slim, "url").transformWithStateInPandas(
        statefulProcessor=Detector(), outputStructType="url string, id bigint, status int, outcome string",
        outputMode="Append", timeMode="None")


def latest_stream(arrivals: DataFrame, key: str) -> DataFrame:
    """Every result with ``stale``: whether a newer ticket of its key had arrived before.

    Fresh rows are the result; stale ones are the side output.
    """
    from pyspark.sql.streaming import StatefulProcessor

    held_of = _reader()

    class Newest(StatefulProcessor):
        def init(self, handle):
            self.best = handle.getMapState("best", "key string", "ticket bigint")

        def handleInputRows(self, keys, rows, timerValues):
            import numpy as np
            import pandas as pd

            batch = pd.concat(list(rows)).sort_values(["key_name", "us", "event_id"]).reset_index(drop=True)
            name = batch["key_name"]
            held = {n: entry[0] for n, entry in held_of(self.best, name.unique()).items()}
            floor = np.array([held.get(n, -(2**63)) for n in name], dtype="int64")
            best = batch["ticket"].groupby(name).cummax()
            best = best.where(~(best < floor), floor)
            for n, newest in best.groupby(name).max().dropna().items():
                if held.get(n) != int(newest):
                    self.best.updateValue((n,), (int(newest),))
            yield pd.DataFrame({key: batch[key], "event_id": batch["event_id"], "ticket": batch["ticket"], "stale": batch["ticket"] < best})

        def close(self):
            pass

    kind = arrivals.schema[key].dataType.simpleString()
    return _dealt(arrivals.select(key, "us", "event_id", "ticket"), key).transformWithStateInPandas(
        statefulProcessor=Newest(), outputStructType=f"{key} {kind}, event_id bigint, ticket bigint, stale boolean",
        outputMode="Append", timeMode="None")


def marks_stream(log: DataFrame) -> DataFrame:
    """The live list: the current mark of every key an event touched, one row per key and micro-batch.

    ``state`` is null once a mark is gone. ``seq`` grows with every emission of a key.
    """
    from pyspark.sql.streaming import StatefulProcessor

    held_of = _reader()

    class Marks(StatefulProcessor):
        def init(self, handle):
            self.mark = handle.getMapState("mark", "key string", "state string, favorite boolean, note string, seq bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            batch = pd.concat(list(rows)).sort_values(["key_name", "us", "event_id"]).reset_index(drop=True)
            name, action, at = batch["key_name"], batch["action"], batch.index.to_series()
            marks = held_of(self.mark, name.unique())
            first = name.map({n: {"owned": "own", "wishlist": "wish"}.get(m[0], "clear") for n, m in marks.items()}) if marks else "clear"
            sets = action.where(action.isin(["own", "wish", "clear"])).groupby(name).ffill()  # the last of them at every row
            sets = sets.where(sets.notna(), first).fillna("clear")

            def last(rows_of):
                """The place of the last such row of its key, -1 without one."""
                return at.where(rows_of, -1).groupby(name).transform("max")

            reset, clear = last(action.isin(["wish", "clear"])), last(action == "clear")
            noted = last((action == "note") & (sets != "clear") & (at > clear))
            toggles = ((action == "toggle") & (sets == "own") & (at > reset)).groupby(name).transform("sum")
            ends = batch.index[~name.duplicated(keep="last")]
            out = []
            for end in ends:
                _, favorite, note, seq = marks.get(name[end], (None, False, None, 0))
                favorite = (bool(favorite) and reset[end] < 0) != (toggles[end] % 2 == 1)
                note = (batch["note"][noted[end]] or "").strip() or None if noted[end] >= 0 else None if clear[end] >= 0 else note
                state = {"own": "owned", "wish": "wishlist", "clear": None}[sets[end]]
                out.append((state, bool(favorite), note, int(seq) + 1))
                self.mark.updateValue((name[end],), out[-1])
            found = pd.DataFrame(out, columns=["state", "favorite", "note", "seq"])
            found.insert(0, "key", batch["key"][ends].to_numpy())
            yield found

        def close(self):
            pass

    return _dealt(log.select("key", "us", "event_id", "action", "note"), "key").transformWithStateInPandas(
        statefulProcessor=Marks(), outputStructType="key bigint, state string, favorite boolean, note string, seq bigint",
        outputMode="Update", timeMode="None")


def debounce_stream(requests: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """The last request of every burst, once the watermark says the burst is over."""
    return (requests.withWatermark(ts, late)
            .groupBy(F.session_window(ts, gap), key)
            .agg(F.max_by("event_id", F.struct("us", "event_id")).alias("event_id"))
            .select(key, "event_id"))


