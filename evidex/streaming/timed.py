"""Streams whose state waits: for another attempt, for the end of a day, for an item that is named before it is known.

The processor classes live inside functions so that they reach the workers by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators.snapshots import FAILED, RETRIED, status_outcome
from evidex.streaming.keyed import _dealt, _reader


def fetch_stream(attempts: DataFrame, patience_s: int = 600, late: str = "1 minute") -> DataFrame:
    """(url, fetch_no, attempts, outcome) of every fetch, once it is over.

    ``attempts`` has ``url, fetch_no, attempt, status, at``. An attempt that is not retried settles its fetch at once. A retried one opens a
    timer; if no later attempt has come when the watermark passes ``patience_s`` behind it, it was the last, and the fetch has failed. An
    attempt that comes after its fetch was settled, or behind a later attempt, changes nothing; settled fetches are forgotten as long after.
    """
    from pyspark.sql.streaming import StatefulProcessor

    retried, failed, patience = RETRIED, FAILED, 1000 * patience_s

    class Fetches(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.seen = handle.getMapState("seen", "fetch_no int", "attempt int, due bigint, settled boolean")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            out = []
            for frame in rows:
                last = frame.loc[frame.groupby("fetch_no")["attempt"].idxmax()]
                for no, attempt, outcome, ms in zip(last["fetch_no"].tolist(), last["attempt"].tolist(), last["outcome"].tolist(), last["ms"].tolist(), strict=True):
                    held = self.seen.getValue((no,)) if self.seen.containsKey((no,)) else None
                    if held is not None and (held[2] or held[0] >= attempt):
                        continue
                    due, settled = ms + patience, outcome != retried
                    if settled:
                        out.append((key[0], no, attempt, outcome))
                    self.seen.updateValue((no,), (attempt, due, settled))
                    self.handle.registerTimer(due)
            if out:
                yield pd.DataFrame(out, columns=["url", "fetch_no", "attempts", "outcome"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            now = expiredTimerInfo.getExpiryTimeInMs()
            over = [(no[0], *held) for no, held in self.seen.iterator() if held[1] <= now]
            for no, *_ in over:
                self.seen.removeKey((no,))
            out = [(key[0], no, attempt, failed) for no, attempt, _, settled in over if not settled]
            if out:
                yield pd.DataFrame(out, columns=["url", "fetch_no", "attempts", "outcome"])

        def close(self):
            pass

    timed = attempts.withWatermark("at", late).select(
        "url", "fetch_no", "attempt", status_outcome(F.col("status")).alias("outcome"), F.unix_millis("at").alias("ms"), "at")
    return timed.groupBy("url").transformWithStateInPandas(
        statefulProcessor=Fetches(), outputStructType="url string, fetch_no int, attempts int, outcome string", outputMode="Append", timeMode="EventTime")


def alert_stream(found: DataFrame, late: str = "9 days") -> DataFrame:
    """The first sighting of every issue on a day, as it arrives; what comes later than ``late`` behind the newest is dropped.

    State is one key an issue and day and goes when the watermark has passed.
    """
    return (found.withWatermark("at", late).withColumn("day", F.to_date("at"))
            .dropDuplicatesWithinWatermark(["maker_id", "kind", "subject", "day"]).select("maker_id", "kind", "subject", "day"))


def link_stream(evidence: DataFrame, items: DataFrame) -> DataFrame:
    """(ev_id, item_id, base_code, linked_item): evidence that names a base code, linked when both are known, in whichever order they come.

    ``evidence`` has ``ev_id, item_id, maker_id, base_code``, ``items`` ``item_id, maker_id, code``. Both are one stream of makers' codes, dealt to groups as in ``keyed``: a
    call serves all codes of a group. Evidence waits in parts under its code, one a micro-batch, without a time bound; the item, once it is there, releases them and links
    what follows. An item is never its own base.
    """
    from pyspark.sql.streaming import StatefulProcessor

    held_of = _reader()

    class Links(StatefulProcessor):
        def init(self, handle):
            self.base = handle.getMapState("base", "name string", "item_id bigint")
            self.parts = handle.getMapState("parts", "name string", "n int")
            self.waiting = handle.getMapState("waiting", "name string, part int", "held string")

        def handleInputRows(self, key, rows, timerValues):
            import json

            import pandas as pd

            def linked(ev, item, code, base):
                out = pd.DataFrame({"ev_id": ev, "item_id": item, "base_code": code, "linked_item": base})
                return out[out["item_id"] != out["linked_item"]]

            batch = pd.concat(list(rows), ignore_index=True)
            name, known = batch["key_name"], batch["ev_id"].isna()
            bases = {n: entry[0] for n, entry in held_of(self.base, name.unique()).items()}
            found = {n: int(item) for n, item in batch["item_id"][known].groupby(name[known]).min().items() if n not in bases}
            named = batch[~known]
            late = named[~named["key_name"].isin({*bases, *found})]
            parts = {n: entry[0] for n, entry in held_of(self.parts, [*found, *late["key_name"].unique()]).items()}
            codes = dict(zip(name, batch["code"], strict=True))
            for n, item in found.items():
                bases[n] = item
                self.base.updateValue((n,), (item,))
                for part in range(parts.get(n, 0)):
                    yield linked(*json.loads(self.waiting.getValue((n, part))[0]), codes[n], item)
                    self.waiting.removeKey((n, part))
                if n in parts:
                    self.parts.removeKey((n,))
            now = named[named["key_name"].isin(bases)]
            if len(now):
                yield linked(now["ev_id"].to_numpy(), now["item_id"].to_numpy(), now["code"].to_numpy(), [bases[n] for n in now["key_name"]])
            for n, wait in late.groupby("key_name"):
                part = parts.get(n, 0)
                self.waiting.updateValue((n, part), (json.dumps([wait["ev_id"].tolist(), wait["item_id"].tolist()]),))
                self.parts.updateValue((n,), (part + 1,))

        def close(self):
            pass

    both = (evidence.filter("base_code is not null and base_code <> ''").select("maker_id", F.col("base_code").alias("code"), "ev_id", "item_id")
            .unionByName(items.filter("code is not null and item_id is not null").select("maker_id", "code", F.lit(None).cast("string").alias("ev_id"), "item_id")))
    named = both.select(F.concat(F.coalesce(F.col("maker_id").cast("string"), F.lit("")), F.lit(":"), F.col("code")).alias("named"), "code", "ev_id", "item_id")
    return _dealt(named, "named").transformWithStateInPandas(
        statefulProcessor=Links(), outputStructType="ev_id string, item_id bigint, base_code string, linked_item bigint", outputMode="Append", timeMode="None")
