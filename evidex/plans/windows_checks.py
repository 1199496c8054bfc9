"""Window operators and ordered scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators import folds, ranges, snapshots
from evidex.operators.ordered import time_slice
from evidex.plans import sqltext as Q
from evidex.plans.aggregates_checks import words_of
from evidex.plans.registry import check
from evidex.plans.views import Catalog

#: noise the test pages carry on every fetch
NOISE = (r"<!-- sid:\d+ -->",)


@check("snapshot_scan", "select maker_id, status, count(*) n, sum(length(body)) chars from snapshots where maker_id in (1, 3) group by all", "snapshots")
def snapshot_scan(c: Catalog) -> DataFrame:
    from evidex.session import shared_dir
    from evidex.sources.tables import read_snapshots, write_snapshots

    path = shared_dir(c.spark, "snapshots")
    write_snapshots(c.snapshots, path)
    return read_snapshots(c.spark, path, [1, 3]).groupBy("maker_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("body")).alias("chars"))


@check("retention_prune", "select url, id from snapshots qualify row_number() over (partition by url order by fetched_s desc, id desc) > 2", "snapshots")
def retention_prune(c: Catalog) -> DataFrame:
    return snapshots.doomed(c.snapshots, keep=2).select("url", "id")


CHANGE_SQL = """with h as (select url, id, fetched_s, status, case when status = 200 then sha256(regexp_replace(body, '<!-- sid:[0-9]+ -->', '', 'g')) end hash from snapshots),
 g as (select *, lag(hash) over (partition by url order by fetched_s, id) before from h where hash is not null)
 select url, id, status, case when before = hash then 'unchanged' else 'stored' end outcome from g
 union all select url, id, status, case when status = 304 then 'unchanged' when status in (404, 410) then 'gone' when status >= 500 or status = 429 then 'retried' else 'failed' end from h where hash is null"""


@check("change_detect", CHANGE_SQL, "snapshots")
def change_detect(c: Catalog) -> DataFrame:
    return snapshots.outcomes(c.snapshots, NOISE).select("url", "id", "status", "outcome")


@check("fetch_outcomes", """select url || '#' || page_id url, cast(0 as integer) fetch_no, cast(1 + page_id % 4 as integer) attempts,
 case when page_id % 3 = 1 then 'gone' else 'failed' end outcome from pages""")
def fetch_outcomes(c: Catalog) -> DataFrame:
    """Retries of one fetch: every attempt but the last met a server error."""
    tries = c.table("pages").selectExpr("concat(url, '#', page_id) as url", "page_id", "explode(sequence(1, cast(1 + page_id % 4 as int))) as attempt").selectExpr(
        "url", "0 as fetch_no", "attempt",
        "case when attempt < 1 + page_id % 4 then 503 when page_id % 3 = 0 then 429 when page_id % 3 = 1 then 410 else 403 end as status")
    return snapshots.fetch_results(tries.withColumn("outcome", snapshots.status_outcome(F.col("status"))))


@check("color_terms_for", f"""with {Q.NAMED}, w as (select vec_id, nth, place, 0 sub, term word from nm union all select vec_id, nth, place, 1, family from nm where family is not null),
 f as (select vec_id, word, min({{'n': nth, 'p': place, 's': sub}}) first from w group by all)
 select vec_id, string_agg(word, ',' order by first) words from f group by vec_id""", "readings color_terms")
def color_terms_for(c: Catalog) -> DataFrame:
    return words_of(c).filter(F.size("hits") > 0).select("vec_id", F.array_join("words", ",").alias("words"))


def _hours(c: Catalog) -> DataFrame:
    return c.events.filter("event_type in ('view', 'click')").select("user_id", F.floor(F.col("us") / 3_600_000_000).alias("cell"))


_RUNS_SQL = """c as (select distinct user_id, us // 3600000000 cell from evs where event_type in ('view', 'click')),
 n as (select *, cell - row_number() over (partition by user_id order by cell) run from c),
 r as (select user_id, min(cell) first, max(cell) last, count(*) length from n group by user_id, run)"""


@check("dense_runs", f"with {_RUNS_SQL} select user_id, first, last, length from r qualify row_number() over (partition by user_id order by length desc, first) = 1", "evs")
def dense_runs(c: Catalog) -> DataFrame:
    return ranges.longest_run(ranges.runs(_hours(c), "user_id", "cell"), "user_id")


@check("dense_runs_all", """with c as (select distinct user_id, us // 3600000000 cell from evs),
 n as (select *, cell - row_number() over (partition by user_id order by cell) run from c)
 select user_id, min(cell) first, max(cell) last, count(*) length from n group by user_id, run""", "evs")
def dense_runs_all(c: Catalog) -> DataFrame:
    """Every run of hours with an event of any type; slices of a day make most runs cross one."""
    cells = c.events.select("user_id", F.floor(F.col("us") / 3_600_000_000).alias("cell"))
    return ranges.runs(cells, "user_id", "cell", slice_cells=24)


@check("widest_gap_cut", """with p as (select distinct user_id, us from evs), g as (select *, lead(us) over (partition by user_id order by us) - us gap from p),
 w as (select *, row_number() over (partition by user_id order by gap desc, us desc) rn from g where gap > 3600000000),
 c as (select user_id, list(us) cuts from w where rn <= 2 group by user_id having count(*) = 2),
 b as (select p.user_id, p.us, case when c.cuts is null then 0 else len([x for x in c.cuts if x < p.us]) end as block from p left join c on c.user_id = p.user_id)
 select user_id, cast(block as integer) as block, min(us) first, max(us) last, count(*) n from b group by all""", "evs")
def widest_gap_cut(c: Catalog) -> DataFrame:
    return ranges.cut_at_widest_gaps(c.events.select("user_id", "us"), ["user_id"], "us", 3_600_000_000, time_slice("us"))


@check("split_or_refuse", """with c as (select distinct user_id, us // 3600000000 // 6 cell from evs where event_type in ('view', 'click')),
 n as (select *, cell - row_number() over (partition by user_id order by cell) run from c),
 r as (select user_id, min(cell) first, max(cell) last from n group by user_id, run),
 s as (select user_id, min(first) lo, max(last) hi from r group by user_id),
 w as (select r.*, s.lo, s.hi, last - first + 1 width, last - first + 1 > (hi - lo + 1) * 0.04 counted from r join s on s.user_id = r.user_id),
 k as (select user_id, lo, hi, count(*) filter (counted) n, max(width) filter (counted) widest, min(width) filter (counted) narrowest from w group by all)
 select user_id, n = 3 and not widest - narrowest > 0.25 * widest ok, case when n <> 3 then 'expected 3 parts, found ' || n when widest - narrowest > 0.25 * widest then 'parts disagree on width' end reason,
 case when n = 3 and not widest - narrowest > 0.25 * widest then lo + (hi - lo + 1) // 3 end first_cut from k""", "evs")
def split_or_refuse(c: Catalog) -> DataFrame:
    cells = c.events.filter("event_type in ('view', 'click')").select("user_id", F.floor(F.col("us") / 3_600_000_000 / 6).alias("cell"))
    split = ranges.split_or_refuse(ranges.runs(cells, "user_id", "cell"), "user_id")
    return split.select("user_id", "ok", "reason", F.col("boxes")[0]["right"].alias("first_cut"))


@check("split_or_refuse_all", """with c as (select distinct user_id, us // 3600000000 // 6 cell from evs),
 n as (select *, cell - row_number() over (partition by user_id order by cell) run from c),
 r as (select user_id, min(cell) first, max(cell) last from n group by user_id, run),
 s as (select user_id, min(first) lo, max(last) hi from r group by user_id),
 w as (select r.*, s.lo, s.hi, last - first + 1 width, last - first + 1 > (hi - lo + 1) * 0.04 counted from r join s on s.user_id = r.user_id),
 k as (select user_id, lo, hi, count(*) filter (counted) n, max(width) filter (counted) widest, min(width) filter (counted) narrowest from w group by all)
 select user_id, n = 3 and not widest - narrowest > 0.25 * widest ok, case when n <> 3 then 'expected 3 parts, found ' || n when widest - narrowest > 0.25 * widest then 'parts disagree on width' end reason,
 case when n = 3 and not widest - narrowest > 0.25 * widest then lo + (hi - lo + 1) // 3 end first_cut from k""", "evs")
def split_or_refuse_all(c: Catalog) -> DataFrame:
    """The same over events of every type."""
    cells = c.events.select("user_id", F.floor(F.col("us") / 3_600_000_000 / 6).alias("cell"))
    split = ranges.split_or_refuse(ranges.runs(cells, "user_id", "cell"), "user_id")
    return split.select("user_id", "ok", "reason", F.col("boxes")[0]["right"].alias("first_cut"))


@check("status_progress", """with r as (select *, case stage when 'bisque' then 1 when 'glazing' then 2 when 'firing' then 2 when 'finished' then 3 else 0 end k from stage_log)
 select piece, event_id, ['in_progress', 'bisqued', 'glazed', 'finished'][1 + max(k) over (partition by piece order by us, event_id)] status from r""", "stage_log")
def status_progress(c: Catalog) -> DataFrame:
    return folds.status_progress(c.stage_log).select("piece", "event_id", "status")


@check("cover_pick", "select piece, arg_max(photo, {'u': us, 'e': event_id}) filter (photo is not null) cover from stage_log group by piece", "stage_log")
def cover_pick(c: Catalog) -> DataFrame:
    return folds.cover_pick(c.stage_log)


@check("pace_audit", """select event_id, us - before gap_us from (select event_id, us, lag(us) over (partition by event_type order by us, event_id) before from evs)
 where us - before < 60000000""", "evs")
def pace_audit(c: Catalog) -> DataFrame:
    return snapshots.too_close(c.events.select("event_type", "us", "event_id"), ["event_type"], 60_000_000).select("event_id", "gap_us")


@check("debounce", """select user_id, event_id from (select *, lead(us) over (partition by user_id order by us, event_id) nxt from evs)
 where nxt is null or nxt - us >= 7200000000""", "evs")
def debounce(c: Catalog) -> DataFrame:
    return folds.debounce(c.events, ["user_id"], 7_200_000_000).select("user_id", "event_id")


@check("latest_wins", """select user_id, event_id from (select *, cast(value * 100 as bigint) ticket, max(cast(value * 100 as bigint)) over (partition by user_id order by us, event_id) best from evs)
 where ticket = best""", "evs")
def latest_wins(c: Catalog) -> DataFrame:
    tickets = c.events.withColumn("ticket", F.round(F.col("value") * 100).cast("bigint"))
    return folds.latest_wins(tickets, ["user_id"]).select("user_id", "event_id")
