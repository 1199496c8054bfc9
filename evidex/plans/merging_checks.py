"""Merges, replacement, links to lines, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators import evidence as E
from evidex.operators import merge as U
from evidex.operators.snapshots import outcomes
from evidex.plans.aggregates_checks import issue_log
from evidex.plans.registry import check
from evidex.plans.views import Catalog
from evidex.session import shared_dir
from evidex.plans.windows_checks import CHANGE_SQL, NOISE


def _stored_items(c: Catalog) -> DataFrame:
    return c.items.filter("item_id % 4 <> 0").selectExpr("maker_id", "code", "name", "line", "description", "surface", "opacity", "price",
                                                        "concat('slug-', item_id) as slug", "item_id as first_seen_s", "item_id as last_seen_s")


def _incoming_items(c: Catalog) -> DataFrame:
    """A batch with repeats: every key twice, the later one counts."""
    return c.items.filter("item_id % 3 <> 0").selectExpr("*", "explode(array(1, 2)) as n").selectExpr(
        "maker_id", "code", "concat(name, ' v', n) as name", "line", "case when n = 1 then description end as description", "surface", "opacity", "price + n as price",
        "concat('other-', n) as slug", "item_id + 1000 * n as first_seen_s", "cast(item_id + (item_id % 2) * 100 - 50 as bigint) as last_seen_s", "n")


@check("upsert_items", """select maker_id, code, case when item_id % 3 <> 0 then name || ' v2' else name end as name, case when item_id % 3 <> 0 then null else description end description,
 case when item_id % 3 <> 0 then price + 2 else price end price, case when item_id % 4 <> 0 then 'slug-' || item_id else 'other-2' end slug,
 case when item_id % 4 <> 0 then item_id else item_id + 2000 end first_seen_s,
 case when item_id % 3 = 0 then item_id when item_id % 4 = 0 then item_id + (item_id % 2) * 100 - 50 else greatest(item_id, item_id + (item_id % 2) * 100 - 50) end last_seen_s
 from items where item_id % 4 <> 0 or item_id % 3 <> 0""", "items")
def upsert_items(c: Catalog) -> DataFrame:
    merged = U.upsert(_stored_items(c), _incoming_items(c), ["maker_id", "code"], U.ITEM_POLICY, ["n"])
    return merged.select("maker_id", "code", "name", "description", "price", "slug", "first_seen_s", "last_seen_s")


@check("publish_items", """select maker_id, code, case when item_id % 3 <> 0 then name || ' v2' else name end as name, case when item_id % 3 <> 0 then null else description end description,
 case when item_id % 3 <> 0 then price + 2 else price end price, case when item_id % 4 <> 0 then 'slug-' || item_id else 'other-2' end slug,
 case when item_id % 4 <> 0 then item_id else item_id + 2000 end first_seen_s,
 case when item_id % 3 = 0 then item_id when item_id % 4 = 0 then item_id + (item_id % 2) * 100 - 50 else greatest(item_id, item_id + (item_id % 2) * 100 - 50) end last_seen_s
 from items where item_id % 4 <> 0 or item_id % 3 <> 0""", "items")
def publish_items(c: Catalog) -> DataFrame:
    """The same merge into a published table, and once more into what was published: the second run adds nothing."""
    root = shared_dir(c.spark, "published")
    held = U.publish(_stored_items(c), root)
    for _ in range(2):
        held = U.publish(U.upsert(held, _incoming_items(c), ["maker_id", "code"], U.ITEM_POLICY, ["n"]), root)
    return held.select("maker_id", "code", "name", "description", "price", "slug", "first_seen_s", "last_seen_s")


CHILD_POLICY = {"storage_path": U.TAKE_NEW, "role": U.TAKE_NEW, "hex": U.COALESCE}


@check("upsert_children", """with o as (select item_id, source_url, min(storage_path) storage_path, min(role) as role, max(hex) hex from evidence where source_key % 3 <> 0 group by all),
 n as (select item_id, source_url, 'new' storage_path, 'other' as role, cast(null as varchar) hex from evidence where source_key % 2 = 0 group by all)
 select coalesce(n.item_id, o.item_id) item_id, coalesce(n.source_url, o.source_url) source_url, coalesce(n.storage_path, o.storage_path) storage_path, coalesce(n.role, o.role) as role, coalesce(n.hex, o.hex) hex
 from o full join n on o.item_id = n.item_id and o.source_url = n.source_url""", "evidence")
def upsert_children(c: Catalog) -> DataFrame:
    old = c.evidence.filter("source_key % 3 <> 0").groupBy("item_id", "source_url").agg(F.min("storage_path").alias("storage_path"), F.min("role").alias("role"), F.max("hex").alias("hex"))
    new = c.evidence.filter("source_key % 2 = 0").select("item_id", "source_url", F.lit("new").alias("storage_path"), F.lit("other").alias("role"), F.lit(None).cast("string").alias("hex"))
    return U.upsert(old, new, ["item_id", "source_url"], CHILD_POLICY, ["source_url"])


@check("upsert_lines", """select line, line || '!' as name, case when line in ('SMALL', 'LARGE') then min(lo) + 1 else min(lo) end line_lo, max(hi) line_hi from items group by line""", "items")
def upsert_lines(c: Catalog) -> DataFrame:
    old = c.line_vocab.select("line", F.col("line").alias("name"), "line_lo", "line_hi")
    new = c.line_vocab.select("line", F.concat("line", F.lit("!")).alias("name"), F.when(F.col("line").isin("SMALL", "LARGE"), F.col("line_lo") + 1).alias("line_lo"), F.lit(None).cast("int").alias("line_hi"))
    return U.upsert(old, new, ["line"], U.LINE_POLICY, ["line"])


@check("carry_forward", """select e.ev_id, e.item_id, coalesce(n.hex, e.hex) hex from (select ev_id, any_value(item_id) item_id, max(hex) hex from evidence group by ev_id) e
 left join (select ev_id, case when item_id % 3 = 0 then '#new' end hex from evidence group by all) n on n.ev_id = e.ev_id""", "evidence")
def carry_forward(c: Catalog) -> DataFrame:
    held = c.evidence.groupBy("ev_id").agg(F.any_value("item_id").alias("item_id"), F.max("hex").alias("hex"))
    incoming = held.select("ev_id", "item_id", F.when(F.col("item_id") % 3 == 0, F.lit("#new")).alias("hex"))
    return E.carry_forward(incoming, held, ["ev_id"], ["hex"])


@check("fan_out", """select p_partkey, region_no, case region_no when 0 then 'light' when 1 then 'slightly_heavy' when 2 then 'heavy' end coat_label, case when region_no is not null then p_size + region_no end width
 from (select p_partkey, p_size, unnest(case when p_partkey % 5 = 0 then [null] else range(0, p_partkey % 5) end)::integer region_no from part where p_partkey % 7 <> 0)""")
def fan_out(c: Catalog) -> DataFrame:
    images = c.table("part").selectExpr("p_partkey", "case when p_partkey % 7 = 0 then 'line_chart' else 'coats_composite' end as role",
                                        "case when p_partkey % 5 > 0 then transform(sequence(0, cast(p_partkey % 5 as int) - 1), i -> named_struct('width', p_size + i)) end as regions")
    return E.fan_out(images, ["light", "slightly_heavy", "heavy"]).select("p_partkey", "region_no", "coat_label", F.col("region.width").alias("width"))


@check("fan_out_issues", """select p_partkey, cast(3 as integer) region_no from part where p_partkey % 7 <> 0 and p_partkey % 5 = 4""")
def fan_out_issues(c: Catalog) -> DataFrame:
    return fan_out(c).filter("region_no is not null and coat_label is null").select("p_partkey", "region_no")


@check("inherit_range", """select i.item_id, case when i.lo is null then l.line_lo else i.lo end lo, case when i.lo is null then l.line_hi else i.hi end hi, case when i.lo is null then 'line' else 'product' end range_source
 from items i join line_vocab l on l.line = i.line""", "items line_vocab")
def inherit_range(c: Catalog) -> DataFrame:
    return U.inherit_range(c.items, c.line_vocab).select("item_id", "lo", "hi", "range_source")


_ISSUES = """lg as (select cast(user_id % 4 as integer) maker_id, 'kind_' || (event_id % 5) kind, 'subject_' || user_id subject, us // 1000000 seen_s, us // 1000000 opened_s, case when event_id % 4 = 0 then us // 1000000 + 60 end resolved_s, props detail, event_id from evs where event_type = 'error'),
 qu as (select * from lg where resolved_s is not null union all select * from lg where resolved_s is null and event_id % 2 = 1 qualify row_number() over (partition by maker_id, kind, subject order by seen_s, event_id) = 1),
 nw as (select * from lg where event_id % 2 = 0 qualify row_number() over (partition by maker_id, kind, subject order by seen_s desc, detail desc) = 1)"""


@check("issue_upsert", f"""with {_ISSUES}, op as (select * from qu where resolved_s is null)
 select maker_id, kind, subject, opened_s, seen_s, detail, resolved_s from qu where resolved_s is not null
 union all select coalesce(o.maker_id, n.maker_id), coalesce(o.kind, n.kind), coalesce(o.subject, n.subject), coalesce(o.opened_s, n.opened_s), greatest(o.seen_s, n.seen_s), coalesce(n.detail, o.detail), null
 from op o full join nw n on n.maker_id = o.maker_id and n.kind = o.kind and n.subject = o.subject""", "evs")
def issue_upsert(c: Catalog) -> DataFrame:
    log = issue_log(c).withColumn("opened_s", F.col("seen_s"))
    columns = ["maker_id", "kind", "subject", "opened_s", "seen_s", "detail", "resolved_s"]
    first = (log.filter("resolved_s is null and issue_id % 2 = 1").groupBy("maker_id", "kind", "subject")
             .agg(F.min_by(F.struct("opened_s", "seen_s", "detail", "resolved_s"), F.struct("seen_s", "issue_id")).alias("r")).select("maker_id", "kind", "subject", "r.*"))
    queue = log.filter("resolved_s is not null").select(*columns).unionByName(first.select(*columns))
    return U.upsert_issues(queue, log.filter("issue_id % 2 = 0").select(*columns))


@check("run_summary", f"""select s.maker_id, count(*) filter (outcome = 'stored') stored, count(*) filter (outcome = 'unchanged') unchanged, count(*) filter (outcome = 'gone') gone, count(*) filter (outcome = 'failed') failed
 from ({CHANGE_SQL}) o join snapshots s on s.url = o.url and s.id = o.id group by s.maker_id""", "snapshots")
def run_summary(c: Catalog) -> DataFrame:
    done = outcomes(c.snapshots, NOISE).join(c.snapshots.select("url", "id", "maker_id"), ["url", "id"])
    return U.run_summary(done)
