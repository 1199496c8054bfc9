"""Set operations, content addressing and stored-object keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.functions.hashing import content_hash, storage_key
from evidex.operators import evidence as E
from evidex.operators import sets as X
from evidex.operators.snapshots import canonical_files
from evidex.plans.registry import check
from evidex.plans.views import Catalog


@check("term_overlap", "select a.item_id, len(list_intersect(a.terms, b.terms)) shared from items a join items b on b.item_id = a.item_id + 1", "items")
def term_overlap(c: Catalog) -> DataFrame:
    after = c.items.select((F.col("item_id") - 1).alias("item_id"), F.col("terms").alias("other"))
    return c.items.join(after, "item_id").select("item_id", F.size(F.array_intersect("terms", "other")).cast("bigint").alias("shared"))


@check("set_diff", """with e as (select l_returnflag flag, l_linestatus status, l_linenumber no from lineitem where l_quantity < 25), a as (select l_returnflag flag, l_linestatus status, l_linenumber no from lineitem where l_quantity >= 25)
 select flag, status, no, case when n > 0 then 'missing' else 'unexpected' end side, cast(abs(n) as bigint) copies from (select flag, status, no, sum(d) n from (select *, 1 d from e union all select *, -1 from a) group by all) where n <> 0""")
def set_diff(c: Catalog) -> DataFrame:
    rows = c.table("lineitem").selectExpr("l_returnflag as flag", "l_linestatus as status", "l_linenumber as no", "l_quantity")
    return X.set_diff(rows.filter("l_quantity < 25").drop("l_quantity"), rows.filter("l_quantity >= 25").drop("l_quantity"))


@check("drift", """select coalesce(a.k, b.k) page, case when b.k is null then 'unrecorded' else 'unknown' end side from (select page_id k from pages where page_id % 5 <> 0) a
 full join (select distinct id // 4 + 3 k from snapshots where status = 200) b on a.k = b.k where a.k is null or b.k is null""", "snapshots")
def drift(c: Catalog) -> DataFrame:
    ledger = c.table("pages").filter("page_id % 5 <> 0").select(F.col("page_id").alias("page"))
    log = c.snapshots.filter("status = 200").selectExpr("id div 4 + 3 as page")
    return X.drift(ledger, log, ["page"], "unrecorded", "unknown")


@check("content_address", """select 'p/' || substr(h, 1, 2) || '/' || h || '.jpg' key, count(distinct doc_id) owners, min(doc_id) first_owner from (select doc_id, sha256(text) h from documents) group by h""")
def content_address(c: Catalog) -> DataFrame:
    hashed = c.table("documents").select("doc_id", storage_key(content_hash(F.col("text"))).alias("key"))
    return canonical_files(hashed, "key", "doc_id")


@check("missing_keys", "select distinct storage_path from evidence e where not exists (select 1 from orders o where 'p/' || (o.o_custkey % 256) || '/' || o.o_orderkey = e.storage_path)", "evidence")
def missing_keys(c: Catalog) -> DataFrame:
    stored = c.table("orders").selectExpr("concat('p/', o_custkey % 256, '/', o_orderkey) as storage_path")
    return X.missing_keys(c.evidence.select("storage_path").distinct(), stored, "storage_path")


@check("orphan_keys", "select 'p/' || (o.o_custkey % 256) || '/' || o.o_orderkey storage_path from orders o where not exists (select 1 from evidence e where 'p/' || (o.o_custkey % 256) || '/' || o.o_orderkey = e.storage_path)", "evidence")
def orphan_keys(c: Catalog) -> DataFrame:
    stored = c.table("orders").selectExpr("concat('p/', o_custkey % 256, '/', o_orderkey) as storage_path")
    return X.orphan_keys(stored, c.evidence, "storage_path")


@check("replace_children", """select item_id, ev_id, coat from evidence where item_id % 3 <> 0 union all
 select p_partkey, 'new-' || p_partkey, 1 from part where p_partkey % 3 = 0 and p_partkey in (select item_id from evidence) union all
 select p_partkey, 'new-' || p_partkey, 1 from part where p_partkey % 3 = 0 and p_partkey not in (select item_id from evidence)""", "evidence")
def replace_children(c: Catalog) -> DataFrame:
    incoming = c.items.filter("item_id % 3 = 0").select("item_id", F.concat(F.lit("new-"), "item_id").alias("ev_id"), F.lit(1).alias("coat"))
    return E.replace_children(c.evidence.select("item_id", "ev_id", "coat"), incoming, "item_id")
