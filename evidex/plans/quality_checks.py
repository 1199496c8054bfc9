"""Quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex import vocabulary as V
from evidex.operators import quality as Z
from evidex.plans.registry import check
from evidex.plans.views import Catalog

#: (measurement, severity, op, limit)
LIMITS = [
    ("items", "error", ">=", 150), ("items_without_evidence", "error", "<=", 0), ("leaked_icons", "error", "<=", 0), ("confident_but_empty", "error", "<=", 0),
    ("links_resolved", "error", ">=", 50), ("with_clay", "error", ">=", 1), ("share_with_terms", "error", ">=", 0.75),
    ("distinct_assets", "warning", "report", 0), ("unsplit_composites", "gap", "report", 0), ("items_without_range", "gap", "report", 0),
]


@check("dq_suite", """with i as (select count(*) items, count(*) filter (lo is null) items_without_range, count(*) filter (len(terms) > 0) / count(*) share_with_terms,
  count(*) filter (not exists (select 1 from evidence e where e.item_id = items.item_id)) items_without_evidence from items),
 e as (select count(*) filter (source_url like '%image-manager%') leaked_icons, count(*) filter (role in ('layered', 'other') and coat is null and clay is null and layered_over is null) confident_but_empty,
  count(layered_over) links_resolved, count(clay) with_clay, count(*) filter (role = 'coats_composite' and coat is null) unsplit_composites, count(distinct hex) distinct_assets from evidence)
 select name, severity, observed::double observed, bound::double bound, ok from i, e, lateral (values
  ('items', 'error', i.items, 150, i.items >= 150), ('items_without_evidence', 'error', i.items_without_evidence, 0, i.items_without_evidence <= 0), ('leaked_icons', 'error', e.leaked_icons, 0, e.leaked_icons <= 0),
  ('confident_but_empty', 'error', e.confident_but_empty, 0, e.confident_but_empty <= 0), ('links_resolved', 'error', e.links_resolved, 50, e.links_resolved >= 50), ('with_clay', 'error', e.with_clay, 1, e.with_clay >= 1),
  ('share_with_terms', 'error', i.share_with_terms, 0.75, i.share_with_terms >= 0.75), ('distinct_assets', 'warning', e.distinct_assets, 0, true), ('unsplit_composites', 'gap', e.unsplit_composites, 0, true),
  ('items_without_range', 'gap', i.items_without_range, 0, true)) v(name, severity, observed, bound, ok)""", "items evidence")
def dq_suite(c: Catalog) -> DataFrame:
    return Z.verdicts(Z.measure(c.items, c.evidence), LIMITS)


@check("vocab_checks", """select 'duplicate_' || k violation, scope, value, n from (select 'code' k, cast(s_nationkey % 4 as varchar) scope, 'C' || (s_suppkey % 40) as value, count(*) n from supplier group by all
 union all select 'ordinal', cast(s_nationkey % 4 as varchar), cast(s_suppkey % 60 as varchar), count(*) from supplier group by all) where n > 1
 union all select 'no_family', '', term, 1 from color_terms where specialised and family is null""", "color_terms")
def vocab_checks(c: Catalog) -> DataFrame:
    entries = c.table("supplier").selectExpr("s_nationkey % 4 as scope", "concat('C', s_suppkey % 40) as code", "s_suppkey % 60 as ordinal")
    orphans = Z.terms_without_family(V.color_terms(c.spark)).select(
        F.lit("no_family").alias("violation"), F.lit("").alias("scope"), F.col("term").alias("value"), F.lit(1).cast("bigint").alias("n"))
    return Z.vocabulary_violations(entries, "scope", "code", "ordinal").unionByName(orphans)
