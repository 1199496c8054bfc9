"""Mark folds and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.operators import folds
from evidex.plans.registry import check
from evidex.plans.views import Catalog

MARKS_SQL = """n as (select *, row_number() over (partition by key order by us, event_id) o from marks_log),
 lc as (select key, max(o) filter (action = 'clear') c from n group by key),
 v as (select n.* from n join lc on lc.key = n.key where n.action <> 'clear' and (lc.c is null or n.o > lc.c)),
 s as (select key, min(o) filter (action in ('own', 'wish')) fs, max(o) filter (action in ('own', 'wish')) ls, max(o) filter (action = 'wish') lw from v group by key),
 f as (select v.key, min(v.o) ow from v join s on s.key = v.key where v.action = 'own' and (s.lw is null or v.o > s.lw) group by v.key),
 mk as (select s.key, case (select any_value(action) from v where v.key = s.key and v.o = s.ls) when 'own' then 'owned' else 'wishlist' end state,
  s.lw is distinct from s.ls and (select count(*) from v where v.key = s.key and v.action = 'toggle' and v.o > f.ow) % 2 = 1 favorite,
  (select arg_max(coalesce(nullif(trim(note), ''), '~'), o) from v where v.key = s.key and v.action = 'note' and v.o > s.fs) note
  from s left join f on f.key = s.key where s.ls is not null)"""


@check("mark_fold", f"with {MARKS_SQL} select key, state, favorite, nullif(note, '~') note from mk", "marks_log")
def mark_fold(c: Catalog) -> DataFrame:
    return folds.mark_fold(c.marks_log).drop("updated_us")


@check("mark_lists", f"with {MARKS_SQL} select key, 'wishlist' list from mk where state = 'wishlist' union all select key, 'owned' from mk where state = 'owned' union all select key, 'favorite' from mk where favorite", "marks_log")
def mark_lists(c: Catalog) -> DataFrame:
    marks = folds.mark_fold(c.marks_log)
    return folds.mark_lists(marks)


@check("rekey_marks", """select 'source_a' maker, 'PC-' || c_custkey code, case when c_custkey % 3 = 0 then 'owned' else 'wishlist' end state, c_custkey % 2 = 0 and c_custkey % 3 = 0 favorite, c_name as name, c_custkey * 1000 updated_ms, cast(null as varchar) note from customer""")
def rekey_marks(c: Catalog) -> DataFrame:
    old = c.table("customer").selectExpr("concat('PC-', c_custkey) as code", "c_custkey % 3 = 0 as owned", "c_custkey % 2 = 0 as favorite", "c_name as name", "c_custkey * 1000 as updated_ms")
    return folds.rekey_marks(old, "source_a")
