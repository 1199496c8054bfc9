"""SQL text for the oracles: the text rules of the library written out for another engine."""

from __future__ import annotations

from evidex.operators.postings import STOP_WORDS


def tokens(x: str) -> str:
    return f"[t for t in regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+') if t <> '']"


def stem(t: str) -> str:
    """Porter's step 1, written with named steps instead of back references."""
    def bound(value: str, name: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    a = f"case when {t} like '%sses' then {t}[:-3] when {t} like '%ies' then {t}[:-3] when regexp_matches({t}, '[^s]s$') then {t}[:-2] else {t} end"
    marked = f"regexp_replace({a}, '([^aeiou])y', '\\1Y', 'g')"
    has = "regexp_matches({0}, '[aeiouY]')"
    twice = "(len(r) > 1 and r[-1] = r[-2] and r[-1] not in ('a', 'e', 'i', 'o', 'u', 'Y', 'l', 's', 'z'))"
    cleaned = f"case when regexp_matches(r, '(at|bl|iz)$') then r || 'e' when {twice} then r[:-2] when regexp_matches(r, '^[^aeiouY]+[aeiouY][^aeiouYwxy]$') then r || 'e' else r end"
    cut_ed, cut_ing = bound("w[:-3]", "r", f"case when {has.format('r')} then {cleaned} else w end"), bound("w[:-4]", "r", f"case when {has.format('r')} then {cleaned} else w end")
    b = bound(marked, "w", f"case when w like '%eed' then case when regexp_matches(w[:-4], '[aeiouY][^aeiouY]') then w[:-2] else w end when w like '%ed' then {cut_ed} when w like '%ing' then {cut_ing} else w end")
    c = bound(b, "w", f"case when lower(w) like '%y' and {has.format('w[:-2]')} then w[:-2] || 'i' else w end")
    return f"(case when length({t}) <= 2 then {t} else replace({c}, 'Y', 'y') end)"


def stop_list() -> str:
    return "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"


def grams(x: str) -> str:
    return (f"list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] "
            f"for w in {tokens(x)}]))")


def similarity(a: str, b: str) -> str:
    """Similarity of two gram lists."""
    shared = f"len(list_intersect({a}, {b}))"
    return f"(case when len({a}) + len({b}) = 0 then 0.0 else {shared} / (len({a}) + len({b}) - {shared}) end)"


def term_ctes(searches: str) -> str:
    """``st(qid, grp, unit, negated, place, term)`` of a (qid, text) relation."""
    return f"""sg as (select qid, regexp_extract_all(lower(trim(text)), '-?"[^"]*"|\\S+') us from {searches}),
 sn as (select qid, us, unnest(us) u, generate_subscripts(us, 1) - 1 n from sg),
 su as (select qid, len(list_filter(us[1:n], lambda x: x = 'or')) grp,
   coalesce(nullif(list_position(list_reverse(us[1:n]), 'or'), 0) - 1, n) unit, u from sn where u <> 'or'),
 sw as (select qid, grp, unit, u like '-%' negated, unnest({tokens('u')}) t, generate_subscripts({tokens('u')}, 1) - 1 as place from su),
 st as (select qid, grp, unit, negated, place, {stem('t')} term from sw where t not in {stop_list()})"""


def match_ctes(index: str, doc: str) -> str:
    """``mt(qid, grp, doc)`` from ``st`` and an index (doc, pos, term, weight)."""
    return f"""uh as (select distinct s.qid, s.grp, s.unit, s.negated, p.{doc} from (
   select s.qid, s.grp, s.unit, s.negated, p.{doc}, p.pos - s.place start_pos, count(distinct s.place) n
   from st s join {index} p on p.term = s.term group by all) p
   join (select qid, grp, unit, any_value(negated) negated, count(*) n from st group by all) s
   on s.qid = p.qid and s.grp = p.grp and s.unit = p.unit and s.n = p.n),
 nd as (select qid, grp, count(distinct unit) needed from st where not negated group by all),
 mt as (select n.qid, n.grp, h.{doc} from nd n join uh h on h.qid = n.qid and h.grp = n.grp and not h.negated
   group by n.qid, n.grp, h.{doc}, n.needed having count(distinct h.unit) = n.needed
   and not exists (select 1 from uh b where b.qid = n.qid and b.grp = n.grp and b.negated and b.{doc} = h.{doc}))"""


def cover_ctes(index: str, doc: str) -> str:
    """``cr(qid, grp, doc, cover_rank)`` by brute force over every end position."""
    return f"""kw as (select distinct qid, grp, term from st where not negated),
 kn as (select qid, grp, count(*) k from kw group by all),
 oc as (select m.qid, m.grp, m.{doc}, p.pos, p.term, p.weight from mt m join kw w on w.qid = m.qid and w.grp = m.grp
   join {index} p on p.{doc} = m.{doc} and p.term = w.term),
 lp as (select e.qid, e.grp, e.{doc}, e.pos e_pos, o.term, max(o.pos) last_pos, arg_max(o.weight, o.pos) wt
   from oc e join oc o on o.qid = e.qid and o.grp = e.grp and o.{doc} = e.{doc} and o.pos <= e.pos group by all),
 cv as (select lp.qid, lp.grp, lp.{doc}, e_pos, min(last_pos) s_pos, kn.k / sum(1.0 / wt) hm, kn.k from lp
   join kn on kn.qid = lp.qid and kn.grp = lp.grp group by lp.qid, lp.grp, lp.{doc}, e_pos, kn.k having count(*) = kn.k),
 mc as (select *, lag(s_pos) over (partition by qid, grp, {doc} order by e_pos) before_s from cv),
 cr as (select qid, grp, {doc}, round(sum(least(1.0, k / (e_pos - s_pos + 1)) * hm), 6) cover_rank
   from mc where before_s is null or s_pos > before_s group by all)"""


def item_index() -> str:
    """``ip(item_id, pos, term, weight)`` over ``items``."""
    def one(x: str, w: float) -> str:
        return f"[{{'t': t, 'w': {w!r}::double}} for t in {tokens(x)}]"

    both = "code || ' ' || name"
    lists = f"{one(both, 1.0)} || {one(chr(39) + chr(39) + ' || array_to_string(terms, ' + chr(39) + ' ' + chr(39) + ')', 0.4)} || {one('description', 0.2)}"
    return f"""ix as (select item_id, {lists} entries from items),
 iu as (select item_id, unnest(entries) e, generate_subscripts(entries, 1) - 1 pos from ix),
 ip as (select item_id, pos, {stem("e.t")} term, e.w weight from iu where e.t not in {stop_list()})"""


def doc_index() -> str:
    """``dp(doc_id, pos, term, weight)``: source weighs A, text weighs C."""
    def one(x: str, w: float) -> str:
        return f"[{{'t': t, 'w': {w!r}::double}} for t in {tokens(x)}]"

    return f"""dx as (select doc_id, {one('source', 1.0)} || {one('text', 0.2)} entries from documents),
 du as (select doc_id, unnest(entries) e, generate_subscripts(entries, 1) - 1 pos from dx),
 dp as (select doc_id, pos, {stem("e.t")} term, e.w weight from du where e.t not in {stop_list()})"""


ROLL_UP = """ru as (select item_id,
  arg_min(source_url, {'p': case role when 'label_chip' then 0 when 'coats_composite' then 1 else 2 end, 'e': ev_id, 'v': source_url}) hero_source_url,
  arg_min(storage_path, {'p': case role when 'label_chip' then 0 when 'coats_composite' then 1 else 2 end, 'e': ev_id, 'v': source_url}) hero_storage_path,
  arg_min(hex, {'p': case role when 'label_chip' then 0 else 1 end, 'e': ev_id, 'v': hex}) filter (hex is not null) hero_hex,
  count(distinct coat) coat_levels, count(*) filter (layered_over is not null) layering_count,
  string_agg(distinct clay_name, ',' order by clay_name) filter (clay_name is not null) clay_bodies_shown
  from (select e.*, c.clay_name from evidence e left join clay_vocab c on c.clay = e.clay) group by item_id)"""

#: brute-force scoring of every (search, item) pair
SCORED = f"""sq as (select *, {grams('text')} qg from searches),
 ig as (select *, {grams('name')} ng, {grams('code')} cg from items),
 fts as (select qid, item_id, max(cover_rank) ts_rank from cr group by all),
 pr as (select q.qid, q.text, q.page_limit, q.page_offset, i.item_id, i.code, trim(q.text) = '' blank, f.ts_rank,
   greatest({similarity('qg', 'ng')}, {similarity('qg', 'cg')}) sim,
   {similarity('qg', 'ng')} nsim, {similarity('qg', 'cg')} csim
   from sq q cross join ig i left join fts f on f.qid = q.qid and f.item_id = i.item_id
   where (q.makers is null or list_contains(q.makers, i.maker_id)) and (q.lines is null or list_contains(q.lines, i.line))
   and (q.surfaces is null or list_contains(q.surfaces, i.surface)) and (q.flag is null or i.flag is not distinct from q.flag)
   and ((q.lo is null and q.hi is null) or (coalesce(i.lo, 1) <= coalesce(q.hi, 32767) and coalesce(i.hi, 32767) >= coalesce(q.lo, 1)))
   and (q.clays is null or exists (select 1 from evidence e where e.item_id = i.item_id and list_contains(q.clays, e.clay)))),
 sc as (select qid, item_id, code, page_limit, page_offset,
   case when blank or coalesce(ts_rank, -1) >= 0.02 then 'match' else 'near' end tier,
   round(case when blank then 1.0 else greatest(coalesce(ts_rank, 0), sim) end, 6) as rank
   from pr where blank or ts_rank is not null or nsim > 0.25 or csim > 0.30)"""

#: the same with every filter, null texts, and alternatives made of exclusions alone (they rank nothing)
SCORED_EDGES = f"""sq as (select * replace (coalesce(text, '') as text), {grams("coalesce(text, '')")} qg from edge_searches),
 ig as (select *, {grams('name')} ng, {grams('code')} cg from items),
 lk as (select n.qid, i.item_id from (select qid, grp from st group by all having bool_and(negated)) n cross join items i
   where not exists (select 1 from uh where uh.qid = n.qid and uh.grp = n.grp and uh.item_id = i.item_id)),
 fts as (select qid, item_id, max(r) ts_rank from (select qid, item_id, cover_rank r from cr union all select qid, item_id, 0.0 from lk) group by all),
 rf as (select q.qid, i.item_id from (select qid, unnest(codes) code, unnest(code_makers) mk from edge_searches) q join makers m on m.maker_key = lower(trim(q.mk))
   join items i on i.maker_id = m.maker_id and upper(i.code) = upper(trim(q.code))),
 pr as (select q.qid, q.text, q.page_limit, q.page_offset, i.item_id, i.code, trim(q.text) = '' blank, f.ts_rank,
   greatest({similarity('qg', 'ng')}, {similarity('qg', 'cg')}) sim, {similarity('qg', 'ng')} nsim, {similarity('qg', 'cg')} csim
   from sq q cross join ig i left join fts f on f.qid = q.qid and f.item_id = i.item_id
   where (q.makers is null or list_contains(q.makers, i.maker_id)) and (q.lines is null or list_contains(q.lines, i.line))
   and (q.surfaces is null or coalesce(list_contains(q.surfaces, i.surface), false)) and (q.opacities is null or coalesce(list_contains(q.opacities, i.opacity), false))
   and (q.flag is null or i.flag is not distinct from q.flag)
   and ((q.lo is null and q.hi is null) or (coalesce(i.lo, 1) <= coalesce(q.hi, 32767) and coalesce(i.hi, 32767) >= coalesce(q.lo, 1)))
   and (q.clays is null or exists (select 1 from evidence e where e.item_id = i.item_id and list_contains(q.clays, e.clay)))
   and (q.codes is null or exists (select 1 from rf where rf.qid = q.qid and rf.item_id = i.item_id))),
 sc as (select qid, item_id, code, page_limit, page_offset, case when blank or coalesce(ts_rank, -1) >= 0.02 then 'match' else 'near' end tier,
   round(case when blank then 1.0 else greatest(coalesce(ts_rank, 0), sim) end, 6) as rank
   from pr where blank or ts_rank is not null or nsim > 0.25 or csim > 0.30)"""


def delta_e_ctes(source: str, keep: str) -> str:
    """``de(keep..., de)`` of a relation with columns l1 a1 b1 l2 a2 b2, written independently of the library."""
    return f"""d0 as (select *, sqrt(a1*a1 + b1*b1) c1s, sqrt(a2*a2 + b2*b2) c2s from {source}),
 d1 as (select *, 0.5 * (1 - sqrt(pow((c1s + c2s)/2, 7) / (pow((c1s + c2s)/2, 7) + pow(25.0, 7)))) g from d0),
 d2 as (select *, (1+g)*a1 ap1, (1+g)*a2 ap2 from d1),
 d3 as (select *, sqrt(ap1*ap1 + b1*b1) c1, sqrt(ap2*ap2 + b2*b2) c2,
   case when ap1 = 0 and b1 = 0 then 0 else (degrees(atan2(b1, ap1)) + 360) % 360 end h1, case when ap2 = 0 and b2 = 0 then 0 else (degrees(atan2(b2, ap2)) + 360) % 360 end h2 from d2),
 d4 as (select *, case when c1*c2 = 0 then 0 when h2-h1 > 180 then h2-h1-360 when h2-h1 < -180 then h2-h1+360 else h2-h1 end dh,
   case when c1*c2 = 0 then h1+h2 when abs(h1-h2) <= 180 then (h1+h2)/2 when h1+h2 < 360 then (h1+h2+360)/2 else (h1+h2-360)/2 end hm, (l1+l2)/2 lm, (c1+c2)/2 cm from d3),
 d5 as (select *, 1 - 0.17*cos(radians(hm-30)) + 0.24*cos(radians(2*hm)) + 0.32*cos(radians(3*hm+6)) - 0.2*cos(radians(4*hm-63)) t,
   (l2-l1)/(1 + 0.015*pow(lm-50,2)/sqrt(20+pow(lm-50,2))) xl, (c2-c1)/(1+0.045*cm) xc,
   -2*sqrt(pow(cm,7)/(pow(cm,7)+pow(25.0,7)))*sin(radians(60*exp(-pow((hm-275)/25,2)))) rt from d4),
 d6 as (select *, 2*sqrt(c1*c2)*sin(radians(dh/2))/(1+0.015*cm*t) xh from d5),
 de as (select {keep}, sqrt(xl*xl+xc*xc+xh*xh+rt*xc*xh) de from d6)"""


#: ``nm(vec_id, nth, term, family, place)``: three terms of the first colour and one of the second
NAMED = ("""lr as (select vec_id, 0 nth, 3 lim, l1, a1, b1 from readings union all select vec_id, 1, 1, l2, a2, b2 from readings),
 lt as (select lr.*, t.term, t.family, t.ord, t.radius, t.l l2, t.a a2, t.b b2 from lr cross join color_terms t),
 """ + delta_e_ctes("lt", "vec_id, nth, lim, term, family, ord, radius") + """,
 nm as (select *, row_number() over (partition by vec_id, nth order by round(de, 6), ord) place from de where de <= radius
   qualify row_number() over (partition by vec_id, nth order by round(de, 6), ord) <= lim)""")
