"""Registry of queries and the shared SQL views their oracles are written over."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

IOU = """greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))
 * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"""


def iou_sql(a: str, b: str) -> str:
    shared = "(" + IOU.format(a=a, b=b) + ")"
    area = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
    return f"({shared} / ({area.format(a)} + {area.format(b)} - {shared} + 1e-9))"


VIEWS: dict[str, str] = {
    "items": """
select l.photo_id, l.item_idx, concat(cast(l.photo_id as varchar), '_', cast(l.item_idx as varchar)) as item_id,
 l.vec_id, case when l.l_suppkey % 10 = 0 then 107 else e.label end as label,
 cast(x1 as double) as x1, cast(y1 as double) as y1,
 cast(x1 + 40 + 3*l_quantity as double) as x2, cast(y1 + 40 + (l_partkey % 50) as double) as y2
from (select l_orderkey as photo_id, l_partkey, l_suppkey, l_quantity,
  cast(row_number() over (partition by l_orderkey
    order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as int) as item_idx,
  (l_partkey*31 + l_suppkey*7 + l_linenumber) % (select count(*) from embeddings) as vec_id,
  (l_partkey*13 + l_linenumber*97) % 1000 as x1, (l_suppkey*29 + l_partkey) % 700 as y1 from lineitem) l
join embeddings e on e.vec_id = l.vec_id""",
    "photos": """
select o_orderkey as photo_id, case when o_custkey % 17 = 0 then null else o_custkey end as allowlist_id,
 1280 as width, 960 as height from orders""",
    "lists": "select c_custkey as allowlist_id from customer where c_custkey % 17 <> 0",
    "allowlist_classes": """
select c_custkey as allowlist_id, c.class_id from customer
cross join (select distinct label as class_id from embeddings) c
where c_custkey % 17 <> 0 and c_custkey % 23 <> 0 and (c.class_id*7 + c_custkey*3) % 10 < 8""",
    "listed": """
select l.allowlist_id, coalesce(list_sort(list(a.class_id) filter (a.class_id is not null)), []) as listed
from lists l left join allowlist_classes a using (allowlist_id) group by 1""",
    "detections": """
select photo_id, item_id as det_id, vec_id, 0.30 + (vec_id % 70)/100.0 as score,
 x1 + 2*(vec_id % 5) as x1, y1 + (vec_id % 3) as y1, x2 + 2*(vec_id % 5) as x2, y2 + (vec_id % 3) as y2
from items where vec_id % 13 <> 0
union all
select photo_id, concat(item_id, 'd'), vec_id, 0.28 + (vec_id % 70)/200.0, x1 + 3, y1 + 3, x2 + 3, y2 + 3
from items where vec_id % 4 = 0
union all
select photo_id, concat(item_id, 's'), vec_id, 0.26 + (vec_id % 50)/100.0, x1 + 1300, y1 + 900, x2 + 1300, y2 + 900
from items where vec_id % 29 = 0""",
    "catalogue": """
select cast(dense_rank() over (order by p_name) - 1 as int) as class_id, p_name as name
from (select distinct p_name from part) t""",
    "text_lines": """
select p_partkey as line_no, concat(cast(p_partkey % 9 + 1 as varchar), ') ',
 case p_partkey % 4 when 0 then p_name when 1 then replace(p_name, 'widget', 'wiget')
  when 2 then upper(p_name) else concat(p_name, '500MG') end) as text from part""",
    "raw_photos": """
select case o_orderkey % 3 when 0 then concat('cam/a.', o_orderkey, '.JPG') when 1 then concat('.', o_orderkey, '.png')
  else concat('scan/', o_orderkey) end as filename,
 cast(2001 + 2*(o_orderkey*37 % 1050) as int) as width, cast(1501 + 2*(o_orderkey*53 % 1150) as int) as height,
 cast(o_orderkey % 9 as int) as orientation, o_orderkey, o_custkey from orders""",
    "raw_boxes": """
select filename, b as box_no, cast((o_orderkey*(11+b) + o_custkey*7) % 2100 - 20 as double) as x,
 cast((o_orderkey*(5+b) + o_custkey*3) % 1600 - 10 as double) as y,
 cast((o_orderkey*3 + o_custkey + b) % 240 as double) as w, cast((o_orderkey + o_custkey*(2+b)) % 180 as double) as h,
 cast(case b when 0 then o_custkey % 10 when 1 then (o_custkey + o_orderkey) % 10 else 107 end as int) as label
from raw_photos, (values (0), (1), (2)) t(b)""",
    "sized": """
select *, case when turned then height else width end as ow, case when turned then width else height end as oh,
 least(1.0, 1280.0::double / greatest(width, height)) as scale
from (select *, orientation in (5, 6, 7, 8) as turned from raw_photos)""",
    "saved": """
select *, greatest(1, cast(round_even(ow * scale, 0) as int)) as w, greatest(1, cast(round_even(oh * scale, 0) as int)) as h
from sized""",
    "corners": """
select b.filename, b.box_no, b.label,
 round_even(greatest(0.0, least(s.w, b.x * s.scale)), 1) as x1, round_even(greatest(0.0, least(s.h, b.y * s.scale)), 1) as y1,
 round_even(greatest(0.0, least(s.w, (b.x + b.w) * s.scale)), 1) as x2,
 round_even(greatest(0.0, least(s.h, (b.y + b.h) * s.scale)), 1) as y2
from raw_boxes b join saved s using (filename)""",
    "kept_boxes": "select * from corners where x2 - x1 >= 2 and y2 - y1 >= 2",
    "name_lines": """
select concat('list_', p_partkey % 97) as allowlist_id, p_partkey as line_no,
 concat(p_partkey % 9 + 1, ([') ', '. ', '- ', ': '])[p_partkey % 4 + 1], p_name) as text,
 case when p_partkey % 7 = 0 then 'date' else 'drugname' end as line_kind,
 case when p_partkey % 11 = 0 then -1 when p_partkey % 31 = 0 then null else cast((length(p_name) + p_size % 3) % 12 as int)
  end as class_id from part""",
    "clean_lines": """
select *, trim(regexp_replace(text, '^\\s*\\d+\\s*[\\)\\.\\-:]\\s*', '')) as name from name_lines
where line_kind = 'drugname' and class_id >= 0""",
    "votes": "select class_id, name, count(*) as votes, min(line_no) as first_seen from clean_lines group by 1, 2",
    "ranked_names": """
select *, row_number() over (partition by class_id order by votes desc, first_seen) - 1 as alias_no from votes""",
    "class_names": "select class_id, name, votes from ranked_names where alias_no = 0",
    "split_groups": """
select grp, n, case when before < n_test then 'test' when before - t < n_val then 'val' else 'train' end as subset
from (select *, coalesce(max(case when before < n_test then upto end) over (), 0) as t from (
  select *, upto - n as before, round_even(0.15 * sum(n) over (), 0) as n_test, round_even(0.15 * sum(n) over (), 0) as n_val
  from (select grp, n, sum(n) over (order by sha1('20260918:' || grp), grp) as upto from (
    select coalesce(cast(allowlist_id as varchar), '__solo__' || photo_id) as grp, count(*) as n from photos group by 1))))""",
    "split": """
select p.photo_id, p.allowlist_id, g.subset from photos p
join split_groups g on g.grp = coalesce(cast(p.allowlist_id as varchar), '__solo__' || p.photo_id)""",
    "photo_labels": "select photo_id, list_sort(list(distinct label)) as labels from items group by 1",
    "base_lists": """
select *, list_filter(labels, lambda c: list_contains(base, c)) as present from (
 select p.photo_id, p.allowlist_id, pl.labels, list_sort(list_filter(
   coalesce(l.listed, list_filter(pl.labels, lambda c: c <> 107)), lambda c: c not in (8, 9))) as base
 from photos p join photo_labels pl using (photo_id) left join listed l using (allowlist_id))""",
    "removals": """
select b.*, k, list_sort(list_transform(list_sort(list_transform(present, lambda c:
  sha1('20260918:' || b.photo_id || ':' || k || ':' || c) || '|' || c))[1:k],
  lambda s: cast(split_part(s, '|', 2) as int))) as removed
from base_lists b, (values (1), (2)) t(k)
where len(present) >= k and not (k > 1 and len(present) = k and len(base) = k)""",
    "scenarios": """
select photo_id || '#clean' as scenario_id, 'clean' as kind, photo_id, allowlist_id, base as listed, []::int[] as removed
from base_lists
union all
select photo_id || '#remove-' || k, 'remove-' || k, photo_id, allowlist_id,
 list_filter(base, lambda c: not list_contains(removed, c)), removed from removals""",
    "told": """
select *, case when reason = 'listed' then 'in' else 'out' end as gt from (
 select s.scenario_id, s.kind, s.photo_id, s.listed, s.removed, i.item_idx, i.item_id, i.vec_id, i.label,
  case when i.label = 107 then 'foreign' when i.label in (8, 9) then 'unseen' when list_contains(s.removed, i.label)
   then 'removed' when list_contains(s.listed, i.label) then 'listed' else 'unlisted' end as reason
 from scenarios s join items i using (photo_id))""",
    "dims": """
select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as d from embeddings""",
    "mean_dims": "select label as class_id, d, avg(v) as m from dims group by 1, 2",
    "mean_units": """
select m.class_id, m.d, m.m / (n.n + 1e-9) as m from mean_dims m
join (select class_id, sqrt(sum(m*m)) as n from mean_dims group by 1) n using (class_id)""",
    "protos": """
select class_id, d, m / (sqrt(sum(m*m) over (partition by class_id)) + 1e-9) as m from mean_units
where class_id not in (8, 9)""",
    "sims": "select vec_id, class_id, sum(v*m) as s from dims join protos using (d) group by 1, 2",
    "decided": """
select *, s_in - s_out as margin, case when p_in >= 0.8 and s_in - s_out >= 0 then 'in' when p_in <= 0.3 then 'out'
  else 'uncertain' end as verdict
from (select vec_id, listed, p_raw, p_unknown, best_listed, best_any, coalesce(s_in, -1.0) as s_in,
   coalesce(s_out, -1.0) as s_out,
   1/(1+exp(-(0.9*ln(greatest(1e-6, least(1-1e-6, p_raw))/(1-greatest(1e-6, least(1-1e-6, p_raw)))) + 0.5))) as p_in
 from (select c.vec_id, c.listed,
   coalesce(sum(exp(s/0.08)) filter (list_contains(c.listed, class_id)), 0)/(sum(exp(s/0.08)) + exp(0.3/0.08)) as p_raw,
   exp(0.3/0.08)/(sum(exp(s/0.08)) + exp(0.3/0.08)) as p_unknown,
   max(s) filter (list_contains(c.listed, class_id)) as s_in, max(s) filter (not list_contains(c.listed, class_id)) as s_out,
   arg_max(class_id, s) filter (list_contains(c.listed, class_id)) as best_listed, arg_max(class_id, s) as best_any
  from asked c join sims using (vec_id) group by 1, 2))""",
    "asked": "select distinct vec_id, listed from told",
    "own_asked": """
select distinct i.vec_id, coalesce(l.listed, []) as listed from items i join photos p using (photo_id)
left join listed l on l.allowlist_id = p.allowlist_id""",
    "records": """
select t.scenario_id, t.kind, t.photo_id, t.item_idx, t.label, t.gt, t.reason, t.label in (select class_id from protos) as seen,
 t.vec_id % 13 <> 0 as detected, case when t.vec_id % 13 <> 0 then d.verdict else 'missed' end as verdict,
 case when t.vec_id % 13 <> 0 then round_even(d.p_in, 5) end as p_in,
 case when t.vec_id % 13 <> 0 then d.best_any end as best_any,
 case when t.vec_id % 13 <> 0 then d.best_listed end as best_listed, t.listed
from told t join decided d on d.vec_id = t.vec_id and d.listed = t.listed""",
    "candidates": f"""
select d.photo_id, d.det_id, d.score, list({{'iou': {iou_sql('d', 'i')}, 'i': i.item_idx}}) as c
from detections d join items i on i.photo_id = d.photo_id and {iou_sql('d', 'i')} >= 0.5 group by 1, 2, 3""",
    "turns": "select *, row_number() over (partition by photo_id order by score desc, det_id) as r from candidates",
    "walk": """
select photo_id, 0::bigint as r, []::int[] as used, null::varchar as det_id, null::int as item_idx, null::double as iou
from (select distinct photo_id from turns)
union all
select photo_id, r, case when b is null then used else list_append(used, b.i) end, det_id, b.i, b.iou from (
 select k.photo_id, k.r, w.used, k.det_id,
  list_sort(list_filter(k.c, lambda x: not list_contains(w.used, x.i)), 'desc')[1] as b
 from walk w join turns k on k.photo_id = w.photo_id and k.r = w.r + 1)""",
    "matches": "select photo_id, item_idx, det_id, iou from walk where item_idx is not null",
    "det_asked": "select distinct d.vec_id, s.listed from detections d join scenarios s using (photo_id)",
    "det_decided": """
select *, case when p_in >= 0.8 and coalesce(s_in, -1) - coalesce(s_out, -1) >= 0 then 'in' when p_in <= 0.3 then 'out'
  else 'uncertain' end as verdict
from (select *,
  1/(1+exp(-(0.9*ln(greatest(1e-6, least(1-1e-6, p_raw))/(1-greatest(1e-6, least(1-1e-6, p_raw)))) + 0.5))) as p_in
 from (select c.vec_id, c.listed,
   coalesce(sum(exp(s/0.08)) filter (list_contains(c.listed, class_id)), 0)/(sum(exp(s/0.08)) + exp(0.3/0.08)) as p_raw,
   max(s) filter (list_contains(c.listed, class_id)) as s_in, max(s) filter (not list_contains(c.listed, class_id)) as s_out,
   arg_max(class_id, s) as best_any
  from det_asked c join sims using (vec_id) group by 1, 2))""",
    "own_decided": """
select *, case when p_in >= 0.8 and coalesce(s_in, -1) - coalesce(s_out, -1) >= 0 then 'in' when p_in <= 0.3 then 'out'
  else 'uncertain' end as verdict
from (select *,
  1/(1+exp(-(0.9*ln(greatest(1e-6, least(1-1e-6, p_raw))/(1-greatest(1e-6, least(1-1e-6, p_raw)))) + 0.5))) as p_in
 from (select c.vec_id, c.listed,
   coalesce(sum(exp(s/0.08)) filter (list_contains(c.listed, class_id)), 0)/(sum(exp(s/0.08)) + exp(0.3/0.08)) as p_raw,
   max(s) filter (list_contains(c.listed, class_id)) as s_in, max(s) filter (not list_contains(c.listed, class_id)) as s_out,
   arg_max(class_id, s) as best_any
  from own_asked c join sims using (vec_id) group by 1, 2))""",
    "full_records": """
select t.scenario_id, t.kind, t.photo_id, t.item_idx, t.label, t.gt, t.reason, m.det_id is not null as detected,
 coalesce(d.verdict, 'missed') as verdict, round_even(d.p_in, 5) as p_in, d.best_any
from told t left join matches m using (photo_id, item_idx)
left join detections x on x.photo_id = t.photo_id and x.det_id = m.det_id
left join det_decided d on d.vec_id = x.vec_id and d.listed = t.listed""",
    "spurious": """
select s.scenario_id, x.photo_id, x.det_id, d.verdict, round_even(d.p_in, 5) as p_in, x.score as det_score
from detections x join scenarios s using (photo_id) join det_decided d on d.vec_id = x.vec_id and d.listed = s.listed
where not exists (select 1 from matches m where m.photo_id = x.photo_id and m.det_id = x.det_id)""",
    "states": """
select scenario_id, case max(level) when 2 then 'out' when 1 then 'uncertain' else 'ok' end as state,
 bool_or(wrong) as wrong
from (select scenario_id, case verdict when 'out' then 2 when 'uncertain' then 1 else 0 end as level, gt = 'out' as wrong
  from full_records union all
  select scenario_id, case verdict when 'out' then 2 when 'uncertain' then 1 else 0 end, null from spurious)
group by 1 having bool_or(wrong) is not null""",
    "cal": """
select t.scenario_id, t.item_idx, t.reason, case when t.gt = 'in' then 1 else 0 end as y_in, d.p_in, d.p_raw, t.vec_id,
 t.listed, t.label, t.scenario_id || '/' || lpad(cast(t.item_idx as varchar), 9, '0') as ord
from told t join decided d on d.vec_id = t.vec_id and d.listed = t.listed where t.reason <> 'unlisted'""",
}
_WORD = re.compile(r"[a-z_]+")


def _needs(text: str, found: list[str]) -> None:
    for word in _WORD.findall(text):
        if word in VIEWS and word not in found:
            found.append(word)
            _needs(VIEWS[word], found)


def with_views(body: str) -> str:
    """Prefix the SQL with the views it uses, in dependency order."""
    found: list[str] = []
    _needs(body, found)
    ordered = [v for v in VIEWS if v in found]
    placed: list[str] = []

    def place(name: str) -> None:
        if name in placed:
            return
        direct: list[str] = []
        for word in _WORD.findall(VIEWS[name]):
            if word in VIEWS and word != name and word not in direct:
                direct.append(word)
        for word in direct:
            place(word)
        placed.append(name)

    for name in ordered:
        place(name)
    body = body.strip()
    if not placed:
        return body
    views = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in placed)
    body = body.replace("with recursive ", "with ", 1) if body.startswith("with recursive ") else body
    own = f",\n{body[5:]}" if body.startswith("with ") else f"\n{body}"
    return f"with recursive {views}{own}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle over the shared views."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register
