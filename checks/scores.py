"""Vectors, decisions, metrics, calibration and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwarden import bridge
from listwarden.functions import decisions as D
from listwarden.functions.hashing import seeded_hash
from listwarden.functions.vectors import dot, unit
from listwarden.operators import agreement, calibration, metrics, prototypes, thresholds
from listwarden.operators.ordering import exact_quantiles
from listwarden.operators.similarity import class_similarities
from listwarden.plans import check, evaluate
from listwarden.plans.fit import fit_decision
from listwarden.session import durable, stored

from .base import query
from .sources import scenario_decisions
from .world import PARAMS, World

RATES = ("detection_recall", "abstain_rate", "coverage", "out_recall", "out_recall_strict", "out_accepted_rate",
         "false_alarm_rate", "false_alarm_rate_strict", "out_precision", "risk", "accuracy_decided")


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# --- flagship -------------------------------------------------------------------------------------------------

@query("q1_check_photos", """
select p.photo_id, count(i.item_idx) as n, count(*) filter (d.verdict = 'out') as n_out,
 count(*) filter (d.verdict = 'uncertain') as n_uncertain,
 case when count(i.item_idx) = 0 then 'none' when count(*) filter (d.verdict = 'out') > 0 then 'alert'
  when count(*) filter (d.verdict = 'uncertain') > 0 then 'unsure' else 'ok' end as banner
from photos p left join items i using (photo_id) left join listed l on l.allowlist_id = p.allowlist_id
left join own_decided d on d.vec_id = i.vec_id and d.listed = coalesce(l.listed, []) group by 1""")
def check_photos(spark, folder):
    w = World(spark, folder)
    return check.check_photos(w.embedded(w.items), w.own_list, w.prototypes, PARAMS)


# --- vectors --------------------------------------------------------------------------------------------------

@query("f02_dot_product", """
select vec_id, round(sum(v * w), 6) as d from (select vec_id, v, case d % 3 when 0 then 0.5 when 1 then -0.25 else 1 end as w
 from dims) group by 1""")
def _(spark, folder):
    weights = F.transform("embedding", lambda x, i: F.element_at(F.lit([-0.25, 1.0, 0.5]), i % 3 + 1))
    return World(spark, folder).vectors.select("vec_id", F.round(dot(F.col("embedding"), weights), 6).alias("d"))


@query("f03_unit_vectors", """
select vec_id, d - 1 as d, round(2 * v / (sqrt(sum(4 * v * v) over (partition by vec_id)) + 1e-9), 6) as v from dims""")
def _(spark, folder):
    doubled = F.transform("embedding", lambda x: x.cast("double") * 2)
    rows = World(spark, folder).vectors.select("vec_id", doubled.alias("v"))
    return rows.select("vec_id", F.posexplode(unit(F.col("v"))).alias("d", "v")).select("vec_id", "d", *r6("v"))


@query("f05_margin", """
select t.scenario_id, t.item_idx, round(d.margin, 6) as margin from told t
join decided d on d.vec_id = t.vec_id and d.listed = t.listed""")
def _(spark, folder):
    rows = scenario_decisions(World(spark, folder))
    return rows.select("scenario_id", "item_idx", *r6("margin"))


@query("f07_seeded_hash", "select o_orderkey, sha1('20260918:' || o_orderkey) as h from orders")
def _(spark, folder):
    return bridge.table(spark, folder, "orders").select("o_orderkey", seeded_hash(20260918, "o_orderkey").alias("h"))


@query("a11_class_means", "select class_id, d - 1 as d, round(m, 6) as v from mean_units")
def _(spark, folder):
    rows = World(spark, folder).class_means
    return rows.select("class_id", F.posexplode("vector").alias("d", "v")).select("class_id", "d", *r6("v"))


@query("a11_class_mean_table", """
select c.class_id, round(coalesce(sum(m.m * m.m), 0), 6) as squared, coalesce(max(n.n), 0) as n
from (select distinct p_partkey % 12 as class_id from part) c left join mean_units m using (class_id)
left join (select label, count(*) as n from embeddings group by 1) n on n.label = c.class_id group by 1""")
def _(spark, folder):
    classes = bridge.table(spark, folder, "part").select((F.col("p_partkey") % 12).cast("int").alias("class_id")).distinct()
    rows = prototypes.class_mean_table(World(spark, folder).vectors, classes, 64)
    return rows.select("class_id", F.round(dot(F.col("vector"), F.col("vector")), 6).alias("squared"), "n")


# Lloyd's algorithm from the same hash seeds, forty rounds for everyone, best of four starts.
CENTRES = """
with recursive big as (select label as class_id, count(*) // 8 as kc from embeddings group by 1 having count(*) // 8 >= 2),
points as (select e.vec_id, b.class_id, e.embedding::double[] as x, least(2, b.kc) as kc from embeddings e join big b on b.class_id = e.label),
lloyd as (
  select 0 as step, class_id, start, place - 1 as centre, x as c from (
    select p.*, start, row_number() over (partition by class_id, start
      order by sha1('0:' || start || ':' || class_id || ':' || vec_id), vec_id) as place
    from points p, (select unnest(range(4)) as start)) where place <= kc
  union all
  select step + 1, class_id, start, centre, list(v order by d) from (
    select step, class_id, start, centre, d, avg(v) as v from (
      select step, class_id, start, centre, unnest(x) as v, generate_subscripts(x, 1) as d from (
        select l.step, l.class_id, l.start, p.vec_id, any_value(p.x) as x, arg_min(l.centre, list_distance(p.x, l.c)) as centre
        from lloyd l join points p using (class_id) where l.step < 40 group by 1, 2, 3, 4))
    group by 1, 2, 3, 4, 5) group by 1, 2, 3, 4),
costs as (select class_id, start, sum(d) as cost from (
  select l.class_id, l.start, p.vec_id, min(list_distance(p.x, l.c) ** 2) as d from lloyd l join points p using (class_id)
  where l.step = 40 group by 1, 2, 3) group by 1, 2),
winners as (select class_id, arg_min(start, round(cost, 9) * 1000000 + start * 1e-6) as start from costs group by 1),
several as (
  select class_id, 0 as proto_no, d, m as v from mean_units union all
  select class_id, centre + 1, d, v / (sqrt(sum(v * v) over (partition by class_id, centre)) + 1e-9) from (
    select l.class_id, l.centre, unnest(l.c) as v, generate_subscripts(l.c, 1) as d
    from lloyd l join winners w using (class_id, start) where l.step = 40)),
nearest as (select vec_id, class_id, max(s) as s from (
  select vec_id, class_id, proto_no, sum(x.v * y.v) as s from dims x join (
    select class_id, proto_no, d, v / (sqrt(sum(v * v) over (partition by class_id, proto_no)) + 1e-9) as v from several) y using (d)
  group by 1, 2, 3) group by 1, 2)
"""


@query("a12_prototypes", CENTRES + "select class_id, proto_no, d - 1 as d, round(v, 6) as v from several")
def _(spark, folder):
    rows = prototypes.build_prototypes(World(spark, folder).vectors)
    return rows.select("class_id", "proto_no", F.posexplode("vector").alias("d", "v")).select("class_id", "proto_no", "d", *r6("v"))


@query("a13_several_prototypes", CENTRES + "select vec_id, class_id, round(s, 6) as s from nearest")
def _(spark, folder):
    """Classes with centres: the best of several vectors per class counts."""
    w = World(spark, folder)
    several = durable(prototypes.build_prototypes(w.vectors))
    ids = [r[0] for r in several.select("class_id").distinct().orderBy("class_id").collect()]
    rows = class_similarities(w.vectors, several, ["vec_id"]).select("vec_id", F.posexplode("sims").alias("slot", "s"))
    return rows.select("vec_id", F.element_at(F.lit(ids).cast("array<int>"), F.col("slot") + 1).alias("class_id"), *r6("s"))


@query("a34_accuracy_with_centres", CENTRES + """
select round(avg(case when p.c = e.label then 1.0 else 0.0 end), 6) as accuracy from
(select vec_id, arg_max(class_id, s) as c from nearest group by 1) p join embeddings e using (vec_id)""")
def _(spark, folder):
    w = World(spark, folder)
    return prototypes.nearest_accuracy(w.vectors, durable(prototypes.build_prototypes(w.vectors))).select(*r6("accuracy"))


@query("a13_class_similarity", "select vec_id, class_id, round(s, 6) as s from sims")
def _(spark, folder):
    w = World(spark, folder)
    rows = class_similarities(w.vectors, w.prototypes, ["vec_id"])
    return rows.select("vec_id", F.posexplode("sims").alias("class_id", "s")).select("vec_id", "class_id", *r6("s"))


@query("j07_vector_prototypes", """
select vec_id, round(max(s), 6) as best, round(min(s), 6) as worst, count(*) as n_classes from sims group by 1""")
def _(spark, folder):
    w = World(spark, folder)
    rows = class_similarities(w.vectors, w.prototypes, ["vec_id"])
    return rows.select("vec_id", F.round(F.array_max("sims"), 6).alias("best"),
                       F.round(F.array_min("sims"), 6).alias("worst"), F.size("sims").alias("n_classes"))


@query("j08_listed_slots", """
select scenario_id, item_idx, array_to_string(list_sort(list_filter(listed, lambda c: c in (0,1,2,3,4,5,6,7))), ',') as slots
from cal""")
def _(spark, folder):
    rows = World(spark, folder).calibration
    return rows.select("scenario_id", "item_idx", F.array_join("slots", ",").alias("slots"))


@query("a14_probabilities", """
select t.scenario_id, t.item_idx, round(d.p_in, 6) as p_in, round(d.p_unknown, 6) as p_unknown from told t
join decided d on d.vec_id = t.vec_id and d.listed = t.listed""")
def _(spark, folder):
    return scenario_decisions(World(spark, folder)).select("scenario_id", "item_idx", *r6("p_in", "p_unknown"))


@query("a15_without_unknown", """
select c.scenario_id, c.item_idx, round(coalesce(sum(exp(s*30)) filter (list_contains(c.listed, class_id)), 0)/sum(exp(s*30)), 6)
 as p_in from cal c join sims using (vec_id) group by 1, 2""")
def _(spark, folder):
    rows = calibration.with_p_in(World(spark, folder).calibration, calibration.before_params())
    return rows.select("scenario_id", "item_idx", *r6("p_in"))


@query("a16_best_classes", """
select t.scenario_id, t.item_idx, d.best_listed, d.best_any, round(d.s_in, 6) as s_in, round(d.s_out, 6) as s_out from told t
join decided d on d.vec_id = t.vec_id and d.listed = t.listed""")
def _(spark, folder):
    rows = scenario_decisions(World(spark, folder))
    return rows.select("scenario_id", "item_idx", "best_listed", "best_any", *r6("s_in", "s_out"))


@query("f01_platt", """
select scenario_id, item_idx, round(p_in, 6) as p_in, round(p_raw, 6) as identity from cal""")
def _(spark, folder):
    rows = World(spark, folder).calibrated
    return rows.select("scenario_id", "item_idx", F.round(D.platt(F.col("p_raw"), 0.9, 0.5), 6).alias("p_in"),
                       F.round(D.platt(F.col("p_raw"), 1.0, 0.0), 6).alias("identity"))


@query("y01_replaced_params", """
select t.scenario_id, t.item_idx, case when d.p_in >= 0.6 and d.margin >= 0.05 then 'in' when d.p_in <= 0.4 then 'out'
 else 'uncertain' end as verdict from told t join decided d on d.vec_id = t.vec_id and d.listed = t.listed""")
def _(spark, folder):
    changed = PARAMS.with_(theta_in=0.6, theta_out=0.4, margin=0.05)
    return scenario_decisions(World(spark, folder), changed).select("scenario_id", "item_idx", "verdict")


@query("j13_scenario_fan_out", """
select s.kind, count(*) as n, round(avg(d.p_in), 6) as mean_p from told t join scenarios s using (scenario_id)
join decided d on d.vec_id = t.vec_id and d.listed = t.listed group by 1""")
def _(spark, folder):
    w = World(spark, folder)
    rows = scenario_decisions(w).join(w.scenarios.select("scenario_id", "kind"), "scenario_id")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_in"), 6).alias("mean_p"))


@query("a34_nearest_accuracy", """
select round(avg(case when p.c = e.label then 1.0 else 0.0 end), 6) as accuracy from
(select vec_id, arg_max(class_id, s) as c from sims group by 1) p join embeddings e using (vec_id)""")
def _(spark, folder):
    w = World(spark, folder)
    return prototypes.nearest_accuracy(w.vectors, w.prototypes).select(*r6("accuracy"))


def shifted_vectors(w: World):
    """A second run of the same vectors, slightly off."""
    moved = F.transform("embedding", lambda x, i: x + F.when(i % 4 == 0, 0.02).otherwise(0.0).cast("float"))
    return w.vectors.filter(F.col("vec_id") % 5 != 0).select("vec_id", moved.alias("embedding"))


COSINE_SQL = "select avg(s) as cosine from (select vec_id, sum(v * (v + case when (d - 1) % 4 = 0 then 0.02 else 0 end)) as s " \
             "from dims where vec_id % 5 <> 0 group by 1)"


@query("a37_mean_cosine", f"select round(cosine, 6) as cosine from ({COSINE_SQL})")
def _(spark, folder):
    w = World(spark, folder)
    return agreement.mean_cosine(w.vectors, shifted_vectors(w), "vec_id").select(*r6("cosine"))


# --- calibration and thresholds ----------------------------------------------------------------------------------

@query("j06_calibration_items", "select scenario_id, item_idx, reason, y_in from cal")
def _(spark, folder):
    return World(spark, folder).calibration.select("scenario_id", "item_idx", "reason", "y_in")


@query("a42_calibration_set", """
select c.scenario_id, c.item_idx, c.y_in, c.label between 0 and 7 as seen, round(s.top, 6) as top, round(s.total, 6) as total
from cal c join (select vec_id, max(s) as top, sum(s) as total from sims group by 1) s using (vec_id)""")
def _(spark, folder):
    rows = World(spark, folder).calibration
    total = F.aggregate("sims", F.lit(0.0), lambda t, s: t + s)
    return rows.select("scenario_id", "item_idx", "y_in", "seen", F.round(F.array_max("sims"), 6).alias("top"),
                       F.round(total, 6).alias("total"))


NLL = "avg(-(y_in*ln(greatest(1e-7, least(1-1e-7, {p}))) + (1-y_in)*ln(1-greatest(1e-7, least(1-1e-7, {p})))))"


@query("a17_likelihood", f"select round({NLL.format(p='p_in')}, 6) as nll, count(*) as n from cal")
def _(spark, folder):
    rows = World(spark, folder).calibrated
    return rows.agg(F.round(calibration.clipped_nll(F.col("p_in"), F.col("y_in")), 6).alias("nll"),
                    F.count(F.lit(1)).alias("n"))


BINS_SQL = """
select e.bin, round(e.lo, 6) as lo, round(e.hi, 6) as hi, count(c.p_in) as n, round(avg(c.p_in), 6) as conf,
 round(avg(c.y_in), 6) as acc
from (select b as bin, b * (1.0::double/15) as lo, (b + 1) * (1.0::double/15) as hi from (select unnest(range(15)) as b)) e
left join cal c on (c.p_in > e.lo or (e.bin = 0 and c.p_in >= 0)) and c.p_in <= e.hi group by 1, 2, 3"""


@query("a18_calibration_bins", BINS_SQL)
def _(spark, folder):
    rows = calibration.calibration_bins(World(spark, folder).calibrated)
    return rows.select("bin", *r6("lo", "hi"), "n", *r6("conf", "acc"))


ECE = "select sum(abs(sp - sy)) / sum(n) as ece from (select least(14, greatest(0, ceil({p}*15) - 1)) as b, sum({p}) as sp, " \
      "sum(y_in) as sy, count(*) as n from {t} group by 1)"


@query("a18_calibration_error", f"select round(ece, 6) as ece from ({ECE.format(p='p_in', t='cal')})")
def _(spark, folder):
    binned = calibration.calibration_bins(World(spark, folder).calibrated)
    return calibration.calibration_error(binned).select(*r6("ece"))


@query("a46_reliability", f"""
select bin, round((bin * (1.0::double/15) + (bin + 1) * (1.0::double/15)) / 2, 6) as centre, acc as share, n from ({BINS_SQL}) where n > 0""")
def _(spark, folder):
    rows = calibration.reliability(calibration.calibration_bins(World(spark, folder).calibrated))
    return rows.select("bin", *r6("centre", "share"), "n")


@query("a19_calibration_report", f"""
with plain as (select c.scenario_id, c.item_idx, c.y_in, coalesce(sum(exp(s*30)) filter (list_contains(c.listed, class_id)), 0)
  / sum(exp(s*30)) as p_b from cal c join sims using (vec_id) group by 1, 2, 3)
select 'after' as phase, count(*) as n, round({NLL.format(p='p_in')}, 6) as nll,
 (select round(ece, 6) from ({ECE.format(p='p_in', t='cal')})) as ece from cal
union all select 'before', count(*), round({NLL.format(p='p_b')}, 6), (select round(ece, 6) from ({ECE.format(p='p_b', t='plain')}))
from plain""")
def _(spark, folder):
    rows = calibration.calibration_report(World(spark, folder).calibration, PARAMS)
    return rows.select("phase", "n", *r6("nll", "ece"))


# The best point of grids of 81 points, each around the best of the one before and a little finer.
FIT = """
with recursive asked_once as (select vec_id, listed, sum(y_in) as y, count(*) as n from cal group by 1, 2),
terms as (select c.vec_id, c.listed, c.y, c.n, s.s, list_contains(c.listed, s.class_id) as own from asked_once c join sims s using (vec_id)),
fit as (
  select 0 as step, ln(0.06)::double as log_t, 0.4::double as b, 2.0::double as rt, 1.0::double as rb, null::double as nll
  union all
  select step + 1, arg_min(log_t, nll), arg_min(b, nll), rt * 0.4, rb * 0.4, min(nll) from (
    select step, log_t, b, rt, rb, sum(-(y * ln(p) + (n - y) * ln(1 - p))) / sum(n) as nll from (
      select step, log_t, b, rt, rb, y, n, greatest(1e-7, least(1 - 1e-7, own_mass / (mass + exp(b / exp(log_t))))) as p from (
        select f.step, f.log_t + (i - 4) / 4.0::double * f.rt as log_t, f.rt, f.rb, f.b as middle, t.vec_id, t.listed, t.y, t.n,
         sum(exp(t.s / exp(f.log_t + (i - 4) / 4.0::double * f.rt))) as mass,
         coalesce(sum(exp(t.s / exp(f.log_t + (i - 4) / 4.0::double * f.rt))) filter (t.own), 0) as own_mass
        from fit f, (select unnest(range(9)) as i), terms t where f.step < 10 group by all),
       (select unnest(range(9)) as j), lateral (select middle + (j - 4) / 4.0::double * rb as b))
    group by 1, 2, 3, 4, 5) group by step, rt, rb),
fitted as (select log_t, b, nll from fit where step = 10)"""


@query("a20_fitted_temperature", FIT + """
select round(nll, 6) as nll, round(exp(log_t), 3) as temperature, round(b, 2) as unknown_bias from fitted""")
def _(spark, folder):
    fixed = stored(World(spark, folder).calibration.select("sims", "slots", "y_in"))
    fitted = calibration.fit_temperature_and_bias(fixed, stored=True)
    before = calibration.with_p_in(fixed, fitted)
    return before.agg(F.round(calibration.clipped_nll(F.col("p_in"), F.col("y_in")), 6).alias("nll"),
                      F.round(F.lit(fitted.temperature), 3).alias("temperature"), F.round(F.lit(fitted.unknown_bias), 2).alias("unknown_bias"))


@query("a21_fitted_platt", """
with recursive pts as (select ln(q / (1 - q)) as x, y_in::double as y from (
  select greatest(1e-6, least(1 - 1e-6, p_raw)) as q, y_in from cal)),
newton as (select 0 as step, 1.0::double as a, 0.0::double as b
  union all
  select step + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  from (select step, a, b, sum(x * (y - p)) as g1, sum(y - p) as g2, sum(p * (1 - p) * x * x) as h11,
    sum(p * (1 - p) * x) as h12, sum(p * (1 - p)) as h22
    from (select step, a, b, x, y, 1 / (1 + exp(-(a * x + b))) as p from newton, pts where step < 12) group by 1, 2, 3)),
best as (select a, b from newton where step = 12),
fitted as (select greatest(1e-7, least(1 - 1e-7, 1 / (1 + exp(-(a * x + b))))) as p, y, a, b from pts, best)
select round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as nll, round(any_value(a), 3) as platt_a,
 round(any_value(b), 3) as platt_b from fitted""")
def _(spark, folder):
    rows = World(spark, folder).calibrated
    a, b = calibration.fit_platt(rows, p="p_raw")
    fitted = rows.agg(calibration.clipped_nll(D.platt(F.col("p_raw"), a, b), F.col("y_in")).alias("nll"))
    return fitted.select(*r6("nll"), F.round(F.lit(a), 3).alias("platt_a"), F.round(F.lit(b), 3).alias("platt_b"))


# The whole fit: the point above, then the sigmoid by Newton's method, then the grid of thresholds.
DECISION = FIT + """,
raw as (select t.vec_id, t.listed, any_value(t.y) as y, any_value(t.n) as n, greatest(1e-6, least(1 - 1e-6,
  coalesce(sum(exp(t.s / exp(f.log_t))) filter (t.own), 0) / (sum(exp(t.s / exp(f.log_t))) + exp(any_value(f.b) / exp(any_value(f.log_t)))))) as q
  from terms t, fitted f group by 1, 2),
pts as (select ln(q / (1 - q)) as x, y, n from raw),
newton as (select 0 as step, 1.0::double as a, 0.0::double as b
  union all
  select step + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12)
  from (select step, a, b, sum(x * (y - n * p)) as g1, sum(y - n * p) as g2, sum(n * p * (1 - p) * x * x) as h11,
    sum(n * p * (1 - p) * x) as h12, sum(n * p * (1 - p)) as h22
    from (select step, a, b, x, y, n, 1 / (1 + exp(-(a * x + b))) as p from newton, pts where step < 12) group by 1, 2, 3)),
scored as (select 1 / (1 + exp(-(a * x + b))) as p, y, n, a, b from pts, newton where step = 12),
ticks as (select unnest(range(41)) as i), edge as (select i, i * 0.025::double as t from ticks),
cells as (select lo.i as lo, hi.i as hi, lo.t as theta_out, hi.t as theta_in,
  sum(n - y) filter (p <= lo.t) as oo, sum(n - y) filter (p > lo.t and p >= hi.t) as io,
  sum(y) filter (p <= lo.t) as oi, sum(y) filter (p > lo.t and p >= hi.t) as ii, sum(n) as n
  from edge lo join edge hi on lo.i <= hi.i cross join scored group by all),
pairs as (select lo, hi, theta_out, theta_in, (n - coalesce(oo,0) - coalesce(io,0) - coalesce(oi,0) - coalesce(ii,0)) / n::double as abstain_rate,
  coalesce(oo,0) / greatest(1, coalesce(oo,0) + coalesce(io,0))::double as out_recall,
  coalesce(oi,0) / greatest(1, coalesce(oi,0) + coalesce(ii,0))::double as false_alarm_rate,
  (coalesce(oi,0) + coalesce(io,0)) / greatest(1, coalesce(oo,0) + coalesce(io,0) + coalesce(oi,0) + coalesce(ii,0))::double as risk from cells),
caps as (select unnest(range(17)) as i),
ok as (select p.*, case when false_alarm_rate <= 0.1 and out_recall >= 0.95 then
  (select min(i) from caps where abstain_rate <= 0.2 + 0.05 * i + 1e-12) end as step from pairs p),
pool as (select * from ok where step <= (select min(step) from ok) union all
 select * from ok where (select min(step) from ok) is null and false_alarm_rate <= 0.1 and abstain_rate <= 0.2 + 1e-12)
select round(nll, 5) as nll, (select round(sum(-(y * ln(greatest(1e-7, least(1 - 1e-7, p))) + (n - y) * ln(1 - greatest(1e-7, least(1 - 1e-7, p)))))
  / sum(n), 5) from scored) as nll_after, (select round(any_value(a), 2) from scored) as platt_a, (select round(any_value(b), 2) from scored) as platt_b,
 (select count(*) from pool) as n_feasible, t.theta_in, t.theta_out, round(t.risk, 2) as risk, round(t.abstain_rate, 2) as abstain_rate
from fitted, (select round(theta_in, 6) as theta_in, round(theta_out, 6) as theta_out, risk, abstain_rate from pool
 order by pool.risk, pool.out_recall desc, pool.abstain_rate, lo, hi limit 1) t"""


@query("e02_fitted_decision", DECISION)
def _(spark, folder):
    """Scenarios to decision parameters over the whole tables: temperature and bias, sigmoid, thresholds."""
    fixed = stored(World(spark, folder).calibration.select("scenario_id", "item_idx", "sims", "slots", "y_in", "reason"))
    fit = fit_decision(fixed, stored=True)
    p = fit.params
    before = calibration.with_p_in(fixed.select("y_in", "sims", "slots"), p.with_(platt_a=1.0, platt_b=0.0)).agg(
        F.round(calibration.clipped_nll(F.col("p_in"), F.col("y_in")), 5).alias("nll"))
    after = fit.calibration.filter("phase = 'after'").select(F.round("nll", 5).alias("nll_after"))
    chosen = fit.thresholds.filter("choice = 'lowest_risk'").select(
        F.round(F.lit(p.platt_a), 2).alias("platt_a"), F.round(F.lit(p.platt_b), 2).alias("platt_b"), "n_feasible",
        *r6("theta_in", "theta_out"), F.round("risk", 2).alias("risk"), F.round("abstain_rate", 2).alias("abstain_rate"))
    return before.crossJoin(after).crossJoin(chosen)        # one row each


def selective_sql(low: str, high: str, source: str, by: str = "") -> str:
    """The twelve numbers in SQL; "out" wins on the diagonal."""
    v = f"case when p_in <= {low} then 'out' when p_in >= {high} then 'in' else 'uncertain' end"
    keys = f"{by}, " if by else ""
    return f"""
select {keys}count(*) as n, count(*) filter (y_in = 0) as n_out, count(*) filter (y_in = 1) as n_in,
 round(count(*) filter (v = 'uncertain') / greatest(1, count(*))::double, 6) as abstain_rate,
 round(count(*) filter (v <> 'uncertain') / greatest(1, count(*))::double, 6) as coverage,
 round(count(*) filter (v = 'out' and y_in = 0) / greatest(1, count(*) filter (v <> 'uncertain' and y_in = 0))::double, 6) as out_recall,
 round(count(*) filter (v = 'out' and y_in = 0) / greatest(1, count(*) filter (y_in = 0))::double, 6) as out_recall_strict,
 round(count(*) filter (v = 'out' and y_in = 1) / greatest(1, count(*) filter (v <> 'uncertain' and y_in = 1))::double, 6) as false_alarm_rate,
 round(count(*) filter (v = 'out' and y_in = 1) / greatest(1, count(*) filter (y_in = 1))::double, 6) as false_alarm_rate_strict,
 round(count(*) filter (v = 'out' and y_in = 0) / greatest(1, count(*) filter (v = 'out'))::double, 6) as out_precision,
 round(count(*) filter ((v = 'out') = (y_in = 1) and v <> 'uncertain') / greatest(1, count(*) filter (v <> 'uncertain'))::double, 6) as risk,
 round(1 - count(*) filter ((v = 'out') = (y_in = 1) and v <> 'uncertain') / greatest(1, count(*) filter (v <> 'uncertain'))::double, 6)
  as accuracy_decided
from (select *, {v} as v from {source}) group by {by or 'all'}"""


SELECTIVE = ("abstain_rate", "coverage", "out_recall", "out_recall_strict", "false_alarm_rate",
             "false_alarm_rate_strict", "out_precision", "risk", "accuracy_decided")


@query("a22_selective_metrics", selective_sql("0.3", "0.8", "cal"))
def _(spark, folder):
    rows = thresholds.selective_metrics(World(spark, folder).calibrated, 0.8, 0.3)
    return rows.select("n", "n_out", "n_in", *r6(*SELECTIVE))


@query("a43_metrics_by_reason", selective_sql("0.3", "0.8", "cal", "reason"))
def _(spark, folder):
    rows = thresholds.selective_metrics(World(spark, folder).calibrated, 0.8, 0.3, ["reason"])
    return rows.select("reason", "n", "n_out", "n_in", *r6(*SELECTIVE))


@query("a43_no_reject", selective_sql("0.5", "0.5", "cal"))
def _(spark, folder):
    rows = thresholds.selective_metrics(World(spark, folder).calibrated, 0.5, 0.5)
    return rows.select("n", "n_out", "n_in", *r6(*SELECTIVE))


GRID = """
pts as (select unnest(range(41)) as i), edge as (select i, i * 0.025::double as t from pts),
few as (select p_in, y_in, count(*) as k from cal group by 1, 2),
cells as (select lo.i as lo, hi.i as hi, lo.t as theta_out, hi.t as theta_in,
  sum(k) filter (p_in <= lo.t and y_in = 0) as oo, sum(k) filter (p_in > lo.t and p_in >= hi.t and y_in = 0) as io,
  sum(k) filter (p_in <= lo.t and y_in = 1) as oi, sum(k) filter (p_in > lo.t and p_in >= hi.t and y_in = 1) as ii,
  sum(k) as n from edge lo join edge hi on lo.i <= hi.i cross join few group by all),
grid as (select lo, hi, theta_out, theta_in, (n - coalesce(oo,0) - coalesce(io,0) - coalesce(oi,0) - coalesce(ii,0)) / n::double as abstain_rate,
  coalesce(oo,0) / greatest(1, coalesce(oo,0) + coalesce(io,0))::double as out_recall,
  coalesce(oi,0) / greatest(1, coalesce(oi,0) + coalesce(ii,0))::double as false_alarm_rate,
  (coalesce(oi,0) + coalesce(io,0)) / greatest(1, coalesce(oo,0) + coalesce(io,0) + coalesce(oi,0) + coalesce(ii,0))::double as risk
 from cells)"""


@query("a23_threshold_grid", f"""
with {GRID}
select lo, hi, round(theta_out, 6) as theta_out, round(theta_in, 6) as theta_in, round(abstain_rate, 6) as abstain_rate,
 round(out_recall, 6) as out_recall, round(false_alarm_rate, 6) as false_alarm_rate, round(risk, 6) as risk from grid""")
def _(spark, folder):
    rows = thresholds.threshold_grid(World(spark, folder).calibrated)
    return rows.select("lo", "hi", *r6("theta_out", "theta_in", "abstain_rate", "out_recall", "false_alarm_rate", "risk"))


@query("y05_feasible_thresholds", f"""
with {GRID} select lo, hi from grid where false_alarm_rate <= 0.6 and abstain_rate <= 0.9 and out_recall >= 0.5""")
def _(spark, folder):
    rows = thresholds.threshold_grid(World(spark, folder).calibrated)
    return thresholds.feasible(rows, 0.6, 0.9, 0.5).select("lo", "hi")


@query("a24_threshold_choice", f"""
with {GRID}, caps as (select unnest(range(17)) as i),
ok as (select g.*, case when false_alarm_rate <= 0.3 and out_recall >= 0.95 then
  (select min(i) from caps where abstain_rate <= 0.2 + 0.05 * i + 1e-12) end as step from grid g),
pool as (select * from ok where step <= (select min(step) from ok))
(select 'lowest_risk' as choice, round(theta_in, 6) as theta_in, round(theta_out, 6) as theta_out, round(risk, 6) as risk,
  round(abstain_rate, 6) as abstain_rate, (select count(*) from pool) as n_feasible,
  round(0.2 + 0.05 * (select min(step) from ok), 6)::double as max_abstain_used
 from pool order by pool.risk, pool.out_recall desc, pool.abstain_rate, lo, hi limit 1)
union all
(select 'most_recall', round(theta_in, 6), round(theta_out, 6), round(risk, 6), round(abstain_rate, 6), (select count(*) from pool),
  round(0.2 + 0.05 * (select min(step) from ok), 6)::double
 from pool order by pool.out_recall desc, pool.abstain_rate, pool.false_alarm_rate, lo, hi limit 1)""")
def _(spark, folder):
    rows = thresholds.choose_thresholds(World(spark, folder).calibrated, max_false_alarm=0.3)
    return rows.select("choice", *r6("theta_in", "theta_out", "risk", "abstain_rate"), "n_feasible",
                       *r6("max_abstain_used"))


@query("w03_risk_coverage", """
with few as (select round(p_in, 6) as p_in, y_in, ord from cal),
ranked as (select row_number() over w as place, sum(case when (p_in >= 0.5) <> (y_in = 1) then 1 else 0 end) over w as errors,
 count(*) over () as n from few window w as (order by greatest(p_in, 1 - p_in) desc, ord rows unbounded preceding))
select distinct place, round(place / n::double, 6) as coverage, round(errors / place::double, 6) as risk from ranked
where place in (select least(n, greatest(1, cast(round_even(1 + i * ((n - 1) / 49.0::double), 0) as bigint)))
 from (select unnest(range(50)) as i), (select count(*) as n from cal))""")
def _(spark, folder):
    rows = thresholds.risk_coverage(thresholds.rounded(World(spark, folder).calibrated, 6), "ord")
    return rows.select("place", *r6("coverage", "risk"))


@query("w03_area_under_curve", """
with few as (select round(p_in, 6) as p_in, y_in, ord from cal),
ranked as (select row_number() over w as place, sum(case when (p_in >= 0.5) <> (y_in = 1) then 1 else 0 end) over w as errors
 from few window w as (order by greatest(p_in, 1 - p_in) desc, ord rows unbounded preceding))
select round(avg(errors / place::double), 6) as aurc, round(max(errors) / max(place)::double, 6) as full_coverage_risk from ranked""")
def _(spark, folder):
    rows = thresholds.area_under_curve(thresholds.rounded(World(spark, folder).calibrated, 6), "ord")
    return rows.select(*r6("aurc", "full_coverage_risk"))


# --- records and metrics -----------------------------------------------------------------------------------------

def rates_sql(source: str, key: str, value: str) -> str:
    out, det = "gt = 'out'", "detected"
    n = lambda c: f"count(*) filter ({c})"                                             # noqa: E731
    rate = lambda a, b: f"round({n(a)} / greatest(1, {n(b)})::double, 6)"              # noqa: E731
    decided, wrong = "verdict in ('in', 'out')", f"((verdict = 'out' and gt = 'in') or (verdict = 'in' and {out}))"
    return f"""
select {value} as {key}, count(*) as n, {n(out)} as n_out, {n("gt = 'in'")} as n_in, {rate(det, 'true')} as detection_recall,
 {rate("verdict = 'uncertain'", det)} as abstain_rate, {rate(decided, det)} as coverage,
 {rate("verdict = 'out' and " + out, decided + ' and ' + out)} as out_recall,
 {rate("verdict = 'out' and " + out, out)} as out_recall_strict,
 {rate("verdict = 'in' and " + out, det + ' and ' + out)} as out_accepted_rate,
 {rate("verdict = 'out' and gt = 'in'", decided + " and gt = 'in'")} as false_alarm_rate,
 {rate("verdict = 'out' and gt = 'in'", "gt = 'in'")} as false_alarm_rate_strict,
 {rate("verdict = 'out' and " + out, "verdict = 'out'")} as out_precision, {rate(wrong, decided)} as risk,
 round(1 - {n(wrong)} / greatest(1, {n(decided)})::double, 6) as accuracy_decided
from {source} group by {value}"""


HEAD = "(select * from records where reason in ('listed', 'removed', 'foreign', 'unseen'))"
FORCED = "(select * replace (case when p_in >= 0.5 then 'in' else 'out' end as verdict) from records " \
         "where reason in ('listed', 'removed', 'foreign', 'unseen') and detected and p_in is not null)"
SLICES = " union all ".join([
    rates_sql("records", "slice", "'all'"), rates_sql(HEAD, "slice", "'headline'"),
    rates_sql(f"(select * from {HEAD} where reason <> 'foreign' and seen)", "slice", "'seen'"),
    rates_sql(f"(select * from {HEAD} where reason <> 'foreign' and not seen)", "slice", "'unseen'"),
    rates_sql(FORCED, "slice", "'no_reject'"), rates_sql("records", "slice", "'reason:' || reason"),
    rates_sql("records", "slice", "'kind:' || kind"),
])


@query("j11_records", """
select scenario_id, kind, photo_id, item_idx, label, gt, reason, seen, detected, verdict, p_in, best_any,
 best_listed from records""")
def _(spark, folder):
    return World(spark, folder).records.select(
        "scenario_id", "kind", "photo_id", "item_idx", "label", "gt", "reason", "seen", "detected", "verdict",
        "p_in", "best_any", "best_listed")


@query("a25_record_rates", rates_sql("records", "kind", "kind"))
def _(spark, folder):
    rows = metrics.record_rates(World(spark, folder).records, ["kind"])
    return rows.select("kind", "n", "n_out", "n_in", *r6(*RATES))


@query("a26_record_slices", SLICES)
def _(spark, folder):
    rows = metrics.record_slices(World(spark, folder).records)
    return rows.select("slice", "n", "n_out", "n_in", *r6(*RATES))


REPORTED = ("n", "detection_recall", "abstain_rate", "coverage", "out_recall", "out_accepted_rate", "false_alarm_rate", "risk")
REPORT = f"""
with s as (select p_in, case when gt = 'in' then 1 else 0 end as y,
  scenario_id || '/' || lpad(item_idx::varchar, 19, '0') as ord from {HEAD} where detected and p_in is not null),
b as (select least(14, greatest(0, ceil(p_in * 15) - 1))::int as bin, count(*) as n, avg(p_in) as conf, avg(y) as acc
  from s group by 1),
r as (select row_number() over w as place, sum(case when (p_in >= 0.5) <> (y = 1) then 1 else 0 end) over w as errors,
  count(*) over () as n from s window w as (order by greatest(p_in, 1 - p_in) desc, ord rows unbounded preceding)),
c as (select distinct place, place / n::double as coverage, errors / place::double as risk from r
  where place in (select least(n, greatest(1, cast(round_even(1 + i * ((n - 1) / 49.0::double), 0) as bigint)))
  from (select unnest(range(50)) as i), (select count(*) as n from s))),
a as ({SLICES}),
rows as (
{" union all ".join(f"select 'slice' as section, slice as key, '{m}' as metric, {m}::double as value from a" for m in REPORTED)}
union all select 'calibration', '', 'ece', sum(n * abs(conf - acc)) / sum(n) from b
{" ".join(f"union all select 'bin', bin::varchar, '{m}', {m}::double from b" for m in ("n", "conf", "acc"))}
{" ".join(f"union all select 'curve', place::varchar, '{m}', {m} from c" for m in ("coverage", "risk"))}
union all select 'area', '', 'aurc', avg(errors / place::double) from r
union all select 'area', '', 'full_coverage_risk', max(errors) / max(place)::double from r)
select section, key, metric, round(value, 6) as value from rows"""


@query("e01_evaluation_report", REPORT)
def _(spark, folder):
    return evaluate.report(World(spark, folder).records).select("section", "key", "metric", *r6("value"))


CONFUSED = "detected and best_any is not null and label >= 0 and label <> best_any and reason in ('listed', 'removed')"


@query("a27_confusion_pairs", f"""
select c.label as true, coalesce(a.name, c.label::varchar) as true_name, c.best_any as predicted,
 coalesce(b.name, c.best_any::varchar) as predicted_name, c.n as count, round(c.n / t.n::double, 6) as share_of_true
from (select label, best_any, count(*) as n from records where {CONFUSED} group by 1, 2 order by 3 desc, 1, 2 limit 15) c
join (select label, count(*) as n from records where reason in ('listed', 'removed') group by 1) t using (label)
left join class_names a on a.class_id = c.label left join class_names b on b.class_id = c.best_any""")
def _(spark, folder):
    from listwarden.operators import catalog

    names = catalog.class_names(catalog.name_votes(bridge.name_lines(spark, folder), ["line_no"]))
    rows = metrics.confusion_pairs(World(spark, folder).records, names)
    return rows.select("true", "true_name", "predicted", "predicted_name", "count", *r6("share_of_true"))


@query("w09_confusion_examples", f"""
with top as (select label, best_any from records where {CONFUSED} group by 1, 2 order by count(*) desc, 1, 2 limit 6)
select scenario_id, item_idx, label, best_any, example_no from (select r.*, row_number() over (partition by r.label, r.best_any
 order by scenario_id, item_idx) as example_no from records r join top using (label, best_any)) where example_no <= 4""")
def _(spark, folder):
    records = World(spark, folder).records.select("scenario_id", "item_idx", "label", "best_any", "detected", "reason")
    rows = metrics.confusion_examples(records, [F.col("scenario_id"), F.col("item_idx")])
    return rows.select("scenario_id", "item_idx", "label", "best_any", "example_no")


@query("a28_naming", """
with known as (select * from records where reason in ('listed', 'removed') and seen and detected)
select (select count(*) from (select distinct photo_id, item_idx from known)) as n_items,
 (select round(avg(case when best_any = label then 1.0 else 0.0 end), 6) from (select distinct photo_id, item_idx, best_any, label
  from known)) as accuracy,
 count(*) filter (reason = 'removed') as removed, count(*) filter (reason = 'removed' and best_any <> label) as removed_misnamed,
 count(*) filter (reason = 'removed' and best_any <> label and verdict = 'out') as misnamed_out,
 count(*) filter (reason = 'removed' and best_any <> label and verdict = 'uncertain') as misnamed_uncertain,
 count(*) filter (reason = 'removed' and best_any <> label and verdict = 'in') as misnamed_in from known""")
def _(spark, folder):
    rows = metrics.naming(World(spark, folder).records)
    return rows.select("n_items", *r6("accuracy"), *[c for c in rows.columns if c not in ("n_items", "accuracy")])


PHOTO_LEVEL = """
select count(*) as n_scenarios, count(*) filter (not wrong) as n_clean, count(*) filter (wrong) as n_wrong,
 count(*) filter (not wrong and state = 'ok') as clean_ok, count(*) filter (not wrong and state = 'uncertain') as clean_uncertain,
 count(*) filter (not wrong and state = 'out') as clean_out, count(*) filter (wrong and state = 'ok') as wrong_ok,
 count(*) filter (wrong and state = 'uncertain') as wrong_uncertain, count(*) filter (wrong and state = 'out') as wrong_out,
 round(count(*) filter (wrong and state = 'out') / greatest(1, count(*) filter (wrong))::double, 6) as alert_recall,
 round(count(*) filter (not wrong and state = 'out') / greatest(1, count(*) filter (not wrong))::double, 6) as false_alert_rate,
 round(count(*) filter (not wrong and state = 'uncertain') / greatest(1, count(*) filter (not wrong))::double, 6) as check_rate_clean,
 round(count(*) filter (wrong and state = 'ok') / greatest(1, count(*) filter (wrong))::double, 6) as silent_miss_rate from states"""


@query("a29_photo_level", PHOTO_LEVEL)
def _(spark, folder):
    records, spurious = World(spark, folder).judged
    rows = metrics.photo_level(metrics.scenario_states(records, spurious))
    rates = ("alert_recall", "false_alert_rate", "check_rate_clean", "silent_miss_rate")
    return rows.select(*[c for c in rows.columns if c not in rates], *r6(*rates))


@query("j20_known_scenarios", "select scenario_id, state, wrong from states")
def _(spark, folder):
    records, spurious = World(spark, folder).judged
    return metrics.scenario_states(records, spurious)


@query("u05_verdict_union", """
select verdict, count(*) as n from (select scenario_id, verdict from full_records union all select scenario_id, verdict from spurious)
group by 1""")
def _(spark, folder):
    records, spurious = World(spark, folder).judged
    both = records.select("scenario_id", "verdict").unionByName(spurious.select("scenario_id", "verdict"))
    return both.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("a47_photo_table", """
select case when wrong then 'wrong' else 'clean' end as grp, count(*) as n, count(*) filter (state = 'ok') as ok,
 printf('%.1f %%', round_even(100.0 * count(*) filter (state = 'ok') / count(*), 1)) as ok_share,
 count(*) filter (state = 'uncertain') as uncertain,
 printf('%.1f %%', round_even(100.0 * count(*) filter (state = 'uncertain') / count(*), 1)) as uncertain_share,
 count(*) filter (state = 'out') as out, printf('%.1f %%', round_even(100.0 * count(*) filter (state = 'out') / count(*), 1)) as out_share
from states group by 1""")
def _(spark, folder):
    records, spurious = World(spark, folder).judged
    return metrics.photo_table(metrics.scenario_states(records, spurious))


@query("a30_unseen_groups", """
select grp, count(distinct class_id) as n_classes, coalesce(array_to_string(list_sort(list(distinct class_id) filter (n > 0)), ','), '')
 as present, coalesce(sum(n), 0) as n_items from (values ('held_out', 8), ('held_out', 9), ('untrained', 3), ('untrained', 42)) g(grp, class_id)
left join (select label, count(*) as n from records where reason = 'unseen' group by 1) r on r.label = g.class_id group by 1""")
def _(spark, folder):
    w = World(spark, folder)
    held = w.held_out.select(F.lit("held_out").alias("grp"), "class_id")
    others = w.spark.createDataFrame([("untrained", 3), ("untrained", 42)], "grp string, class_id int")
    return metrics.unseen_groups(w.records, held.unionByName(others))


@query("a31_listed_without_prototype", """
select distinct label from told where gt = 'in' and label not in (0, 1, 2, 4, 6)""")
def _(spark, folder):
    w = World(spark, folder)
    fewer = w.prototypes.filter(F.col("class_id").isin(0, 1, 2, 4, 6))
    known = fewer.select(F.col("class_id").alias("label"), F.lit(True).alias("k"))
    rows = w.told.join(known, "label", "left").withColumn("seen", F.coalesce("k", F.lit(False)))
    return metrics.listed_without_prototype(rows)


@query("a32_unique_counts", """
select count(distinct photo_id) as n_photos, count(distinct (photo_id, item_idx)) as n_items, count(*) as n_records from records""")
def _(spark, folder):
    return metrics.unique_counts(World(spark, folder).records)


@query("a32_spurious_counts", """
select count(*) as n_spurious, count(*) filter (verdict = 'in') as n_in, count(*) filter (verdict = 'out') as n_out,
 count(*) filter (verdict = 'uncertain') as n_uncertain from spurious""")
def _(spark, folder):
    return metrics.spurious_counts(World(spark, folder).judged[1])


@query("j12_spurious", "select scenario_id, photo_id, det_id, verdict, p_in, det_score from spurious")
def _(spark, folder):
    return World(spark, folder).evaluated[1].select(
        "scenario_id", "photo_id", "det_id", "verdict", "p_in", "det_score")


@query("j11_detector_records", """
select scenario_id, photo_id, item_idx, gt, reason, detected, verdict, p_in, best_any from full_records""")
def _(spark, folder):
    return World(spark, folder).judged[0].select(
        "scenario_id", "photo_id", "item_idx", "gt", "reason", "detected", "verdict", "p_in",
        "best_any")


@query("a33_latency", """
select round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.9), 6) as p90 from events where value is not null""")
def _(spark, folder):
    return exact_quantiles(bridge.table(spark, folder, "events"), "value", {"median": 0.5, "p90": 0.9}).select(
        *r6("median", "p90"))


@query("a40_banners", """
select p.photo_id, count(i.item_idx) as n, count(*) filter (d.verdict = 'out') as n_out,
 count(*) filter (d.verdict = 'uncertain') as n_uncertain,
 case when count(i.item_idx) = 0 then 'none' when count(*) filter (d.verdict = 'out') > 0 then 'alert'
  when count(*) filter (d.verdict = 'uncertain') > 0 then 'unsure' else 'ok' end as banner
from photos p left join items i using (photo_id) left join listed l on l.allowlist_id = p.allowlist_id
left join own_decided d on d.vec_id = i.vec_id and d.listed = coalesce(l.listed, []) group by 1""")
def _(spark, folder):
    w = World(spark, folder)
    return metrics.banners(w.own_decisions, w.photos)


@query("a44_presentation", f"""
select slice, n, case when n_out > 0 then printf('%.1f %%', round_even(100 * out_recall, 1)) else '–' end as out_recall,
 case when n_in > 0 then printf('%.1f %%', round_even(100 * false_alarm_rate, 1)) else '–' end as false_alarm,
 printf('%.1f %%', round_even(100 * abstain_rate, 1)) as abstain,
 case when n_out > 0 then printf('%.1f %%', round_even(100 * out_accepted_rate, 1)) else '–' end as out_accepted from ({SLICES})""")
def _(spark, folder):
    return metrics.presentation(metrics.record_slices(World(spark, folder).records))
