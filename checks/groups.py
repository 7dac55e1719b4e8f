"""Catalogue, split, scenarios, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwarden import bridge
from listwarden.functions.hashing import seeded_hash
from listwarden.operators import agreement, catalog, ordering, sampling, scenarios, split
from listwarden.operators import profile as P
from listwarden.operators.prototypes import prototype_offsets
from listwarden.plans.evaluate import identity_matches

from .base import query
from .world import World


def votes(spark, folder):
    return catalog.name_votes(bridge.name_lines(spark, folder), ["line_no"])


@query("j01_photo_allowlist", """
select p_size as photo_id, arg_max(p_partkey % 97, p_partkey) as allowlist_id from part group by 1""")
def _(spark, folder):
    part = bridge.table(spark, folder, "part")
    return catalog.photo_list(part.select(F.col("p_size").alias("photo_id"),
                                          (F.col("p_partkey") % 97).alias("allowlist_id"),
                                          F.col("p_partkey").alias("ord")))


@query("j02_listed_classes", """
select p.photo_id, l.allowlist_id is null as missing, coalesce(len(l.listed), -1) as n_listed
from photos p left join listed l using (allowlist_id)""")
def _(spark, folder):
    rows = World(spark, folder).own_list
    return rows.select("photo_id", F.col("listed").isNull().alias("missing"),
                       F.coalesce(F.size("listed"), F.lit(-1)).alias("n_listed"))


@query("j03_subset_photos", """
select photo_id from items join split using (photo_id) where subset = 'test' group by 1""")
def _(spark, folder):
    w = World(spark, folder)
    return split.subset_photos(w.items, w.split, "test")


UNTRAINED = """
select label as class_id from items i join {split} s using (photo_id) where label <> 107 group by 1
having not bool_or(subset = 'train') and label not in (8, 9)"""
SMALL_SPLIT = "(select photo_id, case when not bool_or(label in (3, 5)) then 'train' when photo_id % 2 = 0 then 'val' " \
              "else 'test' end as subset from items group by 1)"


def thin_split(w: World):
    """A split whose train photos show neither class 3 nor class 5."""
    shows = w.items.groupBy("photo_id").agg(F.bool_or(F.col("label").isin(3, 5)).alias("_s"))
    subset = F.when(~F.col("_s"), "train").when(F.col("photo_id") % 2 == 0, "val").otherwise("test")
    return shows.select("photo_id", subset.alias("subset"))


@query("j04_untrained_classes", UNTRAINED.format(split=SMALL_SPLIT))
def _(spark, folder):
    w = World(spark, folder)
    return split.untrained_classes(w.items, thin_split(w), w.held_out)


@query("j05_unseen_classes", f"select class_id from ({UNTRAINED.format(split='split')}) union select unnest([8, 9])")
def _(spark, folder):
    w = World(spark, folder)
    return split.unseen_classes(w.items, w.split, w.held_out)


@query("u02_label_difference", f"""
select label as class_id from items i join {SMALL_SPLIT} s using (photo_id) where label <> 107
 and label not in (select p_partkey % 4 from part) group by 1 having not bool_or(subset = 'train')""")
def _(spark, folder):
    """With a class table of its own as what is held out."""
    w = World(spark, folder)
    held = bridge.table(spark, folder, "part").select((F.col("p_partkey") % 4).cast("int").alias("class_id")).distinct()
    return split.untrained_classes(w.items, thin_split(w), held)


@query("j14_class_names", """
select i.class_id, coalesce(n.name, 'class_' || i.class_id) as name from (select distinct label as class_id from items) i
left join class_names n using (class_id)""")
def _(spark, folder):
    from listwarden.functions.names import class_label

    labels = World(spark, folder).items.select(F.col("label").alias("class_id")).distinct()
    names = catalog.class_names(votes(spark, folder))
    return labels.join(names, "class_id", "left").select("class_id", class_label(F.col("name"), F.col("class_id"))
                                                         .alias("name"))


SAMPLE_LISTS = """
select allowlist_id, array_to_string(kept, ',') as classes from (
 select allowlist_id, list_filter(listed, lambda c: list_contains([{seen}], c)) as kept from listed
 where allowlist_id in (select allowlist_id from split where subset = 'test'))
where len(kept) >= {least} order by allowlist_id limit {n}"""


@query("j18_sample_lists", SAMPLE_LISTS.format(seen="0, 1, 2, 3, 4, 5, 6, 7", least=2, n=24))
def _(spark, folder):
    w = World(spark, folder)
    rows = catalog.sample_lists(w.lists, w.split, w.prototypes)
    return rows.select("allowlist_id", F.array_join("classes", ",").alias("classes"))


@query("j19_seen_lists", """
select allowlist_id, array_to_string(list_filter(listed, lambda c: c in (0, 1, 2, 3, 4, 5, 6, 7)), ',') as classes from listed""")
def _(spark, folder):
    w = World(spark, folder)
    rows = catalog.seen_lists(w.lists, w.prototypes)
    return rows.select("allowlist_id", F.array_join("classes", ",").alias("classes"))


@query("a01_class_names", "select class_id, name, votes from class_names")
def _(spark, folder):
    return catalog.class_names(votes(spark, folder))


@query("a02_class_aliases", "select class_id, alias_no, name as alias, votes from ranked_names where alias_no > 0")
def _(spark, folder):
    return catalog.class_aliases(votes(spark, folder))


@query("t08_alias_table", """
select class_id, name, votes, alias_no from ranked_names""")
def _(spark, folder):
    counted = votes(spark, folder)
    winners = catalog.class_names(counted).select("class_id", "name", "votes", F.lit(0).alias("alias_no"))
    others = catalog.class_aliases(counted).withColumnRenamed("alias", "name")
    return winners.unionByName(others)


@query("a03_list_classes", """
select l.allowlist_id, coalesce(array_to_string(list_sort(list(distinct c.class_id) filter (c.class_id is not null)), ','), '')
 as listed from (select distinct allowlist_id from name_lines) l
left join clean_lines c using (allowlist_id) group by 1""")
def _(spark, folder):
    lines = bridge.name_lines(spark, folder)
    rows = catalog.listed_classes(lines, lines)
    return rows.select("allowlist_id", F.array_join("listed", ",").alias("listed"))


@query("a04_class_table", """
select coalesce(n.class_id, c.class_id) as class_id, coalesce(n.name, 'class_' || c.class_id) as name,
 coalesce(n_boxes, 0) as n_boxes, coalesce(n_images, 0) as n_images
from class_names n full join (select label as class_id, count(*) as n_boxes, count(distinct photo_id) as n_images from items
 where label <> 107 group by 1) c using (class_id)""")
def _(spark, folder):
    return catalog.class_table(catalog.class_names(votes(spark, folder)), World(spark, folder).items)


@query("a04_foreign_items", "select count(*) filter (label = 107) as n_foreign from items")
def _(spark, folder):
    return catalog.foreign_items(World(spark, folder).items)


@query("a05_map_pairs", "select distinct o_custkey as allowlist_id, o_orderdate as photo_id from orders")
def _(spark, folder):
    orders = bridge.table(spark, folder, "orders")
    return catalog.map_pairs(orders.select(F.col("o_custkey").alias("allowlist_id"),
                                           F.col("o_orderdate").alias("photo_id")))


@query("a06_profile", """
with per_photo as (select photo_id, count(*) as n, count(*) filter (label = 107) as f from items group by 1),
 per_class as (select c.class_id, count(i.label) as n from (select distinct label as class_id from embeddings) c
   left join items i on i.label = c.class_id group by 1),
 widths as (select (x2 - x1) / width as w from items join photos using (photo_id)),
 per_list as (select allowlist_id, count(*) as n from photos where allowlist_id is not null
   and photo_id in (select photo_id from items) group by 1)
select metric, round(value, 6) as value from (
 select 'n_photos' as metric, count(*)::double as value from per_photo
 union all select 'n_items', sum(n) from per_photo union all select 'n_foreign_items', sum(f) from per_photo
 union all select 'n_photos_with_foreign', count(*) filter (f > 0) from per_photo
 union all select 'items_per_photo_mean', avg(n) from per_photo union all select 'items_per_photo_max', max(n) from per_photo
 union all select 'items_per_photo_median', quantile_cont(n, 0.5) from per_photo
 union all select 'n_classes', count(*) from per_class union all select 'items_per_class_min', min(n) from per_class
 union all select 'items_per_class_max', max(n) from per_class
 union all select 'items_per_class_p25', quantile_cont(n, 0.25) from per_class
 union all select 'items_per_class_median', quantile_cont(n, 0.5) from per_class
 union all select 'rel_width_p5', quantile_cont(w, 0.05) from widths
 union all select 'rel_width_median', quantile_cont(w, 0.5) from widths
 union all select 'rel_width_p95', quantile_cont(w, 0.95) from widths
 union all select 'n_lists', count(*) from listed union all select 'classes_per_list_mean', avg(len(listed)) from listed
 union all select 'classes_per_list_max', max(len(listed)) from listed
 union all select 'photos_per_list_mean', avg(n) from per_list union all select 'photos_per_list_max', max(n) from per_list)""")
def _(spark, folder):
    w = World(spark, folder)
    classes = w.vectors.select(F.col("label").alias("class_id")).distinct()
    w.keep_items()
    return P.profile(w.items, w.photos, classes, w.lists).select("metric", F.round("value", 6).alias("value"))


@query("a07_rare_classes", """
select c.class_id, count(i.label) as n from (select distinct p_partkey % 40 as class_id from part) c
left join items i on i.label = c.class_id group by 1 having count(i.label) < 20""")
def _(spark, folder):
    classes = bridge.table(spark, folder, "part").select((F.col("p_partkey") % 40).alias("class_id")).distinct()
    return P.rare_classes(World(spark, folder).items, classes)


@query("a08_common_sizes", """
select w || 'x' || h as size, count(*) as n from saved group by 1 order by 2 desc, 1 limit 3""")
def _(spark, folder):
    from listwarden.sources.annotations import photo_rows

    return P.common_sizes(photo_rows(bridge.raw_photos(spark, folder), "train"))


@query("a09_split_summary", """
select s.subset, count(*) as n_photos, coalesce(sum(i.n), 0) as n_items,
 count(distinct coalesce(cast(s.allowlist_id as varchar), '<null>')) as n_lists
from split s left join (select photo_id, count(*) as n from items group by 1) i using (photo_id) group by 1""")
def _(spark, folder):
    w = World(spark, folder)
    return split.split_summary(w.items, w.split)


@query("a10_scenario_summary", """
select 'kind' as facet, kind as value, count(*) as n from scenarios group by 2
union all select 'gt', gt, count(*) from told group by 2 union all select 'reason', reason, count(*) from told group by 2""")
def _(spark, folder):
    w = World(spark, folder)
    return scenarios.summary(w.scenarios, w.told)


@query("a41_sampling_weights", """
select label, count(*) as n, round(1 / sqrt(count(*)), 9) as weight from items group by 1""")
def _(spark, folder):
    rows = sampling.class_weights(World(spark, folder).items)
    return rows.select("label", "n", F.round("weight", 9).alias("weight"))


@query("a45_items_histogram", "select n as bin, count(*) as n from (select count(*) as n from items group by photo_id) group by 1")
def _(spark, folder):
    return P.unit_histogram(P.items_per_photo(World(spark, folder).items), "n")


@query("a45_classes_histogram", "select len(listed) as bin, count(*) as n from listed where len(listed) >= 1 group by 1")
def _(spark, folder):
    return P.unit_histogram(World(spark, folder).lists.select(F.size("listed").alias("k")), "k")


@query("a45_width_histogram", """
with w as (select (x2 - x1) / width as v from items join photos using (photo_id)), b as (select min(v) as lo, max(v) as hi from w)
select r.bin, count(w.v) as n from (select bin, lo + bin * ((hi - lo) / 40) as lo, lo + (bin + 1) * ((hi - lo) / 40) as hi
 from (select unnest(range(40)) as bin), b) r left join w on w.v >= r.lo and (w.v < r.hi or r.bin = 39) group by 1""")
def _(spark, folder):
    w = World(spark, folder)
    return P.equal_histogram(P.relative_widths(w.items, w.photos), "rel_width")


@query("w01_group_split", "select photo_id, allowlist_id, subset from split")
def _(spark, folder):
    return World(spark, folder).split


@query("w02_stable_shuffle", """
select allowlist_id, row_number() over (order by sha1('20260918:' || allowlist_id)) as place from lists""")
def _(spark, folder):
    from listwarden.constants import SEED

    lists = bridge.allowlists(spark, folder).withColumn("_h", seeded_hash(SEED, "allowlist_id"))
    placed = ordering.running_totals(lists, [F.col("_h"), F.col("allowlist_id")], {"place": F.lit(1)})
    return placed.select("allowlist_id", "place")


@query("w04_item_index", "select photo_id, item_idx, vec_id from items")
def _(spark, folder):
    return World(spark, folder).items.select("photo_id", "item_idx", "vec_id")


@query("w06_first_rows", "select distinct label as class_id from embeddings order by 1 limit 5")
def _(spark, folder):
    classes = World(spark, folder).vectors.select(F.col("label").alias("class_id")).distinct()
    return ordering.first_rows(classes, [F.col("class_id")], 5)


@query("w07_systematic_sample", """
select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as r, count(*) over () as n from orders)
where r % (n // 20) = 0 and r < 20 * (n // 20)""")
def _(spark, folder):
    return ordering.every_kth(bridge.table(spark, folder, "orders").select("o_orderkey"), [F.col("o_orderkey")], 20)


@query("w08_prototype_offsets", """
select class_id, sum(n) over (order by class_id) - n as offset, n from (select label as class_id, count(*) as n
 from embeddings group by 1)""")
def _(spark, folder):
    rows = World(spark, folder).vectors.select(F.col("label").alias("class_id"))
    return prototype_offsets(rows)


@query("k01_top_sizes", """
select width || 'x' || height as size, count(*) as n from raw_photos group by 1 order by 2 desc, 1 limit 15""")
def _(spark, folder):
    return P.common_sizes(bridge.raw_photos(spark, folder), 15)


@query("k02_photo_limit", """
select scenario_id from scenarios where photo_id in (select distinct photo_id from scenarios order by 1 limit 50)""")
def _(spark, folder):
    rows = World(spark, folder).scenarios
    few = ordering.first_rows(rows.select("photo_id").distinct(), [F.col("photo_id")], 50)
    return rows.join(few, "photo_id", "left_semi").select("scenario_id")


@query("k03_hash_sample", """
select o_orderkey from (select o_orderkey from orders order by sha1('0:' || o_orderkey) limit 100) order by 1""")
def _(spark, folder):
    return sampling.hash_sample(bridge.table(spark, folder, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("k04_choose_k", "select photo_id, k, array_to_string(removed, ',') as removed from removals")
def _(spark, folder):
    rows = World(spark, folder).scenarios.filter(F.col("kind") != "clean")
    return rows.select("photo_id", F.substring_index("kind", "-", -1).cast("int").alias("k"),
                       F.array_join("removed", ",").alias("removed"))


@query("k05_weighted_draws", """
with c as (select label, count(*) as n, 1.0::double / sqrt(count(*)) as w from items group by 1),
e as (select label, n, sum(n * w) over (order by label rows unbounded preceding) as hi from c),
l as (select label, n, hi, coalesce(lag(hi) over (order by label), 0.0::double) as lo from e),
h as (select id as draw, ('0x' || substr(sha1('0:class:' || id), 1, 12))::bigint / 281474976710656.0::double as cu,
  ('0x' || substr(sha1('0:place:' || id), 1, 12))::bigint / 281474976710656.0::double as pu from range(2000) t(id)),
p as (select draw, label, cast(floor(pu * n) as bigint) as pos from (
  select *, cu * (select max(hi) from e) as u from h) join l on u >= lo and u < hi),
i as (select label, item_id, row_number() over (partition by label order by item_id) - 1 as pos from items)
select draw, item_id, label from p join i using (label, pos)""")
def _(spark, folder):
    return sampling.weighted_draws(World(spark, folder).items, "item_id", 2000)


@query("k06_held_out_choice", """
with c as (select label as class_id, count(distinct photo_id) as n from items where label <> 107 group by 1),
 q as (select quantile_cont(n, 0.25) as lo, quantile_cont(n, 0.75) as hi from c)
select class_id from c, q where n between lo and hi order by sha1('20260918:' || class_id) limit 3""")
def _(spark, folder):
    return split.choose_held_out(World(spark, folder).items, 3)


@query("k07_ordered_distinct", """
select l.allowlist_id, coalesce(array_to_string(list_sort(list(distinct c.class_id) filter (c.class_id is not null)), ','), '') as classes
from (select distinct allowlist_id from name_lines) l left join clean_lines c using (allowlist_id) group by 1""")
def _(spark, folder):
    rows = catalog.listed_classes(bridge.name_lines(spark, folder), bridge.name_lines(spark, folder))
    return rows.select("allowlist_id", F.array_join("listed", ",").alias("classes"))


@query("u03_common_cases", """
select o_orderkey as case_id from orders intersect select l_orderkey from lineitem""")
def _(spark, folder):
    a = bridge.table(spark, folder, "orders").select(F.col("o_orderkey").alias("case_id"))
    b = bridge.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("case_id"))
    return agreement.common_cases(a, b)


@query("u04_list_difference", "select scenario_id, array_to_string(listed, ',') as listed from scenarios")
def _(spark, folder):
    return World(spark, folder).scenarios.select("scenario_id", F.array_join("listed", ",").alias("listed"))


@query("u06_straddling_groups", """
select coalesce(cast(allowlist_id as varchar), '__solo__' || photo_id) as grp, count(distinct subset) as n_subsets
from (select photo_id, allowlist_id, case when photo_id % 7 = 0 then 'test' when photo_id % 7 = 1 then 'val' else 'train' end
 as subset from photos) group by 1 having count(distinct subset) > 1""")
def _(spark, folder):
    loose = World(spark, folder).photos.withColumn("subset", bridge.subset_of_key(F.col("photo_id")))
    return split.straddling_groups(loose)


@query("g01_base_lists", """
select photo_id, array_to_string(base, ',') as base, array_to_string(list_sort(present), ',') as present from base_lists""")
def _(spark, folder):
    rows = World(spark, folder).base_lists
    return rows.select("photo_id", F.array_join("base", ",").alias("base"), F.array_join("present", ",").alias("present"))


@query("g02_without_fallback", """
select count(*) as n_photos, sum(len(base)) as n_listed from base_lists
where allowlist_id in (select allowlist_id from lists)""")
def _(spark, folder):
    w = World(spark, folder)
    rows = scenarios.photo_lists(w.photos, w.items, w.lists, w.held_out, fallback=False)
    return rows.agg(F.count(F.lit(1)).alias("n_photos"), F.sum(F.size("base")).alias("n_listed"))


@query("g03_clean_scenarios", """
select scenario_id, array_to_string(listed, ',') as listed from scenarios where kind = 'clean'""")
def _(spark, folder):
    rows = World(spark, folder).scenarios.filter(F.col("kind") == "clean")
    return rows.select("scenario_id", F.array_join("listed", ",").alias("listed"))


@query("g04_remove_scenarios", """
select scenario_id, kind, array_to_string(removed, ',') as removed, len(listed) as n_listed from scenarios where kind <> 'clean'""")
def _(spark, folder):
    w = World(spark, folder)
    rows = scenarios.make_scenarios(w.base_lists, include_clean=False)
    return rows.select("scenario_id", "kind", F.array_join("removed", ",").alias("removed"),
                       F.size("listed").alias("n_listed"))


@query("g05_item_truth", "select scenario_id, item_idx, label, gt, reason from told")
def _(spark, folder):
    return World(spark, folder).told.select("scenario_id", "item_idx", "label", "gt", "reason")


@query("g06_scenario_ids", "select scenario_id, kind, photo_id, allowlist_id from scenarios")
def _(spark, folder):
    return World(spark, folder).scenarios.select("scenario_id", "kind", "photo_id", "allowlist_id")


@query("g07_order_independent", """
select kind, count(*) as n, sum(list_sum(removed)) as removed_sum from scenarios group by 1""")
def _(spark, folder):
    w = World(spark, folder)
    turned = scenarios.photo_lists(w.photos.orderBy(F.desc("photo_id")), w.items.repartition(7, "label"), w.lists,
                                   w.held_out)
    rows = scenarios.make_scenarios(turned)
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda t, c: t + c)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.size("removed") > 0, total))
                                    .alias("removed_sum"))


@query("g08_out_counts", "select scenario_id, count(*) filter (gt = 'out') as n_out from told group by 1")
def _(spark, folder):
    return scenarios.out_counts(World(spark, folder).told)


CASES = """
with picked as (select photo_id from (select photo_id from base_lists where photo_id in (select photo_id from split where subset = 'test')
  order by sha1('0:' || photo_id) limit 30)), numbered as (select photo_id, row_number() over (order by photo_id) - 1 as k from picked),
 cases as (select n.*, array_to_string(list_sort(coalesce(s.listed, list_filter(b.labels, lambda c: c <> 107))), ',') as listed
  from numbered n join base_lists b using (photo_id) left join scenarios s on s.photo_id = n.photo_id and s.kind = 'remove-1')
select photo_id || '#det' as case_id, listed from cases union all
select photo_id || '#oracle', listed from cases where k < 10"""


@query("g09_agreement_cases", CASES)
def _(spark, folder):
    from listwarden.operators.agreement import agreement_cases

    w = World(spark, folder)
    rows = agreement_cases(w.items, w.split.filter(F.col("subset") == "test"), w.scenarios)
    return rows.select("case_id", F.array_join("listed", ",").alias("listed"))


@query("y03_identity_matches", "select photo_id, item_idx, item_id as det_id, 1.0::double as iou from items")
def _(spark, folder):
    return identity_matches(World(spark, folder).items)
