"""Scans, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwarden import bridge
from listwarden.constants import PHOTO_MAX_SIDE
from listwarden.functions import boxes as B
from listwarden.functions import decisions as D
from listwarden.functions import names as N
from listwarden.functions import numbers as NUM
from listwarden.operators import boxes as OB
from listwarden.operators import catalog, metrics, profile, prototypes, sampling
from listwarden.sources import annotations, labels, tables

from .base import query
from .world import PARAMS, World


@query("s01_shard_scan", """
select l_linenumber, count(*) as n, sum(l_orderkey) as sum_key from lineitem group by 1""")
def _(spark, folder):
    rows = annotations.read_shards(spark, folder, "lineitem", "l_orderkey LONG, l_linenumber INT",
                                   pattern="{split}*.parquet")
    return rows.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("sum_key"))


@query("s01_first_shards", "select count(*) as n, min(p_partkey) as lo, max(p_partkey) as hi from part")
def _(spark, folder):
    rows = annotations.read_shards(spark, folder, "part", "p_partkey LONG", first=1, pattern="{split}*.parquet")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))


@query("s06_labelled_photos", """
select p.photo_id, p.allowlist_id, count(*) as n_labels from photos p join items i using (photo_id) group by 1, 2""")
def _(spark, folder):
    w = World(spark, folder)
    labels = w.items.groupBy("photo_id").agg(F.collect_list("label").alias("labels"))
    photos = w.photos.select("photo_id").join(labels, "photo_id", "left").withColumnRenamed("photo_id", "file")
    rows = annotations.labelled_photos(photos, w.photos.select("photo_id", "allowlist_id"))
    return rows.select(F.col("file").alias("photo_id"), "allowlist_id", F.size("labels").alias("n_labels"))


CROP_SQL = "coalesce(case when i.photo_id % 5 = 0 then null when i.photo_id % 7 = 0 then 'test' " \
           "when i.photo_id % 7 = 1 then 'val' else 'train' end, 'train')"


def crops(w: World):
    stored = w.photos.filter(F.col("photo_id") % 5 != 0).select(
        "photo_id", bridge.subset_of_key(F.col("photo_id")).alias("subset"))
    return tables.crop_index(w.items, stored)


@query("s10_crop_index", f"""
select item_id, photo_id, item_idx, x1, y1, x2, y2, label, {CROP_SQL} as subset from items i""")
def _(spark, folder):
    return crops(World(spark, folder))


@query("p12_default_subset", f"select {CROP_SQL} as subset, count(*) as n from items i group by 1")
def _(spark, folder):
    return crops(World(spark, folder)).groupBy("subset").agg(F.count(F.lit(1)).alias("n"))


@query("p11_crop_filter", f"""
select item_id, label, {CROP_SQL} as subset from items i
where {CROP_SQL} = 'val' and label <> 107 and label in (select class_id from protos)""")
def _(spark, folder):
    w = World(spark, folder)
    return tables.filter_crops(crops(w), "val", w.prototypes).select("item_id", "label", "subset")


@query("s12_prototype_export", """
select m.class_id, coalesce(c.name, 'class_' || m.class_id) as name, 0 as proto_no, m.d - 1 as d, round_even(m.m, 4) as v
from mean_units m left join class_names c on c.class_id = m.class_id and c.class_id % 4 <> 0""")
def _(spark, folder):
    w = World(spark, folder)
    votes = catalog.name_votes(bridge.name_lines(spark, folder), ["line_no"])
    names = catalog.class_names(votes).filter(F.col("class_id") % 4 != 0)
    rows = prototypes.export_rows(w.class_means.withColumn("proto_no", F.lit(0)), names)
    return rows.select("class_id", "name", "proto_no", F.posexplode("vector").alias("d", "v"))


LABEL_SQL = """
select p.photo_id, i.item_idx, coalesce(printf('0 %.6f %.6f %.6f %.6f',
 round_even((i.x1 + i.x2)/2/p.width, 6), round_even((i.y1 + i.y2)/2/p.height, 6),
 round_even((i.x2 - i.x1)/p.width, 6), round_even((i.y2 - i.y1)/p.height, 6)), '') as line
from (select photo_id, 1279 as width, 967 as height from photos) p
left join items i on i.photo_id = p.photo_id and i.x2 > i.x1 and i.y2 > i.y1"""


@query("s13_label_lines", LABEL_SQL)
def _(spark, folder):
    # Sides that are prime keep the sixth decimal away from ties, which engines print differently.
    w = World(spark, folder)
    return labels.label_lines(w.items, w.photos.withColumns({"width": F.lit(1279), "height": F.lit(967)}))


@query("s14_path_lists", "select subset, 'data/images/' || photo_id || '.jpg' as value from split")
def _(spark, folder):
    return labels.path_lists(World(spark, folder).split, "data")


@query("s16_catalogue_export", """
select p.class_id, coalesce(c.name, 'class_' || p.class_id) as name, a.alias_no, a.name as alias
from (select distinct class_id from protos) p left join class_names c using (class_id)
left join (select * from ranked_names where alias_no > 0) a using (class_id)""")
def _(spark, folder):
    votes = catalog.name_votes(bridge.name_lines(spark, folder), ["line_no"])
    return catalog.export_catalogue(World(spark, folder).prototypes, catalog.class_names(votes),
                                    catalog.class_aliases(votes))


@query("p01_displayed_size", "select filename, ow, oh from sized")
def _(spark, folder):
    raw = bridge.raw_photos(spark, folder)
    width, height = B.displayed_size(F.col("width"), F.col("height"), F.col("orientation"))
    return raw.select("filename", width.alias("ow"), height.alias("oh"))


@query("p02_shrink_factor", "select filename, round(scale, 9) as scale, w, h from saved")
def _(spark, folder):
    raw = bridge.raw_photos(spark, folder)
    width, height = B.displayed_size(F.col("width"), F.col("height"), F.col("orientation"))
    factor = B.shrink_factor(width, height, PHOTO_MAX_SIDE)
    return raw.select("filename", F.round(factor, 9).alias("scale"), B.shrunk_side(width, factor).alias("w"),
                      B.shrunk_side(height, factor).alias("h"))


@query("p03_scaled_boxes", "select filename, box_no, x1, y1, x2, y2 from corners")
def _(spark, folder):
    raw = bridge.raw_photos(spark, folder)
    width, height = B.displayed_size(F.col("width"), F.col("height"), F.col("orientation"))
    factor = B.shrink_factor(width, height, PHOTO_MAX_SIDE)
    boxes = B.scaled_corners(F.col("bboxes"), factor, B.shrunk_side(width, factor), B.shrunk_side(height, factor))
    return raw.select("filename", F.posexplode(boxes).alias("box_no", "b")).select("filename", "box_no", "b.*")


@query("p04_dropped_boxes", """
select c.filename as orig_file, 3 - count(k.filename) as n_dropped_boxes from (select distinct filename from corners) c
left join kept_boxes k using (filename) group by 1""")
def _(spark, folder):
    return annotations.photo_rows(bridge.raw_photos(spark, folder), "train").select("orig_file", "n_dropped_boxes")


JPG_SQL = "regexp_replace(regexp_extract(filename, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1') || '.jpg'"


@query("p05_jpg_name", f"select filename, {JPG_SQL} as file from raw_photos")
def _(spark, folder):
    return bridge.raw_photos(spark, folder).select("filename", N.jpg_name(F.col("filename")).alias("file"))


@query("p06_photo_rows", f"""
select {JPG_SQL} as file, s.filename as orig_file, 'train' as src_split, s.w as width, s.h as height, s.ow as orig_width,
 case when orientation = 0 then 1 else orientation end as exif_orientation, count(k.filename) as n_labels,
 coalesce(sum(k.label), 0) as label_sum, round(coalesce(sum(k.x1), 0), 3) as x1_sum
from saved s left join kept_boxes k using (filename) group by all""")
def _(spark, folder):
    rows = annotations.photo_rows(bridge.raw_photos(spark, folder), "train")
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda t, x: t + f(x))             # noqa: E731
    return rows.select(
        "file", "orig_file", "src_split", "width", "height", F.col("orig_size")[0].alias("orig_width"),
        "exif_orientation", F.size("labels").alias("n_labels"),
        total(F.col("labels"), lambda x: x.cast("double")).cast("long").alias("label_sum"),
        F.round(total(F.col("boxes"), lambda b: b[0]), 3).alias("x1_sum"))


@query("p06_photo_items", f"""
select stem || '_' || pos as item_id, stem || '.jpg' as photo_id, pos as item_idx, x1, y1, x2, y2, label from (
 select regexp_replace(regexp_extract(filename, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1') as stem, x1, y1, x2, y2, label,
  row_number() over (partition by filename order by box_no) - 1 as pos from kept_boxes)""")
def _(spark, folder):
    return annotations.photo_items(annotations.photo_rows(bridge.raw_photos(spark, folder), "train"))


def raw_allowlists(spark, folder):
    part = bridge.table(spark, folder, "part")
    wide = F.col("p_partkey") % 2 == 0
    return part.select(
        F.concat(F.lit("scan/list_"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("filename"),
        F.array(F.lit(1)).alias("ann_ids"), F.array("p_name").alias("texts"),
        F.array(F.lit("drugname")).alias("ann_labels"),
        F.array(F.array(F.col("p_size") * 10, F.lit(5), F.lit(60), F.lit(9)).cast("array<int>")).alias("boxes"),
        F.array(F.col("p_size").cast("int")).alias("mappings"),
        F.when(wide, 3001).otherwise(1601).alias("width"), F.when(wide, 2001).otherwise(1201).alias("height"),
        F.when(wide, 1).otherwise(6).alias("orientation"))


@query("p07_allowlist_rows", """
select concat('list_', p_partkey, '.jpg') as file, case when p_partkey % 2 = 0 then 3001 else 1201 end as orig_width,
 round(least(1.0, 1600.0::double / case when p_partkey % 2 = 0 then 3001 else 1601 end), 9) as scale,
 p_name as text, cast(p_size as int) as mapping, cast(p_size * 10 as int) as box_x from part""")
def _(spark, folder):
    raw = raw_allowlists(spark, folder)
    rows = annotations.allowlist_rows(raw, "train")
    return rows.select("file", F.col("orig_size")[0].alias("orig_width"), F.round("scale", 9).alias("scale"),
                       F.col("texts")[0].alias("text"), F.col("mappings")[0].alias("mapping"),
                       F.col("boxes_raw")[0][0].alias("box_x"))


@query("p08_strip_list_number", "select line_no, name from clean_lines")
def _(spark, folder):
    lines = catalog.name_lines(bridge.name_lines(spark, folder))
    return lines.select("line_no", N.strip_list_number(F.col("text")).alias("name"))


@query("p09_name_lines", """
select allowlist_id, line_no, class_id from name_lines where line_kind = 'drugname' and class_id is not null
 and class_id >= 0""")
def _(spark, folder):
    return catalog.name_lines(bridge.name_lines(spark, folder)).select("allowlist_id", "line_no", "class_id")


@query("p10_item_id", "select photo_id, item_idx, photo_id || '_' || item_idx as item_id from items")
def _(spark, folder):
    items = World(spark, folder).items
    return items.select("photo_id", "item_idx", N.item_id(
        F.concat(F.col("photo_id").cast("string"), F.lit(".jpg")), F.col("item_idx")).alias("item_id"))


@query("p13_square_context", """
select item_id, l as x1, t as y1, l + s as x2, t + s as y2 from (
 select item_id, cast(floor((x1+x2)/2 - side/2) as int) as l, cast(floor((y1+y2)/2 - side/2) as int) as t,
  cast(ceil(side) as int) as s from (select *, greatest(1.0, x2-x1, y2-y1) * (1 + 2*0.12::double) as side from items))""")
def _(spark, folder):
    box = B.square_context(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return World(spark, folder).items.select("item_id", box.alias("b")).select("item_id", "b.*")


@query("p14_letterbox", """
select filename, round(f, 9) as scale, nw as new_w, nh as new_h, (640 - nw)//2 as pad_x, (640 - nh)//2 as pad_y from (
 select *, greatest(1, cast(floor(w*f + 0.5) as int)) as nw, greatest(1, cast(floor(h*f + 0.5) as int)) as nh from (
  select *, least(640.0::double/h, 640.0::double/w) as f from saved))""")
def _(spark, folder):
    rows = annotations.photo_rows(bridge.raw_photos(spark, folder), "train")
    box = rows.select(F.col("orig_file").alias("filename"), B.letterbox(F.col("width"), F.col("height")).alias("b"))
    return box.select("filename", F.round("b.scale", 9).alias("scale"), "b.new_w", "b.new_h", "b.pad_x", "b.pad_y")


@query("p15_undo_letterbox", """
select det_id, round(least(greatest((x1/2 + 3 - 0)/0.5, 0), 1280), 6) as x1, round(least(greatest((y1/2 + 3 - 80)/0.5, 0), 960), 6) as y1,
 round(least(greatest((x2/2 + 3 - 0)/0.5, 0), 1280), 6) as x2, round(least(greatest((y2/2 + 3 - 80)/0.5, 0), 960), 6) as y2
from detections""")
def _(spark, folder):
    w = World(spark, folder)
    joined = w.detections.join(w.photos, "photo_id").withColumn("b", B.letterbox(F.col("width"), F.col("height")))

    def back(name: str, axis: str, side: str):
        return F.round(B.undo_letterbox(F.col(name) / 2 + 3, F.col(f"b.pad_{axis}"), F.col("b.scale"), F.col(side)),
                       6).alias(name)

    return joined.select("det_id", back("x1", "x", "width"), back("y1", "y", "height"), back("x2", "x", "width"),
                         back("y2", "y", "height"))


@query("p16_confident_corners", "select det_id, score, x1, y1, x2, y2 from detections where score >= 0.55")
def _(spark, folder):
    dets = World(spark, folder).detections
    raw = dets.select("det_id", "score", ((F.col("x1") + F.col("x2")) / 2).alias("cx"),
                      ((F.col("y1") + F.col("y2")) / 2).alias("cy"), (F.col("x2") - F.col("x1")).alias("w"),
                      (F.col("y2") - F.col("y1")).alias("h"))
    return OB.confident_corners(raw, 0.55).select("det_id", "score", "x1", "y1", "x2", "y2")


@query("p17_relative_width", """
select item_id, round((x2 - x1) / width, 9) as rel_width from items join photos using (photo_id)""")
def _(spark, folder):
    w = World(spark, folder)
    rows = profile.relative_widths(w.items, w.photos, ("item_id",))
    return rows.select("item_id", F.round("rel_width", 9).alias("rel_width"))


VERDICTS = """
select t.scenario_id, t.item_idx, {value} from told t join decided d on d.vec_id = t.vec_id and d.listed = t.listed"""


def scenario_decisions(w: World, params=PARAMS):
    from listwarden.plans import check

    decided = check.decide_items(w.items, w.nested, w.prototypes, params, ["photo_id", "item_idx"],
                                 w.vectors)
    return decided.withColumnRenamed("list_id", "scenario_id")


@query("p18_verdict", VERDICTS.format(value="d.verdict, round(d.margin, 6) as margin"))
def _(spark, folder):
    rows = scenario_decisions(World(spark, folder))
    return rows.select("scenario_id", "item_idx", "verdict", F.round("margin", 6).alias("margin"))


@query("p19_search_verdict", """
select scenario_id, item_idx, case when p_in <= 0.5 then 'out' when p_in >= 0.5 then 'in' else 'uncertain' end as v_half,
 case when p_in <= 0.3 then 'out' when p_in >= 0.8 then 'in' else 'uncertain' end as v_wide from cal""")
def _(spark, folder):
    rows = World(spark, folder).calibrated
    return rows.select("scenario_id", "item_idx", D.search_verdict(F.col("p_in"), 0.5, 0.5).alias("v_half"),
                       D.search_verdict(F.col("p_in"), 0.8, 0.3).alias("v_wide"))


@query("p20_forced_verdict", "select scenario_id, item_idx, case when p_in >= 0.5 then 'in' else 'out' end as v from cal")
def _(spark, folder):
    rows = World(spark, folder).calibrated
    return rows.select("scenario_id", "item_idx", D.forced_verdict(F.col("p_in")).alias("v"))


@query("p21_headline_filter", """
select reason, count(*) as n from told where reason in ('listed', 'removed', 'foreign', 'unseen') group by 1""")
def _(spark, folder):
    told = World(spark, folder).told
    return told.filter(metrics.is_headline(F.col("reason"))).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("p22_explanations", """
select t.scenario_id, t.item_idx, d.verdict,
 case when d.verdict = 'in' then 'match'
  when d.verdict = 'out' then case when not list_contains(t.listed, d.best_any) then 'off_list' else 'no_match' end
  else 'undecided' end as why, l.name as listed_name, a.name as any_name
from told t join decided d on d.vec_id = t.vec_id and d.listed = t.listed
left join catalogue l on l.class_id = d.best_listed left join catalogue a on a.class_id = d.best_any""")
def _(spark, folder):
    w = World(spark, folder)
    rows = scenario_decisions(w).join(w.scenarios.select("scenario_id", "listed"), "scenario_id")
    told = metrics.explanations(rows, bridge.catalogue(spark, folder))
    return told.select("scenario_id", "item_idx", "verdict", "why", "listed_name", "any_name")


@query("p23_presentation_rounding", """
select det_id, round_even(score, 4) as score, round_even(x1 / 3, 1) as x1, round_even(y2 / 3, 1) as y2 from detections""")
def _(spark, folder):
    dets = World(spark, folder).detections
    return dets.select("det_id", NUM.half_even(F.col("score"), 4).alias("score"),
                       NUM.half_even(F.col("x1") / 3, 1).alias("x1"), NUM.half_even(F.col("y2") / 3, 1).alias("y2"))


@query("p24_class_index", """
select item_id, coalesce(idx, -1) as idx from items left join (select class_id, row_number() over (order by class_id) - 1 as idx
 from (select distinct class_id from protos)) c on c.class_id = items.label""")
def _(spark, folder):
    w = World(spark, folder)
    return sampling.indexed_labels(w.items, w.prototypes).select("item_id", "idx")


@query("f06_percent_text", """
select o_orderkey, case when o_orderkey % 5 = 0 then '–' else printf('%.1f %%', 100 * ((o_orderkey % 1000) / 1000.0::double)) end
 as pct from orders""")
def _(spark, folder):
    key = F.col("o_orderkey")
    value = F.when(key % 5 != 0, (key % 1000) / 1000.0)
    return bridge.table(spark, folder, "orders").select("o_orderkey", NUM.percent_text(value).alias("pct"))


@query("f08_rounding", """
select o_orderkey, round_even(o_orderkey / 4.0::double, 0) as even_, cast(floor(o_orderkey / 4.0::double + 0.5) as bigint) as up
from orders""")
def _(spark, folder):
    quarter = F.col("o_orderkey") / 4
    return bridge.table(spark, folder, "orders").select(
        "o_orderkey", NUM.half_even(quarter, 0).alias("even_"), NUM.half_up(quarter).alias("up"))


@query("u01_class_universe", """
select class_id from class_names union select label from items where label <> 107""")
def _(spark, folder):
    names = catalog.class_names(catalog.name_votes(bridge.name_lines(spark, folder), ["line_no"]))
    return catalog.class_universe(names, World(spark, folder).items)
