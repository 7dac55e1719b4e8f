"""Box joins, suppression and one-to-one matching inside photos of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DETECTOR_CONF, DETECTOR_IOU, DETECTOR_MAX, MATCH_IOU
from ..functions.boxes import box_struct, iou
from ..functions.numbers import count_where, rate
from ..session import discard, durable, split_by_group_size, stored

# Boxes of one photo that a single row may carry.
FOLD_BOXES = 512
MATCH_BOXES = 128
CORNERS = ("x1", "y1", "x2", "y2")


def confident_corners(raw: DataFrame, conf: float = DETECTOR_CONF) -> DataFrame:
    """Centre boxes (cx, cy, w, h, score) above the confidence -> corner boxes."""
    others = [c for c in raw.columns if c not in ("cx", "cy", "w", "h")]
    half_w, half_h = F.col("w") / 2, F.col("h") / 2
    return raw.filter(F.col("score") >= conf).select(
        *others, (F.col("cx") - half_w).alias("x1"), (F.col("cy") - half_h).alias("y1"),
        (F.col("cx") + half_w).alias("x2"), (F.col("cy") + half_h).alias("y2"))


def _size_grid(min_iou: float):
    """Blocking for pairs with IoU >= t.

    Such boxes have sides within a factor t of each other and centres within
    (side_a + side_b)(1 - t) / (2(1 + t)), so they share a size level up to one step and a nearby cell.
    """
    t = min_iou * (1 - 1e-6)
    base = 1.0 / t
    side = F.greatest(F.col("_box.x2") - F.col("_box.x1"), F.col("_box.y2") - F.col("_box.y1"))
    cx, cy = (F.col("_box.x1") + F.col("_box.x2")) / 2, (F.col("_box.y1") + F.col("_box.y2")) / 2
    level = F.floor(F.log(side) / math.log(base)).cast("int")
    upper = lambda l: F.pow(F.lit(base), l + 1)                                       # noqa: E731
    reach = lambda l: (side + upper(l)) * ((1 - t) / (2 * (1 + t))) * (1 + 1e-9)       # noqa: E731

    def cell(value: Column, l: Column) -> Column:
        return F.floor(value / upper(l))

    home = F.struct(level.alias("l"), cell(cx, level).alias("gx"), cell(cy, level).alias("gy"))
    around = F.flatten(F.transform(F.sequence(level - 1, level + 1), lambda l: F.flatten(F.transform(
        F.sequence(cell(cx - reach(l), l), cell(cx + reach(l), l)), lambda gx: F.transform(
            F.sequence(cell(cy - reach(l), l), cell(cy + reach(l), l)),
            lambda gy: F.struct(l.alias("l"), gx.alias("gx"), gy.alias("gy")))))))
    solid = (F.col("_box.x2") > F.col("_box.x1")) & (F.col("_box.y2") > F.col("_box.y1"))
    return home, around, solid


def overlapping_pairs(a: DataFrame, b: DataFrame, a_cols: list[str], b_cols: list[str],
                      photo: str = "photo_id", min_iou: float = MATCH_IOU, fold: int = MATCH_BOXES) -> DataFrame:
    """Pairs of boxes of one photo with IoU >= min_iou (> 0).

    The boxes of a photo meet in place, each one shuffled once; only photos with more than ``2 * fold`` boxes are spread
    over cells.
    """
    both = a.select(photo).unionByName(b.select(photo))
    _, crowded = split_by_group_size(both, [photo], 2 * fold)
    if crowded is None:
        return _pairs_in_place(a, b, a_cols, b_cols, photo, min_iou)
    large = crowded.distinct()
    calm = _pairs_in_place(a.join(large, photo, "left_anti"), b.join(large, photo, "left_anti"), a_cols, b_cols, photo, min_iou)
    return calm.unionByName(_pairs_in_cells(
        a.join(large, photo, "left_semi"), b.join(large, photo, "left_semi"), a_cols, b_cols, photo, min_iou))


def _pairs_in_place(a: DataFrame, b: DataFrame, a_cols: list[str], b_cols: list[str], photo: str, min_iou: float) -> DataFrame:
    """Every box of a photo against all of its other side."""
    left = a.filter(_solid()).select(photo, *a_cols, box_struct().alias("_a"))
    right = b.filter(_solid()).select(F.col(photo).alias("_photo"), *b_cols, box_struct().alias("_b"))
    shared = iou(F.col("_a"), F.col("_b"))
    return left.join(right, (F.col(photo) == F.col("_photo")) & (shared >= min_iou)).select(
        photo, *a_cols, *b_cols, shared.alias("iou"))


def _pairs_in_cells(a: DataFrame, b: DataFrame, a_cols: list[str], b_cols: list[str], photo: str, min_iou: float) -> DataFrame:
    """Joined on photo, size level and cell, so a crowded photo spreads over many tasks and only neighbours of similar size
    are compared."""
    home, around, solid = _size_grid(min_iou)
    left = a.select(photo, *a_cols, box_struct().alias("_box")).filter(solid)
    left = left.select(photo, *a_cols, F.col("_box").alias("_a"), F.explode(around).alias("_c"))
    right = b.select(F.col(photo).alias("_photo"), *b_cols, box_struct().alias("_box")).filter(solid)
    right = right.select("_photo", *b_cols, F.col("_box").alias("_b"), home.alias("_h"))
    on = ((F.col(photo) == F.col("_photo")) & (F.col("_c.l") == F.col("_h.l")) & (F.col("_c.gx") == F.col("_h.gx"))
          & (F.col("_c.gy") == F.col("_h.gy")))
    shared = iou(F.col("_a"), F.col("_b"))
    return left.join(right, on & (shared >= min_iou)).select(photo, *a_cols, *b_cols, shared.alias("iou"))


def _side_level(box: str) -> Column:
    """The smallest power of two that is no less than the longer side of a box."""
    side = F.greatest(F.col(f"{box}.x2") - F.col(f"{box}.x1"), F.col(f"{box}.y2") - F.col(f"{box}.y1"))
    guess = F.ceil(F.log2(side))
    return (guess + F.when(F.pow(F.lit(2.0), guess) < side, 1).otherwise(0)).cast("int")


def _centre_cell(box: str, level: Column, shift: Column | None = None) -> list[Column]:
    """Cells of a level are as wide as its power of two; ``shift`` moves the centre."""
    out = []
    for low, high in (("x1", "x2"), ("y1", "y2")):
        centre = (F.col(f"{box}.{low}") + F.col(f"{box}.{high}")) / 2
        out.append(F.floor((centre if shift is None else centre + shift) / F.pow(F.lit(2.0), level)))
    return out


def _near_cells(box: str, levels: Column, from_level: Column) -> Column:
    """Cells, on every level from ``from_level`` on that occurs, where the centre of a touching box of that level may be.

    Such a box is no wider than a cell and this one no wider either, so these are three cells by three at most.
    """
    side = F.greatest(F.col(f"{box}.x2") - F.col(f"{box}.x1"), F.col(f"{box}.y2") - F.col(f"{box}.y1"))

    def cells(level: Column) -> Column:
        reach = (side + F.pow(F.lit(2.0), level)) / 2 * (1 + 1e-9)
        (x1, y1), (x2, y2) = _centre_cell(box, level, -reach), _centre_cell(box, level, reach)
        return F.flatten(F.transform(F.sequence(x1, x2), lambda gx: F.transform(
            F.sequence(y1, y2), lambda gy: F.struct(level.alias("l"), gx.alias("gx"), gy.alias("gy")))))

    return F.flatten(F.transform(F.filter(levels, lambda level: level >= from_level), cells))


def best_overlap(a: DataFrame, b: DataFrame, photo: str = "photo_id", fold: int = MATCH_BOXES) -> DataFrame:
    """(photo, corners, n, best_iou): the closest b box of every distinct a box, 0 when none touches it.

    Equal boxes are counted once and weighted. The boxes of a photo meet in place, each one shuffled once; only photos with
    more than ``2 * fold`` boxes are spread over cells.
    """
    both = a.select(photo).unionByName(b.select(photo))
    _, crowded = split_by_group_size(both, [photo], 2 * fold)
    if crowded is None:
        return _overlap_in_place(a, b, photo)
    large = crowded.distinct()
    calm = _overlap_in_place(a.join(large, photo, "left_anti"), b.join(large, photo, "left_anti"), photo)
    spread = _overlap_in_cells(a.join(large, photo, "left_semi"), b.join(large, photo, "left_semi"), photo)
    return calm.unionByName(spread)


def _solid() -> Column:
    return (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))


def _overlap_in_place(a: DataFrame, b: DataFrame, photo: str) -> DataFrame:
    """Every a box against all b boxes of its photo; both sides are dealt by photo, which serves all the steps after it."""
    left = a.select(photo, *CORNERS).repartition(photo).groupBy(photo, *CORNERS).agg(F.count(F.lit(1)).alias("n"))
    right = b.filter(_solid()).select(F.col(photo).alias("_photo"), box_struct().alias("_b")).repartition("_photo")
    shared = iou(box_struct(), F.col("_b"))
    met = left.join(right, (F.col(photo) == F.col("_photo")) & _solid() & (shared > 0), "left")
    return met.groupBy(photo, *CORNERS, "n").agg(F.max(shared).alias("best_iou")).fillna(0.0, ["best_iou"])


def _overlap_in_cells(a: DataFrame, b: DataFrame, photo: str) -> DataFrame:
    """``best_overlap`` in photos of any size. Boxes have levels by size, with cells as wide as the boxes of the level.
    Of two boxes the larger one is in the cell of its centre, on its own level; the smaller one asks the nine cells around
    it on every level that occurs. However large a box or a photo is, a box has a handful of rows per level.
    """
    distinct_a = a.groupBy(photo, *CORNERS).agg(F.count(F.lit(1)).alias("n"))

    def levelled(df: DataFrame, name: str) -> DataFrame:
        boxes = df.filter(_solid()).select(F.col(photo).alias(f"{name}photo"), box_struct().alias(f"{name}box"))
        return boxes.withColumn(f"{name}level", _side_level(f"{name}box"))

    def at_home(df: DataFrame, name: str) -> DataFrame:
        gx, gy = _centre_cell(f"{name}box", F.col(f"{name}level"))
        return df.withColumn(f"{name}cell", F.struct(F.col(f"{name}level").alias("l"), gx.alias("gx"), gy.alias("gy")))

    def asking(df: DataFrame, name: str, other: DataFrame, other_name: str, above: int) -> DataFrame:
        known = df.withColumn("_known", other.select(F.collect_set(f"{other_name}level")).scalar())      # some sixty at most
        cells = _near_cells(f"{name}box", F.col("_known"), F.col(f"{name}level") + above)
        return known.withColumn(f"{name}cell", F.explode(cells)).drop("_known")

    left, right = levelled(distinct_a, "_a"), levelled(b.select(photo, *CORNERS).distinct(), "_b")
    on = (F.col("_aphoto") == F.col("_bphoto")) & (F.col("_acell") == F.col("_bcell"))
    met = [asking(left, "_a", right, "_b", 0).join(at_home(right, "_b"), on),
           at_home(left, "_a").join(asking(right, "_b", left, "_a", 1), on)]
    shared = iou(F.col("_abox"), F.col("_bbox")).alias("iou")
    pairs = met[0].select("_aphoto", "_abox", shared).union(met[1].select("_aphoto", "_abox", shared)).filter("iou > 0")
    best = pairs.groupBy(F.col("_aphoto").alias(photo), F.col("_abox").alias("_box")).agg(F.max("iou").alias("best_iou"))
    best = best.select(photo, *[F.col(f"_box.{c}").alias(c) for c in CORNERS], "best_iou")
    return distinct_a.join(best, [photo, *CORNERS], "left").fillna(0.0, ["best_iou"])


def detector_agreement(a: DataFrame, b: DataFrame, photos: DataFrame, photo: str = "photo_id") -> DataFrame:
    """Box counts and overlap of two detector runs on the same photos."""
    count = lambda df, name: df.groupBy(photo).agg(F.count(F.lit(1)).alias(name))      # noqa: E731
    sizes = photos.select(photo).join(count(a, "n_a"), photo, "left").join(count(b, "n_b"), photo, "left").fillna(
        0, ["n_a", "n_b"])
    counted = sizes.agg(F.count(F.lit(1)).alias("images"), count_where(F.col("n_a") == F.col("n_b")).alias("_same"),
                        F.sum("n_a").alias("boxes_a"), F.sum("n_b").alias("boxes_b"))
    near = best_overlap(a, b, photo).agg(
        F.coalesce(F.sum(F.when(F.col("best_iou") >= 0.5, F.col("n"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.col("best_iou") * F.col("n")), F.lit(0.0)).alias("_iou"))
    one = counted.withColumn("_k", F.lit(1)).join(near.withColumn("_k", F.lit(1)), "_k")
    return one.select("images", rate(F.col("_same"), F.col("images")).alias("same_count_rate"), "boxes_a", "boxes_b",
                      "matched", (F.col("_iou") / F.greatest(F.lit(1), F.col("boxes_a"))).alias("mean_best_iou"))


def _entry(score: str, order: str, number: Column) -> Column:
    """A box in order of choice; ``number`` tells equal rows apart where boxes are taken in parts."""
    return F.struct((-F.col(score)).cast("double").alias("rank"), F.col(order).alias("ord"),
                    *[F.col(c).cast("double").alias(c) for c in CORNERS], number.cast("long").alias("number"))


def _no_entries(df: DataFrame, order: str) -> Column:
    ord_type = df.schema[order].dataType.simpleString()
    return F.array().cast(f"array<struct<rank:double,ord:{ord_type},x1:double,y1:double,x2:double,y2:double,number:bigint>>")


def _fold(entries: Column, kept: Column, limit: float, most: int) -> Column:
    """Greedy suppression over entries in rank order, on top of the boxes kept so far."""
    def step(done: Column, box: Column) -> Column:
        hidden = F.exists(done, lambda k: iou(k, box, clamp=True) > limit)
        return F.when((F.size(done) >= most) | hidden, done).otherwise(F.concat(done, F.array(box)))
    return F.aggregate(F.sort_array(entries), kept, step)


def suppress(boxes: DataFrame, photo: str = "photo_id", score: str = "score", order: str = "det_id",
             limit: float = DETECTOR_IOU, most: int = DETECTOR_MAX, chunk: int = FOLD_BOXES) -> DataFrame:
    """Non-maximum suppression per photo: falling score, equal scores by ``order``; at most ``most`` kept.

    A photo with more boxes than a chunk is worked through in chunks of its best remaining boxes. After
    each chunk every box hidden by a kept one leaves, so copies of one box cost a single round. A box
    only depends on better ones, so the result is that of the full sequence.
    """
    small, large = split_by_group_size(boxes, [photo], chunk)
    nothing = _no_entries(boxes, order)
    folded = small.groupBy(photo).agg(F.collect_list(_entry(score, order, F.lit(0))).alias("_e")).select(
        photo, _fold(F.col("_e"), nothing, limit, most).alias("_kept"))
    done = [folded]
    if large is not None:
        rest = durable(large.select(photo, _entry(score, order, F.monotonically_increasing_id()).alias("_box")))
        kept = rest.select(photo).distinct().withColumn("_kept", nothing)
        while True:
            place = F.row_number().over(Window.partitionBy(photo).orderBy("_box"))
            head = rest.withColumn("_place", place).filter(F.col("_place") <= chunk)
            taken = head.groupBy(photo).agg(F.collect_list("_box").alias("_e"), F.max("_box").alias("_last"))
            kept = durable(kept.join(taken, photo, "left").select(
                photo, F.when(F.col("_e").isNull(), F.col("_kept"))
                .otherwise(_fold(F.col("_e"), F.col("_kept"), limit, most)).alias("_kept"),
                F.col("_last").alias("_last")))
            open_ = rest.join(kept.filter(F.size("_kept") < most), photo).filter(
                (F.col("_box") > F.col("_last"))
                & ~F.exists("_kept", lambda k: iou(k, F.col("_box"), clamp=True) > limit))
            rest = durable(open_.select(photo, "_box"))
            kept = kept.select(photo, "_kept")
            if rest.isEmpty():
                break
        done.append(kept)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    rows = out.select(photo, F.posexplode("_kept").alias("keep_no", "_k"))
    return rows.select(photo, "keep_no", F.col("_k.ord").alias(order), (-F.col("_k.rank")).alias(score),
                       *[F.col(f"_k.{c}").alias(c) for c in CORNERS])


def match_boxes(items: DataFrame, dets: DataFrame, photo: str = "photo_id", min_iou: float = MATCH_IOU,
                fold: int = MATCH_BOXES) -> DataFrame:
    """(photo, item_idx, det_id, iou): one-to-one by falling score; an IoU tie goes to the higher item index.

    Each detection takes the free item it overlaps most. Photos a row can carry are folded in place, the
    others are matched by rounds of applications over their overlapping pairs.
    """
    gt = items.select(photo, "item_idx", *CORNERS)
    det = dets.select(photo, "det_id", "score", *CORNERS)
    both = gt.select(photo).unionByName(det.select(photo))
    _, crowded = split_by_group_size(both, [photo], 2 * fold)
    if crowded is None:
        return _fold_match(gt, det, photo, min_iou)
    large = crowded.distinct()
    calm = _fold_match(gt.join(large, photo, "left_anti"), det.join(large, photo, "left_anti"), photo, min_iou)
    pairs = _pairs_in_cells(gt.join(large, photo, "left_semi"), det.join(large, photo, "left_semi"),
                            ["item_idx"], ["det_id", "score"], photo, min_iou)
    return calm.unionByName(_deferred_match(pairs, photo))


def _fold_match(gt: DataFrame, det: DataFrame, photo: str, min_iou: float) -> DataFrame:
    """Photos small enough for one row: overlapping pairs in order of choice, the first free one wins."""
    left = gt.select(photo, "item_idx", box_struct().alias("_g"))
    right = det.select(F.col(photo).alias("_photo"), "det_id", "score", box_struct().alias("_d"))
    shared = iou(F.col("_g"), F.col("_d"))
    pairs = left.join(right, (F.col(photo) == F.col("_photo")) & (shared >= min_iou))
    choice = F.struct((-F.col("score")).alias("rank"), "det_id", (-shared).alias("far"),
                      (-F.col("item_idx")).alias("back"))
    ordered = pairs.groupBy(photo).agg(F.sort_array(F.collect_list(choice)).alias("_p"))
    nothing = F.array().cast(ordered.schema["_p"].dataType)

    def step(done: Column, pair: Column) -> Column:
        taken = F.exists(done, lambda m: (m["det_id"] == pair["det_id"]) | (m["back"] == pair["back"]))
        return F.when(taken, done).otherwise(F.concat(done, F.array(pair)))

    matched = ordered.select(photo, F.explode(F.aggregate(F.col("_p"), nothing, step)).alias("_m"))
    return matched.select(photo, (-F.col("_m.back")).alias("item_idx"), "_m.det_id", (-F.col("_m.far")).alias("iou"))


def _deferred_match(pairs: DataFrame, photo: str, trace: list | None = None) -> DataFrame:
    """Detections apply to their items in order of overlap; an item keeps the best of those that ever apply.

    All items rank detections alike, so this gives what taking turns gives, in whatever order applications are handled.
    A round settles chains at once: a detection that is turned down will apply to its next item, and if it is better
    than the one kept there, that one is certain to be turned down too, and so on. Pointers from each detection to the
    one it would displace are doubled until every displaced one is known; then all of them move on. ``trace`` gets the
    number of doublings of every round.
    """
    own = [photo, "det_id"]
    rank = F.struct((-F.col("score")).alias("s"), F.col("det_id").alias("d"))
    order = Window.partitionBy(*own).orderBy(F.desc("iou"), F.desc("item_idx"))
    wishes = stored(pairs.select(*own, "item_idx", "iou", rank.alias("rank"), F.row_number().over(order).alias("pos")))
    state, spent = wishes.filter("pos = 1").select(*own, "pos"), []

    def kept(df: DataFrame) -> DataFrame:
        spent.append(stored(df))
        return spent[-1]

    while True:
        now = stored(state.join(wishes, [*own, "pos"]))
        for table in spent:
            discard(table)
        spent = [now]
        best = now.groupBy(photo, "item_idx").agg(F.min("rank").alias("kept"))
        turned_down = now.join(best, [photo, "item_idx"]).filter(F.col("rank") != F.col("kept")).select(*own)
        if turned_down.isEmpty():
            return now.select(photo, "item_idx", "det_id", "iou")
        coming = now.select(*own, "rank", (F.col("pos") + 1).alias("pos")).join(
            wishes.select(*own, "pos", "item_idx"), [*own, "pos"])
        links = kept(coming.join(best, [photo, "item_idx"]).filter(F.col("rank") < F.col("kept")).select(
            *own, F.col("kept.d").alias("next")))
        marked, doublings = kept(turned_down.distinct()), 0
        while True:
            reached = marked.join(links, own).select(photo, F.col("next").alias("det_id")).distinct()
            fresh = kept(reached.join(marked, own, "left_anti"))
            if fresh.isEmpty():
                break
            doublings += 1
            marked = kept(marked.unionByName(fresh))
            links = kept(links.join(links.select(photo, F.col("det_id").alias("next"), F.col("next").alias("after")),
                                    [photo, "next"]).select(*own, F.col("after").alias("next")))
        if trace is not None:
            trace.append(doublings)
        stay = now.select(*own, "pos").join(marked, own, "left_anti")
        move = now.select(*own, (F.col("pos") + 1).alias("pos")).join(marked, own, "left_semi").join(
            wishes.select(*own, "pos"), [*own, "pos"])
        state = stay.unionByName(move)
