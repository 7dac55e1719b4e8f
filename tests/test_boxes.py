import numpy as np
import pytest
from pyspark.sql import functions as F

from listwarden.functions import boxes as B
from listwarden.operators import boxes as OB

DET = "photo_id string, det_id string, score double, x1 double, y1 double, x2 double, y2 double"
GT = "photo_id string, item_idx int, x1 double, y1 double, x2 double, y2 double"


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h + 1e-9)


def crowd(seed, n, photo="p", extent=400, copies=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = map(float, rng.uniform(0, extent, 2))
        w, h = map(float, rng.uniform(15, 90, 2))
        rows.append((photo, f"d{i:05d}", float(np.round(rng.uniform(0.25, 1), 2)), x, y, x + w, y + h))
    rows += [(photo, f"x{i:05d}", 0.5, 10.0, 10.0, 60.0, 60.0) for i in range(copies)]
    return rows


def greedy_keep(rows, limit, most):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], r[1])):
        if len(kept) < most and all(iou(k[3:], r[3:]) <= limit for k in kept):
            kept.append(r)
    return [k[1] for k in kept]


def test_suppression_golden(spark):
    boxes = [(0, 0, 10, 10), (1, 1, 11, 11), (50, 50, 60, 60), (0, 0, 10, 10)]
    rows = [("p", str(i), s, *map(float, b)) for i, (b, s) in enumerate(zip(boxes, (0.9, 0.8, 0.7, 0.9)))]
    df = spark.createDataFrame(rows, DET)
    assert [r.det_id for r in OB.suppress(df, limit=0.5, most=100).orderBy("keep_no").collect()] == ["0", "2"]
    assert [r.det_id for r in OB.suppress(df, limit=0.5, most=1).collect()] == ["0"]
    assert OB.suppress(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [5, 100])
def test_crowded_photo_is_suppressed_like_a_small_one(spark, most):
    rows = crowd(1, 260, "hot", copies=130) + crowd(2, 30, "calm")
    df = spark.createDataFrame(rows, DET)
    got = OB.suppress(df, limit=0.4, most=most, chunk=40).orderBy("photo_id", "keep_no").collect()
    for photo in ("hot", "calm"):
        want = greedy_keep([r for r in rows if r[0] == photo], 0.4, most)
        assert [r.det_id for r in got if r.photo_id == photo] == want


def greedy_match(gt, det, limit=0.5):
    taken, out = set(), {}
    for d in sorted(det, key=lambda d: (-d[2], d[1])):
        best = max(((iou(g[2:], d[3:]), g[1]) for g in gt if g[1] not in taken and iou(g[2:], d[3:]) >= limit), default=None)
        if best:
            taken.add(best[1])
            out[best[1]] = d[1]
    return out


def test_match_golden_and_ties(spark):
    gt = spark.createDataFrame([("p", 0, 0., 0., 10., 10.), ("p", 1, 50., 50., 60., 60.)], GT)
    det = spark.createDataFrame([("p", "0", 0.9, 1., 1., 11., 11.), ("p", "1", 0.8, 100., 100., 110., 110.),
                                 ("p", "2", 0.7, 49., 49., 61., 61.)], DET)
    assert {r.item_idx: r.det_id for r in OB.match_boxes(gt, det).collect()} == {0: "0", 1: "2"}
    twins = spark.createDataFrame([("p", 0, 0., 0., 10., 10.), ("p", 1, 0., 0., 10., 10.)], GT)
    assert {r.item_idx: r.det_id for r in OB.match_boxes(twins, det).collect()} == {1: "0"}


def test_crowded_photo_is_matched_like_a_small_one(spark):
    det = crowd(5, 120, "hot", extent=150) + crowd(6, 12, "calm", extent=80)
    rng = np.random.default_rng(7)
    gt = []
    for photo in ("hot", "calm"):
        for i, d in enumerate([d for d in det if d[0] == photo]):
            if i % 3:
                shift = rng.uniform(-6, 6, 4)
                gt.append((photo, i, *[float(c + s) for c, s in zip(d[3:], shift)]))
    got = OB.match_boxes(spark.createDataFrame(gt, GT), spark.createDataFrame(det, DET), fold=40).collect()
    for photo in ("hot", "calm"):
        want = greedy_match([g for g in gt if g[0] == photo], [d for d in det if d[0] == photo])
        assert {r.item_idx: r.det_id for r in got if r.photo_id == photo} == want


@pytest.mark.parametrize("limit", [0.2, 0.5, 0.9])
def test_pairs_equal_brute_force(spark, limit):
    det = crowd(8, 150, extent=200)
    det += [("p", f"s{i}", 0.5, r[3] + 1, r[4] + 1, r[5] + 1, r[6] + 1) for i, r in enumerate(det[:40])]
    gt = [(p, i, *box) for i, (p, _, _, *box) in enumerate(crowd(9, 80, extent=200) + det[:60])]
    got = OB.overlapping_pairs(spark.createDataFrame(gt, GT), spark.createDataFrame(det, DET), ["item_idx"], ["det_id"],
                               min_iou=limit).collect()
    want = {(g[1], d[1]) for g in gt for d in det if iou(g[2:], d[3:]) >= limit}
    assert {(r.item_idx, r.det_id) for r in got} == want and len(got) == len(want)


def test_best_overlap_equals_brute_force(spark):
    a, b = crowd(10, 60, extent=600, copies=5), crowd(11, 60, extent=600)
    got = OB.best_overlap(spark.createDataFrame(a, DET), spark.createDataFrame(b, DET)).collect()
    want = {tuple(r[3:]): max(iou(r[3:], q[3:]) for q in b) for r in a}
    assert {(r.x1, r.y1, r.x2, r.y2): pytest.approx(r.best_iou, abs=1e-9) for r in got} == want
    assert sum(r.n for r in got) == len(a)


def test_geometry_goldens(spark):
    df = spark.createDataFrame([(640, 480), (300, 1000)], "w int, h int")
    rows = [r.b for r in df.select(B.letterbox(F.col("w"), F.col("h")).alias("b")).collect()]
    assert (rows[0].scale, rows[0].pad_x, rows[0].pad_y) == (1.0, 0, 80)
    assert (rows[1].scale, rows[1].pad_x, rows[1].pad_y) == (0.64, 224, 0)
    one = spark.range(1)
    back = one.select(*[B.undo_letterbox(F.lit(v), F.lit(p), F.lit(1.0), F.lit(u)) for v, p, u in
                        ((10., 0, 640), (100., 80, 480), (200., 0, 640), (300., 80, 480))]).first()
    assert tuple(back) == (10, 20, 200, 220)
    raw = spark.createDataFrame([(120., 200., 90., 90., 0.9), (1., 1., 1., 1., 0.1)],
                                "cx double, cy double, w double, h double, score double")
    assert tuple(OB.confident_corners(raw).first()) == (0.9, 75.0, 155.0, 165.0, 245.0)   # then y - 80 after the pad
    square = one.select(B.square_context(*[F.lit(float(v)) for v in (100, 100, 160, 130)]).alias("b")).first().b
    assert tuple(square) == (92, 77, 167, 152)
    pair = spark.createDataFrame([((0., 0., 10., 10.), (1., 1., 11., 11.))],
                                 "a struct<x1:double,y1:double,x2:double,y2:double>, b struct<x1:double,y1:double,x2:double,y2:double>")
    assert pair.select(B.iou(F.col("a"), F.col("b"))).first()[0] == pytest.approx(81 / 119)


def test_detector_agreement_counts_untouched_boxes_as_zero(spark):
    a = spark.createDataFrame([("p", "0", 0.9, 0., 0., 10., 10.), ("q", "1", 0.9, 0., 0., 10., 10.)], DET)
    b = spark.createDataFrame([("p", "0", 0.9, 0., 0., 10., 10.)], DET)
    photos = spark.createDataFrame([("p",), ("q",), ("r",)], "photo_id string")
    r = OB.detector_agreement(a, b, photos).first()
    assert (r.images, r.boxes_a, r.boxes_b, r.matched) == (3, 2, 1, 1)
    assert r.same_count_rate == pytest.approx(2 / 3) and r.mean_best_iou == pytest.approx(0.5)


def test_closest_boxes_of_calm_photos_meet_in_place(spark):
    a, b = crowd(12, 60, extent=600, copies=3), crowd(13, 60, extent=600)
    a += [("gone", "x", 0.5, 0., 0., 5., 5.), (None, "y", 0.5, 0., 0., 5., 5.), ("flat", "z", 0.5, 3., 3., 3., 9.)]
    b += [(None, "y", 0.5, 0., 0., 5., 5.), ("flat", "z", 0.5, 0., 0., 9., 9.)]
    best = OB.best_overlap(spark.createDataFrame(a, DET), spark.createDataFrame(b, DET))
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan           # no rows per cell
    calm = {tuple(r) for r in best.collect()}
    cells = {tuple(r) for r in OB._overlap_in_cells(spark.createDataFrame(a, DET), spark.createDataFrame(b, DET), "photo_id").collect()}
    rounded = lambda rows: sorted(((*map(str, r[:6]), round(r[6], 9)) for r in rows))       # noqa: E731
    assert rounded(calm) == rounded(cells) and len(calm) > 60


def test_boxes_of_small_photos_meet_in_place(spark, monkeypatch):
    called, cells = [], OB._pairs_in_cells
    monkeypatch.setattr(OB, "_pairs_in_cells", lambda *a: called.append(a) or cells(*a))
    rows = [(p, i, float(i % 7 * 10), float(i % 5 * 10), float(i % 7 * 10 + 12 + p), float(i % 5 * 10 + 14)) for p in range(4) for i in range(6 + 30 * (p == 3))]
    rows += [(None, 0, 0.0, 0.0, 9.0, 9.0), (1, 90, 5.0, 5.0, 5.0, 9.0), (1, 91, None, 0.0, 9.0, 9.0)]
    a = spark.createDataFrame(rows, "photo_id long, i int, x1 double, y1 double, x2 double, y2 double")
    b = a.selectExpr("photo_id", "i as j", "x1 + 2 as x1", "y1 + 1 as y1", "x2 + 2 as x2", "y2 + 1 as y2")
    shown = lambda df: sorted(tuple(r) for r in df.collect())           # noqa: E731
    place = OB.overlapping_pairs(a, b, ["i"], ["j"], min_iou=0.3)
    assert not called and "Generate" not in place._jdf.queryExecution().executedPlan().toString()
    mixed = OB.overlapping_pairs(a, b, ["i"], ["j"], min_iou=0.3, fold=10)
    assert len(called) == 1 and shown(place) == shown(mixed) == shown(cells(a, b, ["i"], ["j"], "photo_id", 0.3)) and place.count() > 40
