"""Mechanisms for large tables, on small ones with their limits turned down."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwarden.constants import Params
from listwarden.operators import boxes, calibration, ordering, prototypes, sampling, scenarios, thresholds
from listwarden.sources import annotations


def lloyd(points, seeds):
    centres = seeds.copy()
    for _ in range(200):
        d = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        moved = np.array([points[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        if np.abs(moved - centres).max() < 1e-12:
            break
        centres = moved
    return centres, d.min(axis=1).sum()


@pytest.mark.parametrize("stale", [0.0, 0.3, 2.0])
def test_centres_equal_plain_lloyd(spark, monkeypatch, stale):
    monkeypatch.setattr(prototypes, "STALE_SHARE", stale)           # new bounds every round, sometimes, never
    rng = np.random.default_rng(7)
    rows = [(i, i % 3, (rng.normal(size=5) + (i % 2) * (i % 3) * 1.5).tolist(), 2 + i % 3) for i in range(240)]
    rows += [(1000 + i, 9, [1.0, 1.0, 0.0, 0.0, 0.0], 2) for i in range(20)]        # equal points
    source = spark.createDataFrame(rows, "item int, class_id int, vector array<double>, kc int")
    got = prototypes.class_centres(source, 4, 0, 4).collect()
    hashed = source.select("*", F.explode(F.array(*map(F.lit, range(4)))).alias("start")).withColumn(
        "h", prototypes.seeded_hash(0, "start", "class_id", "item")).collect()
    for class_id in (0, 1, 2):
        points = np.array([r[2] for r in rows if r[1] == class_id])
        best = None
        for start in range(4):
            order = sorted((r for r in hashed if r.class_id == class_id and r.start == start), key=lambda r: (r.h, r.item))
            centres, cost = lloyd(points, np.array([r.vector for r in order[:order[0].kc]]))
            if best is None or round(cost, 9) < best[0]:
                best = (round(cost, 9), centres)
        mine = np.array([r.vector for r in sorted((r for r in got if r.class_id == class_id), key=lambda r: r.centre)])
        assert np.allclose(mine, best[1], atol=1e-9)
    assert all(np.allclose(r.vector, [1, 1, 0, 0, 0]) for r in got if r.class_id == 9)


def test_a_round_reads_few_rows_once_centres_stand(spark, monkeypatch):
    read, sums = [], prototypes._sums

    def counted(*args):
        out = sums(*args)
        read.append(out[1])
        return out

    monkeypatch.setattr(prototypes, "_sums", counted)
    monkeypatch.setattr(prototypes, "STALE_SHARE", 0.9)
    rng = np.random.default_rng(1)
    rows = [(i, 1, (rng.normal(size=4) + 6 * (i % 2)).tolist(), 2) for i in range(2000)]
    rows += [(5000 + i, 1, (rng.normal(size=4) * 0.1 + 3).tolist(), 2) for i in range(40)]
    prototypes.class_centres(spark.createDataFrame(rows, "item int, class_id int, vector array<double>, kc int"), 2, 0, 1)
    assert read[0] == 2040 and min(read) < 400


def test_derivatives_of_the_loss(spark):
    rng = np.random.default_rng(3)
    s, mask, y = rng.normal(0.3, 0.2, (40, 6)), rng.random((40, 6)) < 0.4, (rng.random(40) < 0.5).astype(float)
    for at in ((-2.0, 0.4), (-3.0, 0.2), (-1.0, 0.9)):
        terms = calibration._point_terms(s, mask, y, *at, True)
        h = 1e-5
        f = lambda t, b, k=0: calibration._point_terms(s, mask, y, at[0] + t, at[1] + b, True)[k]     # noqa: E731
        assert np.allclose(terms[1:3], [(f(h, 0) - f(-h, 0)) / (2 * h), (f(0, h) - f(0, -h)) / (2 * h)], rtol=1e-4, atol=1e-4)
        assert np.allclose(terms[3:], [(f(h, 0, 1) - f(-h, 0, 1)) / (2 * h), (f(0, h, 1) - f(0, -h, 1)) / (2 * h),
                                       (f(0, h, 2) - f(0, -h, 2)) / (2 * h)], rtol=1e-4, atol=1e-4)


def test_a_block_makes_weights_once_for_rows_that_share_similarities(spark):
    rng = np.random.default_rng(5)
    s, mask, y = np.repeat(rng.normal(0.3, 0.3, (30, 6)), 3, axis=0), rng.random((90, 6)) < 0.4, (rng.random(90) < 0.5).astype(float)
    points = [(-2.0, 0.4), (-2.0, 0.1), (-4.5, 0.4), (-1.0, 0.9)]
    block = calibration._block(s, mask, y)
    assert len(block[0]) == 30 and len(block[1]) == 90
    wanted = []
    for log_t, bias in points:
        e, u = np.exp(s / np.exp(log_t)), np.exp(bias / np.exp(log_t))
        p = np.clip((e * mask).sum(axis=1) / (e.sum(axis=1) + u), 1e-7, 1 - 1e-7)
        wanted.append(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    assert np.allclose(calibration._block_terms(*block, points, False)[:, 0], wanted)
    rows = [(a.tolist(), np.flatnonzero(m).tolist(), int(v)) for a, m, v in zip(s, mask, y)]
    found = calibration._terms(calibration._blocks(spark.createDataFrame(rows, "sims array<double>, slots array<int>, y_in int")), np.array(points))
    assert np.allclose(found[:, 0] * 90, wanted)
    each = [sum(calibration._point_terms(s[i:i + 1], mask[i:i + 1], y[i:i + 1], *at, True) for i in range(90)) for at in points]
    assert np.allclose(found * 90, each)


def test_the_fit_of_a_decision_works_out_its_softmax_once(spark, monkeypatch):
    from listwarden.plans import fit as plan

    rng, made, written = np.random.default_rng(9), [], []
    rows = [(f"s{i % 7}", i, rng.normal(0.3, 0.2, 4).tolist(), [0, 2], int(rng.random() < 0.6), "listed") for i in range(300)]
    told = spark.createDataFrame(rows, "scenario_id string, item_idx int, sims array<double>, slots array<int>, y_in int, reason string")
    shares, kept = plan.with_shares, ordering.stored
    monkeypatch.setattr(plan, "with_shares", lambda *a: made.append(a) or shares(*a))
    monkeypatch.setattr(ordering, "stored", lambda df: written.append(df) or kept(df))
    fit = plan.fit_decision(told, stored=True)
    assert len(made) == 1 and len(written) == 1
    p = calibration.with_p_in(told, fit.params)
    got, wanted = (r.collect() for r in (fit.no_reject, thresholds.selective_metrics(p, 0.5, 0.5)))
    assert got == wanted and fit.by_reason.collect() == thresholds.selective_metrics(
        p, fit.params.theta_in, fit.params.theta_out, ["reason"]).collect()
    ranked = thresholds.ranked_errors(p.withColumn("ord", F.concat_ws("/", "scenario_id", F.lpad(F.col("item_idx").cast("string"), 19, "0"))), "ord")
    assert fit.area.collect() == thresholds.area_under_curve(p, "ord", ranked).collect()


def test_trust_step():
    for hessian in ([[2.0, 0.3], [0.3, 1.0]], [[-1.0, 0.0], [0.0, 3.0]], [[0.0, 0.0], [0.0, 0.0]]):
        g, h = np.array([0.7, -0.4]), np.array(hessian)
        step, gain = calibration.trust_step(g, h, 0.3)
        model = lambda p: g @ p + 0.5 * p @ h @ p                                      # noqa: E731
        assert np.linalg.norm(step) <= 0.3 + 1e-9 and abs(model(step) + gain) < 1e-9
        angles = np.linspace(0, 2 * np.pi, 720)
        assert gain >= max(-model(r * np.array([np.cos(a), np.sin(a)])) for a in angles for r in (0.1, 0.2, 0.3)) - 1e-6
    assert calibration.trust_step(np.zeros(2), np.eye(2), 1.0)[1] == 0.0


def test_fit_of_nothing_and_of_one_class(spark):
    schema = "sims array<double>, slots array<int>, y_in int"
    assert 0 < calibration.fit_temperature_and_bias(spark.createDataFrame([], schema)).temperature < 100
    sure = spark.createDataFrame([([0.9, 0.1], [0], 1)] * 5 + [([0.9, 0.1], [1], 0)] * 5, schema)
    fitted = calibration.fit_temperature_and_bias(sure)
    loss = calibration.with_p_in(sure.withColumn("k", F.lit(1)), fitted).agg(
        calibration.clipped_nll(F.col("p_in"), F.col("y_in"))).first()[0]
    assert loss < 1e-5 and isinstance(fitted, Params)


def in_turn(items, dets, least):
    free, out = {i: b for i, b in items}, {}
    for d, _, box in sorted(dets, key=lambda x: (-x[1], x[0])):
        best = None
        for i, other in free.items():
            w, h = min(box[2], other[2]) - max(box[0], other[0]), min(box[3], other[3]) - max(box[1], other[1])
            shared = max(w, 0) * max(h, 0)
            iou = shared / ((box[2] - box[0]) * (box[3] - box[1]) + (other[2] - other[0]) * (other[3] - other[1]) - shared + 1e-9)
            if iou >= least and (best is None or (round(iou, 12), i) > best):
                best = (round(iou, 12), i)
        if best:
            out[d] = best[1]
            del free[best[1]]
    return out


def frames(spark, items, dets):
    return (spark.createDataFrame([("p", i, *map(float, b)) for i, b in items], "photo_id string, item_idx int, x1 double, y1 double, x2 double, y2 double"),
            spark.createDataFrame([("p", d, s, *map(float, b)) for d, s, b in dets],
                                  "photo_id string, det_id string, score double, x1 double, y1 double, x2 double, y2 double"))


def test_matching_a_crowded_photo_in_turn(spark):
    rng = random.Random(2)
    boxes_of = lambda n: [(x := rng.randint(0, 60), y := rng.randint(0, 60), x + rng.randint(15, 30), y + rng.randint(15, 30))
                          for _ in range(n)]
    items = list(enumerate(boxes_of(60)))
    dets = [(f"d{i:03d}", rng.randint(1, 8) / 10, b) for i, b in enumerate(boxes_of(70))]
    got = boxes.match_boxes(*frames(spark, items, dets), min_iou=0.3, fold=4).collect()
    assert {r.det_id: r.item_idx for r in got} == in_turn(items, dets, 0.3) and len(got) > 20


def test_matching_a_chain_takes_few_rounds(spark):
    n = 1500
    items = [(k, (10 * k, 0, 10 * k + 10, 10)) for k in range(1, n + 1)]
    # Every detection prefers the item before its own; the first has only its own.
    dets = [(f"d{k:06d}", 1 - k / 10000, (10 * k + (0 if k == 1 else -6), 0, 10 * k + (10 if k == 1 else 4), 10)) for k in range(1, n + 1)]
    a, b = frames(spark, items, dets)
    pairs = boxes.overlapping_pairs(a, b, ["item_idx"], ["det_id", "score"], min_iou=0.2)
    trace = []
    got = boxes._deferred_match(pairs, "photo_id", trace).collect()
    assert {r.det_id: r.item_idx for r in got} == {f"d{k:06d}": k for k in range(1, n + 1)}
    assert len(trace) <= 3 and sum(trace) <= 15


def test_closest_boxes_of_any_size(spark):
    rng = random.Random(4)

    def some(n):
        out = []
        for _ in range(n):
            w, h = (2 ** rng.uniform(-3, 9) for _ in range(2))
            x, y = rng.uniform(-300, 300), rng.uniform(-300, 300)
            out.append((x, y, x + w, y + h))
        return [*out, (0.0, 0.0, 8.0, 8.0), (0.0, 0.0, 4.0, 8.0), (5.0, 5.0, 5.0, 9.0), (-1e6, -1e6, 1e6, 1e6), (0.0, 0.0, 1e-3, 1e-3)]

    one, two = some(150), some(150)
    a, b = frames(spark, list(enumerate(one)), [(f"d{i}", 0.5, x) for i, x in enumerate(two)])
    got = {(r.x1, r.y1, r.x2, r.y2): r.best_iou for r in boxes.best_overlap(a, b).collect()}
    for p in one:
        best = 0.0
        for q in two:
            w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
            shared = max(w, 0) * max(h, 0)
            areas = (p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1])
            best = max(best, shared / (areas - shared + 1e-9))
        assert got[p] == pytest.approx(best, abs=1e-9), p
    many = [(i, (20 * (i % 200), 20 * (i // 200), 20 * (i % 200) + 18, 20 * (i // 200) + 18)) for i in range(40_000)]
    a, b = frames(spark, many, [(f"d{i}", 0.5, x) for i, x in many])
    assert boxes.best_overlap(a, b).filter("best_iou > 0.99").count() == 40_000


def test_quantiles_by_counting(spark):
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=700) ** 5, np.r_[rng.integers(0, 4, 300), 1e300, -1e300, 3e-320], [5.0], [2.0, 2.0, 7.0]):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.937, "e": 1.0}
        got = ordering.exact_quantiles(df, "v", shares).first()
        assert np.allclose(list(got), np.quantile(np.array(values, float), list(shares.values())), rtol=1e-12)
    assert ordering.exact_quantiles(df.limit(0), "v", {"a": 0.5}).count() == 0


def test_running_totals_over_several_slices(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SLICE_ROWS", 10)
    df = spark.range(95).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"), (F.col("id") / 8).alias("x"))
    got = ordering.running_totals(df, [F.desc("k")], {"whole": F.col("n"), "part": F.col("x")}).orderBy(F.desc("k")).collect()
    assert [r.whole for r in got] == np.cumsum([r.n for r in got]).tolist()
    assert np.allclose([r.part for r in got], np.cumsum([r.x for r in got]))
    assert dict(ordering.running_totals(df, [F.col("k")], {"whole": F.col("n"), "part": F.col("x")}).dtypes)["part"] == "double"


def test_draws_from_very_many_classes(spark):
    items = spark.range(2_000_000).select(F.col("id").alias("item_id"), (F.col("id") % 1_900_000).alias("label"))
    drawn = sampling.weighted_draws(items, "item_id", 500)
    assert drawn.count() == 500 and drawn.filter(F.col("item_id") % 1_900_000 != F.col("label")).count() == 0
    assert sampling.weighted_draws(items.limit(0), "item_id", 5).count() == 0


def test_stretches_of_any_size(spark):
    stretches = spark.createDataFrame([(0, 0.0, 900.0), (1, 900.0, 900.5), (2, 900.5, 1000.0)], "s int, a double, b double")
    points = spark.createDataFrame([(v,) for v in (0.0, 899.9, 900.0, 900.4, 900.5, 999.0)], "v double")
    got = {r.v: r.s for r in sampling.in_stretch(points, "v", stretches, "a", "b", 1000 / 3).collect()}
    assert got == {0.0: 0, 899.9: 0, 900.0: 1, 900.4: 1, 900.5: 2, 999.0: 2}


def test_photos_without_a_list_are_spread(spark):
    photos = spark.range(20_000).select(F.col("id").alias("photo_id"), F.lit(None).cast("long").alias("allowlist_id"))
    photos = photos.union(spark.range(3).select(F.col("id") + 50_000, "id"))
    lists = spark.createDataFrame([(0, [1]), (1, [])], "allowlist_id long, listed array<int>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = scenarios.with_lists(photos, lists)
        sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
        rows = {r.photo_id: r.listed for r in got.filter("photo_id >= 50000").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_003 and max(sizes) < 12_000 and rows == {50_000: [1], 50_001: [], 50_002: None}


def test_one_object_of_any_size(spark, tmp_path):
    rng = random.Random(1)
    names = ["plain", 'quote " and ] both', "back\\", "], [", "{}", "é]", ""]
    for i, want in enumerate([{}, {"a": []}, {"a": ["x"], "b": ["y", "z"]}, {n: [f"{m}{n}" for m in names] for n in names},
                              {"n": None, "m": ["]"], "last": None}, {f"list {k}": [f"{rng.choice(names)}{j}" for j in range(30)] for k in range(400)}]):
        for indent in (None, 2):
            path = tmp_path / f"{i}-{indent}.json"
            path.write_text(json.dumps(want, indent=indent))
            spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
            try:
                rows = annotations.read_map(spark, str(path))
                if i == 5:
                    assert spark.read.option("lineSep", "]").text(str(path)).rdd.getNumPartitions() > 5
                got = rows.orderBy("ord").collect()
            finally:
                spark.conf.unset("spark.sql.files.maxPartitionBytes")
            assert [(r.allowlist_id, r.photo_id) for r in got] == [(k, p) for k, v in want.items() for p in v or []]
    (tmp_path / "bad.json").write_text('{"a": ["x"], "b": [nothing]}')
    with pytest.raises(Exception):
        annotations.read_map(spark, str(tmp_path / "bad.json")).collect()


def test_first_shards_are_found_by_a_listing(spark, tmp_path):
    for i in range(30):
        spark.range(i, i + 1).toPandas().to_parquet(tmp_path / f"train-{i:02d}.parquet")
    (tmp_path / "train-99.parquet").write_text("no parquet file, never opened")
    rows = annotations.read_shards(spark, str(tmp_path), "train", "id LONG", first=3)
    assert len(rows.inputFiles()) == 3 and sorted(r.id for r in rows.collect()) == [0, 1, 2]
    assert annotations.read_shards(spark, str(tmp_path), "none", "id LONG", first=3).count() == 0
