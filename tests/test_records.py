"""Evaluation records: what is shuffled, and rows whose keys repeat or are missing."""

import re

from pyspark.sql import functions as F

from listwarden import session
from listwarden.constants import Params
from listwarden.operators import calibration, scenarios
from listwarden.plans import check, evaluate

PARAMS = Params(temperature=0.08, unknown_bias=0.3, theta_in=0.8, theta_out=0.3, margin=0.0, platt_a=0.9, platt_b=0.5)


def tables(spark, copies=1):
    items = spark.createDataFrame(
        [(1, 0, 10, 0), (1, 1, 11, 1), (2, 0, 12, 2), (3, 0, 13, 0), (3, 1, 14, 1), (3, 2, 10, 0)],
        "photo_id long, item_idx int, vec_id long, label int")
    base = spark.createDataFrame([(1, 7, [0, 1], [0, 1]), (2, None, [2], [2]), (3, 8, [0, 1, 2], [0, 1])] * copies,
                                 "photo_id long, allowlist_id long, base array<int>, present array<int>")
    vectors = spark.createDataFrame([(10, [1.0, 0.1]), (11, [0.1, 1.0]), (12, [0.7, 0.7]), (13, None), (14, [0.2, 0.9])],
                                    "vec_id long, embedding array<float>")
    protos = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0])], "class_id int, proto_no int, vector array<double>")
    dets = items.filter("not (photo_id = 3 and item_idx = 2)").select(
        "photo_id", F.concat_ws("_", "photo_id", "item_idx").alias("det_id"), "vec_id", F.lit(0.5).alias("score"),
        *[F.lit(float(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    dets = dets.unionByName(dets.filter("photo_id = 2").withColumn("det_id", F.lit("free")))
    matches = dets.filter("det_id <> 'free'").join(items.select("photo_id", "vec_id", "item_idx"), ["photo_id", "vec_id"]).select(
        "photo_id", "item_idx", "det_id")
    unseen = spark.createDataFrame([(2,)], "class_id int")
    return items, base, vectors, protos, dets, matches, unseen


def records(spark, copies=1):
    items, base, vectors, protos, dets, matches, unseen = tables(spark, copies)
    nested = scenarios.nested_scenarios(base)
    return evaluate.build_records(items, matches, dets, nested, unseen, vectors, protos, PARAMS), evaluate.build_spurious(
        matches, dets, nested, vectors, protos, PARAMS)


def test_no_row_per_scenario_is_shuffled(spark):
    plan = records(spark)[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Join" not in plan[:plan.index("MapInArrow")]


def test_items_are_dealt_by_photo_once(spark):
    """Items, matches and detections meet, and meet the scenarios of their photo, where they have been dealt by photo."""
    items, base, vectors, protos, dets, matches, unseen = tables(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nested = scenarios.nested_scenarios(base)
        found = evaluate.build_records(items, matches, dets, nested, unseen, vectors, protos, PARAMS, ())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not any(re.search(rf"hashpartitioning\([^)]*{c}", plan) for c in ("item_idx", "det_id"))
        assert "det_box" not in found.columns and "score#" not in plan
        claimed = evaluate.claimed_detections(matches, evaluate.boxed_detections(dets))._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\([^)]*det_id", claimed)
        whole = evaluate.build_records(items, matches, dets, nested, unseen, vectors, protos, PARAMS)
        assert sorted(map(str, found.collect())) == sorted(map(str, whole.drop("det_score", "det_box").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_items_without_detection_or_vector_are_missed(spark):
    found, spurious = (x.collect() for x in records(spark))
    per = {(r.scenario_id, r.item_idx): r for r in found}
    assert len(per) == len(found)
    for r in found:
        missed = (r.photo_id, r.item_idx) in {(3, 0), (3, 2)}
        assert r.detected != missed and (r.verdict == "missed") == missed
        assert all((r[c] is None) == missed for c in ("p_in", "s_in", "best_any", "det_score", "det_box"))
        assert r.gt == ("in" if r.reason == "listed" else "out") and r.seen == (r.label in (0, 1))
    assert {r.reason for r in found if r.label == 2} == {"unseen"}
    assert {r.det_id for r in spurious} == {"free"}


def test_photos_that_come_twice(spark):
    """Every told row meets every decision on its scenario; a missed one stays as often as it is told."""
    once, twice = records(spark)[0].collect(), records(spark, 2)[0].collect()
    assert len(twice) == sum(4 if r.detected else 2 for r in once)


def test_calibration_set_is_the_same_from_nested_scenarios(spark):
    items, base, vectors, protos, _, _, unseen = tables(spark)
    nested, known = scenarios.nested_scenarios(base), vectors.filter("embedding is not null")
    told = scenarios.scenario_items(scenarios.make_scenarios(base), items, unseen, ["item_idx", "vec_id", "label"])
    plain = calibration.calibration_set(told, known, protos, "vec_id")
    late = calibration.calibration_set((items, nested, unseen), known, protos, "vec_id")
    assert plain.columns == late.columns
    assert sorted(map(str, plain.collect())) == sorted(map(str, late.collect())) and plain.count() > 5
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan[:plan.index("Generate")]          # spread over scenarios after the last join


def test_probabilities_are_made_per_vector(spark):
    items, base, vectors, protos, _, _, unseen = tables(spark)
    told, known = (items, scenarios.nested_scenarios(base), unseen), vectors.filter("embedding is not null")
    variants = {"p_raw": PARAMS.with_(platt_a=1.0, platt_b=0.0), "p_in": PARAMS, "plain": calibration.before_params()}
    for classes in (protos, protos.filter("false")):
        want = calibration.with_probabilities(calibration.calibration_set(told, known, classes, "vec_id"), variants)
        got = calibration.calibration_probabilities(told, known, classes, "vec_id", variants)
        shown = lambda df: sorted(df.select("scenario_id", "photo_id", "item_idx", "y_in", "seen", "reason", *[
            F.round(n, 12).alias(n) for n in variants]).collect(), key=str)
        assert shown(got) == shown(want) and len(shown(got)) > 5
    plan = calibration.calibration_probabilities(told, known, protos, "vec_id", variants)._jdf.queryExecution().executedPlan()
    assert "MapInArrow" not in plan.toString()[:plan.toString().index("Generate")]     # no row per scenario goes to Python


def test_a_detection_meets_its_claim_once(spark):
    """Also where detections, items and vectors come twice; what is not told of a detection is carried nowhere."""
    from listwarden.operators.boxes import match_boxes

    items, base, vectors, protos, dets, _, unseen = tables(spark)
    nested, twice = scenarios.nested_scenarios(base), lambda df, rows: df.unionByName(df.filter(rows))      # noqa: E731
    items = items.select("*", *[F.col("item_idx") * 9 + F.lit(float(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]).toDF(
        *items.columns, "x1", "y1", "x2", "y2")
    dets = dets.drop("x1", "y1", "x2", "y2").withColumn("i", F.pmod(F.col("vec_id"), F.lit(3))).select(
        "*", *[(F.col("i") * 9 + i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]).drop("i")
    items, dets, vectors = twice(items, "photo_id = 3"), twice(dets, "vec_id in (11, 12)"), twice(vectors, "vec_id = 12")
    matches = match_boxes(items, dets)
    want = (evaluate.build_records(items, matches, dets, nested, unseen, vectors, protos, PARAMS),
            evaluate.build_spurious(matches, dets, nested, vectors, protos, PARAMS))
    shown = lambda df: sorted(map(str, df.collect()))           # noqa: E731
    for told in (("score", "det_box"), ()):
        got = evaluate.evaluate(items, dets, nested, unseen, vectors, protos, PARAMS, told)
        for g, w in zip(got, want):
            assert g.columns == [c for c in w.columns if told or c not in ("det_score", "det_box")]
            assert shown(g) == shown(w.select(g.columns)) and len(shown(g)) > 1
    plan = got[0]._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("det_id", "score#", "det_box"))


def test_few_vectors_are_sent_to_the_items(spark, monkeypatch):
    """Items that carry the scenarios of their photo are not shuffled once more to look up their vector."""
    items, base, vectors, protos, dets, matches, unseen = tables(spark)
    nested = scenarios.nested_scenarios(base)

    def both():
        found = check.decide_items(items, nested, protos, PARAMS, ["photo_id", "item_idx"], vectors.filter("vec_id <> 13"))
        return found, evaluate.build_records(items, matches, dets, nested, unseen, vectors, protos, PARAMS)

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = both()
        assert all("hashpartitioning(vec_id" not in f._jdf.queryExecution().executedPlan().toString() for f in few)
        monkeypatch.setattr(session, "BROADCAST_BYTES", 100)
        many = both()
        assert all("hashpartitioning(vec_id" in f._jdf.queryExecution().executedPlan().toString() for f in many)
        for a, b in zip(few, many, strict=True):
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())) and a.count() > 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_stream_carries_similarities_where_they_are_narrower(spark):
    from listwarden.streaming.scoring import score_stream

    rows = [(i % 3, f"d{i}", [float((i * k) % 5 + 1) for k in range(1, 13)]) for i in range(12)] + [(1, "none", None)]
    dets = spark.createDataFrame(rows, "photo_id long, det_id string, embedding array<float>")
    lists = spark.createDataFrame([(0, [0]), (1, None), (2, [0, 1, 7])], "photo_id long, listed array<int>")
    protos = spark.createDataFrame([(0, 0, [1.0] * 12), (1, 0, [1.0, 0.0] * 6), (1, 1, [0.0, 1.0] * 6)], "class_id int, proto_no int, vector array<double>")
    shown = lambda df: sorted(map(str, df.select("photo_id", "det_id", "verdict", "best_any", *[            # noqa: E731
        F.round(c, 12).alias(c) for c in ("p_in", "s_in", "s_out")]).collect()))
    for classes in (protos, protos.filter("false")):
        got = score_stream(dets, lists, classes, PARAMS)
        want = check.decide_items(dets, check.one_list(lists), classes, PARAMS, ["photo_id", "det_id"]).drop("list_id")
        assert got.columns == want.columns and shown(got) == shown(want) and len(shown(got)) == 12
    plan = score_stream(dets, lists, protos, PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan[plan.index("Join"):]            # compared before they meet their list
    wide = protos.select("*", F.explode(F.sequence(F.lit(0), F.lit(8), F.lit(2))).alias("more")).select(
        (F.col("class_id") + F.col("more")).alias("class_id"), "proto_no", "vector")
    plan = score_stream(dets, lists, wide, PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan[plan.index("Join"):]        # ten similarities are wider than twelve floats


def test_size_of_a_side(spark):
    rows = spark.createDataFrame([(1, [0.5] * 10), (2, None)], "vec_id long, embedding array<float>")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()      # noqa: E731
    size = 2 * (16 + 8 + 24 + 80)
    assert hinted(session.small_side(rows, size)) and not hinted(session.small_side(rows, size - 1))
    assert hinted(session.small_side(rows.filter("false"), 0))
