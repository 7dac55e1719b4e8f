import numpy as np
import pytest
from pyspark.sql import functions as F

from listwarden.constants import Params
from listwarden.functions import decisions as D
from listwarden.operators.calibration import with_p_in
from listwarden.operators.prototypes import build_prototypes, class_mean_table, export_json, nearest_accuracy
from listwarden.operators.similarity import PrototypeBlocks, class_similarities, class_slots, judge
from listwarden.sources.tables import prototypes_from_json


def axes(spark, n=4, dim=16):
    rows = [(c, 0, [1.0 if i == c else 0.0 for i in range(dim)]) for c in range(n)]
    return spark.createDataFrame(rows, "class_id int, proto_no int, vector array<double>")


def decide(spark, vector, listed, params, prototypes=None):
    df = spark.createDataFrame([("v", [float(x) for x in vector], [("l", listed)])],
                               "k string, embedding array<float>, lists array<struct<list_id:string,listed:array<int>>>")
    return judge(df, axes(spark) if prototypes is None else prototypes, params, ["k"]).first()


PARAMS = Params(temperature=0.05, unknown_bias=0.3, theta_in=0.8, theta_out=0.3)


def unit(*weights, dim=16):
    v = np.zeros(dim)
    v[:len(weights)] = weights
    return v / np.linalg.norm(v)


def test_verdicts_by_geometry(spark):
    row = decide(spark, unit(1), [0, 1], PARAMS)
    assert (row.verdict, row.best_listed, row.best_any) == ("in", 0, 0) and row.p_in > 0.9
    row = decide(spark, unit(1), [1, 2], PARAMS)
    assert row.verdict == "out" and row.p_in < 0.1 and row.best_any == 0
    row = decide(spark, unit(0, 0, 0, 0, 1), [0, 1, 2, 3], PARAMS)
    assert row.verdict == "out" and row.p_unknown > 0.5 and row.s_out == -1.0
    row = decide(spark, unit(1, 1), [0], PARAMS)
    assert row.verdict == "uncertain" and 0.3 < row.p_in < 0.8


def test_unknown_listed_ids_are_ignored_and_empty_lists_allowed(spark):
    row = decide(spark, unit(0, 0, 1), [2, 999], Params())
    assert row.verdict == "in" and row.best_listed == 2
    row = decide(spark, unit(0, 0, 1), [], Params())
    assert row.verdict == "out" and row.best_listed is None and row.s_in == -1.0 and row.p_in == 0.0


def test_no_prototypes_means_unknown(spark):
    row = decide(spark, unit(1), [0], PARAMS, axes(spark).limit(0))
    assert row.verdict == "out" and row.p_unknown == 1.0 and row.best_any is None


def test_blocks_merge_exactly(spark):
    rng = np.random.default_rng(3)
    protos = [(c, k, rng.normal(size=8).tolist()) for c in range(12) for k in range(1 + c % 3)]
    protos = spark.createDataFrame(protos, "class_id int, proto_no int, vector array<double>")
    rows = [(i, unit(*rng.normal(size=8), dim=8).tolist(),
             [("a", rng.choice(14, 3, replace=False).tolist()), ("b", [])]) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, embedding array<double>, lists array<struct<list_id:string,listed:array<int>>>")
    whole = {(r.k, r.list_id): r for r in judge(df, protos, PARAMS, ["k"]).collect()}
    parts = judge(df, protos, PARAMS, ["k"], limit_bytes=300).collect()
    assert len(list(PrototypeBlocks(protos, 300))) > 3 and len(parts) == 100
    for r in parts:
        w = whole[r.k, r.list_id]
        assert (r.verdict, r.best_listed, r.best_any) == (w.verdict, w.best_listed, w.best_any)
        assert np.allclose([r.p_in, r.p_unknown, r.s_in, r.s_out], [w.p_in, w.p_unknown, w.s_in, w.s_out])
    one = class_similarities(df, protos, ["k"]).orderBy("k").collect()
    many = class_similarities(df, protos, ["k"], limit_bytes=300).orderBy("k").collect()
    assert np.allclose([r.sims for r in one], [r.sims for r in many])


def test_array_expressions_agree_with_the_batch_job(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist(), [("l", rng.choice(6, 2, replace=False).tolist())]) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, embedding array<double>, lists array<struct<list_id:string,listed:array<int>>>")
    protos = axes(spark)
    params = PARAMS.with_(platt_a=0.9, platt_b=0.5)
    batch = {r.k: r.p_in for r in judge(df, protos, params, ["k"]).collect()}
    sims = class_similarities(df, protos, ["k"]).join(df, "k").withColumn(
        "slots", class_slots([0, 1, 2, 3], F.col("lists")[0]["listed"]))
    expression = D.p_in(F.col("sims"), F.col("slots"), params).alias("p_in")
    for scored in (with_p_in(sims, params), sims.select("k", expression)):
        assert {r.k: pytest.approx(r.p_in, abs=1e-12) for r in scored.select("k", "p_in").collect()} == batch


def test_platt(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (1.0,)], "p double")
    assert [r[0] for r in df.select(D.platt(F.col("p"), 1.0, 0.0)).collect()] == [0.5, 0.0, 1.0]
    moved = [r[0] for r in df.select(D.platt(F.col("p"), 1.0, 2.0)).collect()]
    assert moved[0] == pytest.approx(0.880797, abs=1e-6)
    ends = [r[0] for r in df.select(D.platt(F.col("p"), 0.849, 2.861)).collect()]
    assert 0 < ends[1] < ends[0] < ends[2] < 1


def test_three_verdict_rules_differ_on_the_diagonal(spark):
    df = spark.createDataFrame([(0.5,), (0.95,), (0.05,)], "p double")
    half = Params(theta_in=0.5, theta_out=0.5)
    per_item = [r[0] for r in df.select(D.verdict(F.col("p"), F.lit(0.0), half)).collect()]
    search = [r[0] for r in df.select(D.search_verdict(F.col("p"), 0.5, 0.5)).collect()]
    forced = [r[0] for r in df.select(D.forced_verdict(F.col("p"))).collect()]
    assert per_item == ["in", "in", "out"] and search == ["out", "in", "out"] and forced == per_item


def test_prototypes_are_mean_or_mean_and_two_centres(spark):
    rng = np.random.default_rng(0)
    rows = [(i, 1, (unit(1, dim=4) if i % 2 else unit(0, 1, dim=4)).tolist()) for i in range(16)]
    rows += [(100 + i, 2, rng.normal(size=4).tolist()) for i in range(15)]
    df = spark.createDataFrame(rows, "vec_id int, label int, embedding array<double>")
    protos = build_prototypes(df).orderBy("class_id", "proto_no").collect()
    assert [(p.class_id, p.proto_no) for p in protos] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    assert np.allclose(protos[0].vector, unit(1, 1, dim=4), atol=1e-6)
    centres = sorted(tuple(np.round(p.vector, 6)) for p in protos[1:3])
    assert centres == [(0.0, 1.0, 0.0, 0.0), (1.0, 0.0, 0.0, 0.0)]
    again = build_prototypes(df.repartition(5)).orderBy("class_id", "proto_no").collect()
    assert all(np.allclose(a.vector, b.vector) for a, b in zip(protos, again))


def test_prototype_export_round_trip(spark):
    protos = spark.createDataFrame([(3, 0, [0.123456, 0.5]), (3, 1, [1.0, 0.0]), (4, 0, [0.25, 0.75])],
                                   "class_id int, proto_no int, vector array<double>")
    names = spark.createDataFrame([(3, "three")], "class_id int, name string")
    lines = export_json(protos, names)
    assert '"name":"class_4"' in "".join(r.value for r in lines.collect())
    back = {(r.class_id, r.proto_no): r.vector for r in prototypes_from_json(lines).collect()}
    assert back == {(3, 0): [0.1235, 0.5], (3, 1): [1.0, 0.0], (4, 0): [0.25, 0.75]}


def test_class_means_and_accuracy_on_nothing(spark):
    df = spark.createDataFrame([(1, 0, [3.0, 4.0])], "vec_id int, label int, embedding array<double>")
    classes = spark.createDataFrame([(0,), (1,)], "class_id int")
    means = {r.class_id: r.vector for r in class_mean_table(df, classes, 2).collect()}
    assert np.allclose(means[0], [0.6, 0.8]) and means[1] == [0.0, 0.0]
    assert np.isnan(nearest_accuracy(df.limit(0), axes(spark, dim=2)).first().accuracy)
