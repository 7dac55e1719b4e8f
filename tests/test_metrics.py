import numpy as np
import pytest
from pyspark.sql import functions as F

from listwarden.operators import calibration, metrics, thresholds

SCHEMA = ("scenario_id string, kind string, photo_id string, item_idx int, label int, gt string, reason string, "
          "seen boolean, detected boolean, verdict string, p_in double, best_any int")


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([
        ("a", "remove-1", "a", 0, 1, "in", "listed", True, True, "in", 0.9, 1),
        ("a", "remove-1", "a", 1, 2, "out", "removed", True, True, "out", 0.1, 2),
        ("a", "remove-1", "a", 2, 3, "out", "removed", True, True, "uncertain", 0.5, 1),
        ("b", "clean", "b", 0, 1, "in", "listed", True, False, "missed", None, None),
        ("b", "clean", "b", 1, 107, "out", "foreign", False, True, "in", 0.8, 1),
        ("c", "clean", "c", 0, 4, "out", "unseen", False, True, "out", 0.2, 1),
    ], SCHEMA)


def test_slices(records):
    rows = {r["slice"]: r for r in metrics.record_slices(records).collect()}
    head = rows["headline"]
    assert (head.n, head.n_out) == (6, 4)
    assert head.detection_recall == pytest.approx(5 / 6) and head.out_recall == pytest.approx(2 / 3)
    assert head.out_recall_strict == 0.5 and head.abstain_rate == pytest.approx(1 / 5) and head.false_alarm_rate == 0
    assert head.coverage == pytest.approx(4 / 5) and head.out_accepted_rate == 0.25
    assert head.out_precision == 1.0 and head.risk == 0.25
    assert rows["seen"].n == 4 and rows["unseen"].n == 1
    assert rows["reason:foreign"].out_recall == 0.0 and rows["reason:foreign"].out_accepted_rate == 1.0
    assert rows["no_reject"].n == 5 and rows["no_reject"].risk == pytest.approx(2 / 5)
    assert rows["no_reject"].out_recall == 0.5


def test_empty_fixed_slice_keeps_its_row(records):
    rows = {r["slice"]: r for r in metrics.record_slices(records.filter("reason = 'foreign'")).collect()}
    assert rows["seen"].n == 0 and rows["seen"].risk is None
    shown = {r["slice"]: r for r in metrics.presentation(metrics.record_slices(records)).collect()}
    assert shown["reason:listed"].out_recall == "–" and shown["reason:foreign"].out_accepted == "100.0 %"


def test_photo_level_and_confusion(spark, records):
    level = metrics.photo_level(metrics.scenario_states(records)).first()
    assert level.alert_recall == pytest.approx(2 / 3)
    assert (level.wrong_ok, level.wrong_uncertain, level.wrong_out) == (1, 0, 2)
    names = spark.createDataFrame([(1, "one"), (3, "three")], "class_id int, name string")
    pairs = metrics.confusion_pairs(records, names).collect()
    assert [(p.true, p.true_name, p.predicted, p["count"], p.share_of_true) for p in pairs] == [(3, "three", 1, 1, 1.0)]


def test_worst_verdict_per_photo(spark):
    rows = [("ok", "in", "in"), ("ok", "in", "missed"), ("unsure", "in", "in"), ("unsure", "in", "uncertain"),
            ("alarm", "in", "uncertain"), ("alarm", "in", "out"), ("ghost", "in", "in"), ("caught", "out", "out"),
            ("caught", "in", "uncertain"), ("slipped", "out", "in")]
    records = spark.createDataFrame(rows, "scenario_id string, gt string, verdict string")
    spurious = spark.createDataFrame([("ghost", "out"), ("elsewhere", "out")], "scenario_id string, verdict string")
    r = metrics.photo_level(metrics.scenario_states(records, spurious)).first()
    assert (r.n_scenarios, r.n_clean, r.n_wrong) == (6, 4, 2)
    assert (r.clean_ok, r.clean_uncertain, r.clean_out) == (1, 1, 2)
    assert (r.wrong_ok, r.wrong_uncertain, r.wrong_out) == (1, 0, 1)
    assert (r.false_alert_rate, r.check_rate_clean, r.alert_recall, r.silent_miss_rate) == (0.5, 0.25, 0.5, 0.5)


def test_naming_counts_each_item_once(spark):
    rows = [("a#c", "c", "a", 0, 1, "in", "listed", True, True, "in", None, 1),
            ("a#r", "r", "a", 0, 1, "out", "removed", True, True, "out", None, 1),
            ("a#c", "c", "a", 1, 2, "in", "listed", True, True, "uncertain", None, 3),
            ("a#r", "r", "a", 1, 2, "out", "removed", True, True, "out", None, 3),
            ("a#c", "c", "a", 2, 107, "out", "foreign", False, True, "out", None, 3)]
    r = metrics.naming(spark.createDataFrame(rows, SCHEMA)).first()
    assert (r.n_items, r.accuracy, r.removed, r.removed_misnamed) == (2, 0.5, 2, 1)
    assert (r.misnamed_out, r.misnamed_uncertain, r.misnamed_in) == (1, 0, 0)


def test_calibration_error_goldens(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, 1), (0.1, 0), (0.1, 0)], "p_in double, y_in int")
    binned = calibration.calibration_bins(df)
    assert binned.count() == 15 and calibration.calibration_error(binned).first().ece == pytest.approx(0.1)
    df = spark.createDataFrame([(0.9, 1), (0.1, 0), (0.5, 0), (0.8, 0), (0.2, 0)], "p_in double, y_in int")
    assert calibration.calibration_error(calibration.calibration_bins(df)).first().ece == pytest.approx(0.34)


def test_bins_close_at_their_upper_edge(spark):
    edges = np.linspace(0, 1, 16)
    df = spark.createDataFrame([(float(e),) for e in edges], "p double")
    found = [r[0] for r in df.select(calibration.bin_of(F.col("p"))).collect()]
    assert found == [0] + list(range(15))


def test_risk_coverage_golden(spark):
    rows = [(0, 0.9, 1), (1, 0.1, 0), (2, 0.5, 0), (3, 0.8, 0), (4, 0.2, 0)]
    df = spark.createDataFrame(rows, "ord int, p_in double, y_in int")
    area = thresholds.area_under_curve(df, "ord").first()
    assert area.aurc == pytest.approx(0.196667, abs=1e-6) and area.full_coverage_risk == pytest.approx(2 / 5)
    curve = thresholds.risk_coverage(df, "ord").orderBy("place").collect()
    assert [c.place for c in curve] == [1, 2, 3, 4, 5] and curve[2].risk == pytest.approx(1 / 3)
    assert np.isnan(thresholds.area_under_curve(df.limit(0), "ord").first().aurc)


def brute_force(p, y, lo, hi):
    v = np.full(len(p), 2)
    v[p >= hi] = 0
    v[p <= lo] = 1
    y = y.astype(bool)
    decided, out = v != 2, v == 1
    wrong = (out & y) | ((v == 0) & ~y)
    return ((~decided).mean(), (out & ~y).sum() / max(1, (decided & ~y).sum()),
            (out & y).sum() / max(1, (decided & y).sum()), wrong.sum() / max(1, decided.sum()))


def calibrated(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.clip(np.where(y, 0.75, 0.25) + rng.normal(0, 0.2, n), 0, 1)
    p[: n // 4] = np.round(p[: n // 4] * 40) * 0.025
    p[p > 1] = 1.0
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))],
                               "ord int, p_in double, y_in int")
    return df, p, y


def test_threshold_grid_equals_brute_force(spark):
    df, p, y = calibrated(spark)
    points = np.linspace(0, 1, 41)
    rows = thresholds.threshold_grid(df).collect()
    assert len(rows) == 861
    for r in rows:
        want = brute_force(p, y, points[r.lo], points[r.hi])
        assert (r.theta_out, r.theta_in) == (points[r.lo], points[r.hi])
        assert np.allclose((r.abstain_rate, r.out_recall, r.false_alarm_rate, r.risk), want)


def test_choice_respects_caps_and_relaxes(spark):
    df, p, y = calibrated(spark)
    best = thresholds.choose_thresholds(df, 0.1, 0.3, 0.9).filter("choice = 'lowest_risk'").first()
    assert best.false_alarm_rate <= 0.1 and best.abstain_rate <= 0.3 and best.out_recall >= 0.9 and not best.relaxed
    points = np.linspace(0, 1, 41)
    options = [brute_force(p, y, lo, hi) for lo in points for hi in points if lo <= hi]
    options = [o for o in options if o[0] <= 0.3 and o[1] >= 0.9 and o[2] <= 0.1]
    assert best.risk == pytest.approx(min(o[3] for o in options)) and best.n_feasible == len(options)
    hard = thresholds.choose_thresholds(df, 0.1, 0.3, 1.01).first()
    assert hard.min_out_recall_used == 0.0 and hard.relaxed
    stuck = thresholds.choose_thresholds(df, -1.0, 0.3, 0.9).first()
    assert (stuck.theta_in, stuck.theta_out, stuck.n_feasible) == (0.5, 0.5, 1)


def test_fits_beat_their_starting_points(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        slot = int(rng.integers(0, 4))
        sims = rng.normal(0.2, 0.15, 4)
        truth = int(rng.integers(0, 4))
        sims[truth] += 0.4
        rows.append((i, [float(s) for s in sims], [slot], int(truth == slot)))
    df = spark.createDataFrame(rows, "ord int, sims array<double>, slots array<int>, y_in int")
    from listwarden.constants import Params

    def loss(params):
        scored = calibration.with_p_in(df, params)
        return scored.agg(calibration.clipped_nll(F.col("p_in"), F.col("y_in"))).first()[0]

    fitted = calibration.fit_temperature_and_bias(df)
    best = loss(fitted)
    for t, b in ((0.05, 0.55), (0.05, 0.5), (0.1, 0.3), (0.02, 0.7), (fitted.temperature * 1.02, fitted.unknown_bias),
                 (fitted.temperature, fitted.unknown_bias + 0.02)):
        assert best <= loss(Params(temperature=t, unknown_bias=b)) + 1e-9
    a, b = calibration.fit_platt(calibration.with_p_in(df, fitted))
    assert loss(fitted.with_(platt_a=a, platt_b=b)) <= best + 1e-9
    from listwarden.plans.fit import fit_decision

    told = df.select("*", F.lit("s").alias("scenario_id"), F.col("ord").alias("item_idx"), F.lit("listed").alias("reason"))
    fit = fit_decision(told)
    report = {r.phase: r for r in fit.calibration.collect()}
    assert report["after"].nll < report["before"].nll and 0 <= fit.params.theta_out <= fit.params.theta_in <= 1
    assert fit.by_reason.count() == 1 and fit.no_reject.first().abstain_rate == 0.0 and fit.curve.count() == 50


def counted_rows(spark, df):
    """The rows of ``df``, and a counter of how many of them were worked out."""
    n = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            n.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), n


def decided(spark):
    rows = [(f"{p}#{k}", k, p, i, (p + i) % 3, ("listed", "removed", "unseen")[i % 3], "in" if i % 3 == 0 else "out", True, i != 4,
             ("in", "out", "uncertain")[(p * i) % 3] if i != 4 else "missed", (p * 7 + i) % 10 / 10 if i != 4 else None,
             (p * i) % 3 if i != 4 else None) for p in range(9) for i in range(5) for k in ("clean", "remove-1")]
    return spark.createDataFrame(rows, "scenario_id string, kind string, photo_id long, item_idx int, label int, reason string, "
                                       "gt string, seen boolean, detected boolean, verdict string, p_in double, best_any int")


def test_a_report_works_out_its_records_once(spark):
    from listwarden.plans import evaluate

    plain = decided(spark)
    records, n = counted_rows(spark, plain)
    rows = {(r.section, r.key, r.metric): r.value for r in evaluate.report(records).collect()}
    assert n.value == plain.count() == 90
    scored = plain.filter("reason <> 'unlisted' and detected and p_in is not null").toPandas()
    wrong = (scored["p_in"] >= 0.5) != (scored["gt"] == "in")
    assert rows["slice", "all", "n"] == 90 and abs(rows["area", "", "full_coverage_risk"] - wrong.mean()) < 1e-12


def test_examples_work_out_their_records_once(spark):
    records, n = counted_rows(spark, decided(spark))
    got = metrics.confusion_examples(records, [F.col("scenario_id"), F.col("item_idx")], 2, 3).collect()
    assert n.value == 90
    rows = decided(spark).toPandas()
    rows = rows[(rows["label"] != rows["best_any"]) & rows["best_any"].notna()]
    told = rows[rows["reason"].isin(["listed", "removed"])].groupby(["label", "best_any"]).size()
    top = sorted(told.index, key=lambda k: (-told[k], k))[:2]
    want = [(a, int(b), s, i) for a, b in top for s, i in sorted(
        rows[(rows["label"] == a) & (rows["best_any"] == b)][["scenario_id", "item_idx"]].itertuples(index=False, name=None))[:3]]
    assert sorted((r.label, r.best_any, r.scenario_id, r.item_idx) for r in got) == sorted(want) and len(want) == 6


def test_naming_compares_no_ids_unless_an_item_is_unsettled(spark, monkeypatch):
    records, last = decided(spark), F.max_by
    asked = []
    monkeypatch.setattr(F, "max_by", lambda *a: asked.append(a) or last(*a))
    known = records.filter("reason <> 'unseen' and detected").select("photo_id", "item_idx", (F.col("label") == F.col("best_any")).alias("r")).distinct()
    row = metrics.naming(records).first()
    assert not asked and row.n_items == known.count() and abs(row.accuracy - known.filter("r").count() / known.count()) < 1e-12
    moved = records.withColumn("best_any", F.when(F.col("kind") == "clean", F.col("best_any") + 1).otherwise(F.col("best_any")))
    assert metrics.naming(moved).first().accuracy == row.accuracy and asked       # the last scenario is remove-1
    assert metrics.naming(records.filter("false")).first().n_items == 0
