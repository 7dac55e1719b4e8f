"""Evaluation records: true items of every scenario joined with what was decided for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import Params
from ..functions.numbers import half_even
from ..operators.boxes import CORNERS, match_boxes
from ..operators.calibration import calibration_bins, calibration_error
from ..operators.metrics import is_headline, record_slices
from ..operators.scenarios import NULL_SALTS, class_array, reason, unfolded
from ..operators.similarity import judge
from ..operators.thresholds import area_under_curve, ranked_errors, risk_coverage
from ..session import dealt, discard, durable, small_side, stored
from .check import decide_items


# What records tell of a detection besides its decision, by the name it has in them.
DETECTION_COLUMNS = {"score": "det_score", "det_box": "det_box"}


def boxed_detections(dets: DataFrame, told: tuple[str, ...] = tuple(DETECTION_COLUMNS)) -> DataFrame:
    """The columns of a detection that a decision needs, and those that are ``told`` with it."""
    return dets.withColumn("det_box", detection_box(dets)).select("photo_id", "det_id", "vec_id", *told)


def detection_box(dets: DataFrame) -> Column:
    """Corners with one decimal, as records carry them; null without corners."""
    if not set(CORNERS) <= set(dets.columns):
        return F.lit(None).cast("array<double>")
    return F.array(*[half_even(F.col(c).cast("double"), 1) for c in CORNERS])


def identity_matches(items: DataFrame) -> DataFrame:
    """Ground-truth boxes in place of detections: every item is its own match."""
    return items.select("photo_id", "item_idx", F.col("item_id").alias("det_id"), F.lit(1.0).alias("iou"))


def item_detections(items: DataFrame) -> DataFrame:
    return items.withColumn("det_id", F.col("item_id")).withColumn("score", F.lit(1.0))


def claimed_detections(matches: DataFrame, boxed: DataFrame) -> DataFrame:
    """Every detection with the ``item_idx`` of the item that claimed it; ``claimed`` is null where none did."""
    claims = matches.select("photo_id", "det_id", "item_idx", F.lit(True).alias("claimed"))
    return dealt(boxed, "photo_id").join(claims, ["photo_id", "det_id"], "left")


def _entries(detected: Column) -> Column:
    """What ``judge`` checks an item against: the told side of a scenario as the id, the classes its decision is made by.

    A detected item meets every decision on its scenario (several where a photo has several rows), a missed one none.
    """
    def told(v: Column) -> Column:
        return F.struct(v["scenario_id"].alias("scenario_id"), v["kind"].alias("kind"), v["listed"].alias("listed"),
                        reason(F.col("label"), v["listed"], v["removed"], F.col("_unseen")).alias("reason"))

    def entry(v: Column, decided: Column) -> Column:
        return F.struct(told(v).alias("list_id"), decided["listed"].alias("listed"))

    met = F.flatten(F.transform("variants", lambda v: F.transform(
        F.filter("variants", lambda o: o["scenario_id"] == v["scenario_id"]), lambda o: entry(v, o))))
    # The scenarios of one row have different ids: each meets itself.
    return F.when(detected & (F.size("_nested") > 1), met).otherwise(F.transform("variants", lambda v: entry(v, v)))


def build_records(items: DataFrame, matches: DataFrame, dets: DataFrame, scenarios: DataFrame, unseen: DataFrame,
                  vectors: DataFrame, prototypes: DataFrame, params: Params,
                  told: tuple[str, ...] = tuple(DETECTION_COLUMNS)) -> DataFrame:
    """Every item in every scenario of its photo with its decision; an unmatched item is "missed" and has no scores.

    Items meet their detection, the nested scenarios of their photo and their vector, and are spread over scenarios as they
    are judged: what is shuffled is one narrow row per item, once, by its photo, and no row per scenario is joined with
    anything. Records carry what is ``told`` of a detection.
    """
    found = dealt(items.select("photo_id", "item_idx", "label"), "photo_id").join(
        matches.select("photo_id", "item_idx", "det_id"), ["photo_id", "item_idx"], "left")
    found = found.join(boxed_detections(dets, told), ["photo_id", "det_id"], "left").drop("det_id")
    return _records(found, scenarios, unseen, vectors, prototypes, params)


def _records(found: DataFrame, scenarios: DataFrame, unseen: DataFrame, vectors: DataFrame, prototypes: DataFrame,
             params: Params) -> DataFrame:
    """Records of (photo_id, item_idx, label, vec_id, what is told of a detection); vec_id is null without a detection."""
    told = {c: n for c, n in DETECTION_COLUMNS.items() if c in found.columns}
    by_photo = scenarios.groupBy("photo_id").agg(F.collect_list(F.struct("base", "variants")).alias("_nested"))
    # Items without a detection have no vector to look up; a salt spreads them (that of a vector is computed, always 0).
    spread = F.when(F.col("vec_id").isNull(), F.pmod(F.xxhash64("photo_id", "item_idx"), F.lit(NULL_SALTS))).otherwise(
        F.lit(0).cast("long"))
    known = vectors.filter(F.col("embedding").isNotNull()).select(
        "vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(1)).alias("_salt"))
    met = found.join(by_photo, "photo_id").withColumn("_salt", spread).join(small_side(known), ["vec_id", "_salt"], "left")
    met = met.withColumn("_unseen", class_array(unseen)).withColumn("variants", F.flatten(F.transform(
        "_nested", lambda n: unfolded(n["variants"], n["base"]))))
    detected = F.col("embedding").isNotNull()
    width = F.coalesce(prototypes.select(F.max(F.size("vector"))).scalar(), F.lit(1))
    nothing = F.array_repeat(F.lit(0.0), width).cast(vectors.schema["embedding"].dataType)
    checked = met.select(
        "photo_id", "item_idx", "label", detected.alias("_found"),
        *[F.when(detected, F.col(c)).alias(n) for c, n in told.items()],
        F.coalesce("embedding", nothing).alias("embedding"), _entries(detected).alias("lists"))
    decided = judge(checked, prototypes, params, ["photo_id", "item_idx", "label", "_found", *told.values()])
    own = lambda value: F.when(F.col("_found"), value)          # noqa: E731
    return decided.select(
        "list_id.scenario_id", "list_id.kind", "photo_id", "item_idx", "label",
        F.when(F.col("list_id.reason") == "listed", "in").otherwise("out").alias("gt"), "list_id.reason",
        F.coalesce(F.array_contains(class_array(prototypes), F.col("label")), F.lit(False)).alias("seen"),
        own(F.col("verdict")).isNotNull().alias("detected"), F.coalesce(own(F.col("verdict")), F.lit("missed")).alias("verdict"),
        own(half_even(F.col("p_in"), 5)).alias("p_in"), own(half_even(F.col("p_unknown"), 5)).alias("p_unknown"),
        own(F.col("best_any")).alias("best_any"), own(F.col("best_listed")).alias("best_listed"),
        own(half_even(F.col("s_in"), 4)).alias("s_in"), own(half_even(F.col("s_out"), 4)).alias("s_out"),
        *told.values(), "list_id.listed")


def build_spurious(matches: DataFrame, dets: DataFrame, scenarios: DataFrame, vectors: DataFrame, prototypes: DataFrame,
                   params: Params) -> DataFrame:
    """Decisions on detections no item claimed."""
    unmatched = dets.join(matches.select("photo_id", "det_id"), ["photo_id", "det_id"], "left_anti")
    return _spurious(boxed_detections(unmatched), scenarios, vectors, prototypes, params)


def _spurious(boxed: DataFrame, scenarios: DataFrame, vectors: DataFrame, prototypes: DataFrame, params: Params) -> DataFrame:
    """One decision per detection and scenario of its photo; a vector is compared once."""
    told = [c for c in DETECTION_COLUMNS if c in boxed.columns]
    decisions = decide_items(boxed, scenarios, prototypes, params, ["photo_id", "det_id", *told], vectors)
    return decisions.select(F.col("list_id").alias("scenario_id"), "photo_id", "det_id", "verdict",
                            half_even(F.col("p_in"), 5).alias("p_in"), *[F.col(c).alias(DETECTION_COLUMNS[c]) for c in told])


def report(records: DataFrame, points: int = 50) -> DataFrame:
    """(section, key, metric, value) of the headline figures over decided records.

    slice: rates of every slice; calibration: expected calibration error; bin: n, mean probability and share per bin;
    curve: coverage and risk at sampled places; area: area under that curve and risk at full coverage.
    The records are worked out once, and what is read of them is written.
    """
    records = stored(records.select(
        "scenario_id", "item_idx", "kind", "gt", "reason", "seen", "detected", "verdict", "p_in"))
    scored = records.filter(is_headline(F.col("reason")) & F.col("detected") & F.col("p_in").isNotNull())
    scored = scored.select("p_in", (F.col("gt") == "in").cast("int").alias("y_in"), F.concat_ws(
        "/", "scenario_id", F.lpad(F.col("item_idx").cast("string"), 19, "0")).alias("ord"))
    bins, in_order = durable(calibration_bins(scored)), ranked_errors(scored, "ord", stored=True)
    ranked = stored(in_order)
    discard(in_order)

    def rows(df: DataFrame, section: str, key: Column, values: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values])
        return df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), F.explode(pairs).alias("p")).select(
            "section", "key", "p.*")

    nothing = F.lit("")
    parts = [
        rows(record_slices(records), "slice", F.col("slice"), [
            "n", "detection_recall", "abstain_rate", "coverage", "out_recall", "out_accepted_rate", "false_alarm_rate", "risk"]),
        rows(calibration_error(bins), "calibration", nothing, ["ece"]),
        rows(bins.filter("n > 0"), "bin", F.col("bin"), ["n", "conf", "acc"]),
        rows(risk_coverage(scored, "ord", points, ranked), "curve", F.col("place"), ["coverage", "risk"]),
        rows(area_under_curve(scored, "ord", ranked), "area", nothing, ["aurc", "full_coverage_risk"]),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def evaluate(items: DataFrame, dets: DataFrame | None, scenarios: DataFrame, unseen: DataFrame, vectors: DataFrame,
             prototypes: DataFrame, params: Params, told: tuple[str, ...] = tuple(DETECTION_COLUMNS)) -> tuple[DataFrame, DataFrame]:
    """(records, spurious). Without detections the true boxes stand in for them.

    ``dets``, or ``items`` where they stand in, carry the vec_id of their vector; ``scenarios`` are nested. Records and
    spurious ones carry what is ``told`` of a detection; what is not travels through no join.
    """
    if dets is None:
        dets, matches = item_detections(items), identity_matches(items)
    else:
        matches = match_boxes(items, dets)
    # A detection meets its claim once and is judged once: for the item that claimed it, or as a spurious one.
    claimed = stored(claimed_detections(matches, boxed_detections(dets, told)))
    own = claimed.filter("claimed").select("photo_id", "item_idx", "vec_id", *told)
    found = dealt(items.select("photo_id", "item_idx", "label"), "photo_id").join(own, ["photo_id", "item_idx"], "left")
    free = claimed.filter("claimed is null").drop("item_idx", "claimed")
    return (_records(found, scenarios, unseen, vectors, prototypes, params),
            _spurious(free, scenarios, vectors, prototypes, params))
