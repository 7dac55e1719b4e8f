"""Agreement of two scored runs, and the gates that guard a changed model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BOX_RATIO_RANGE, FOREIGN, MAX_ACCURACY_DROP, MIN_BOX_IOU, MIN_COSINE
from ..functions.numbers import count_where, rate
from ..functions.vectors import dot
from .sampling import hash_sample

CORNERS = ("x1", "y1", "x2", "y2")


class GateError(RuntimeError):
    """A changed model no longer agrees with the one it replaces."""


def common_cases(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cases of both runs, once each."""
    return a.select("case_id").intersect(b.select("case_id"))


def case_agreement(a: DataFrame, b: DataFrame, cases_a: DataFrame, cases_b: DataFrame) -> DataFrame:
    """One row per case of both runs: box counts, differing verdicts and the largest gaps.

    Items are paired by position; gaps count only where both runs found the same number of boxes.
    """
    cases = common_cases(cases_a, cases_b)
    values = ["verdict", "p_in", "score", *CORNERS]
    left = a.select("case_id", "item_no", *[F.col(v).alias(f"a_{v}") for v in values])
    right = b.select("case_id", "item_no", *[F.col(v).alias(f"b_{v}") for v in values])
    gap = lambda v: F.abs(F.col(f"a_{v}") - F.col(f"b_{v}"))                           # noqa: E731
    paired = left.join(right, ["case_id", "item_no"], "full").groupBy("case_id").agg(
        F.count("a_verdict").alias("n_a"), F.count("b_verdict").alias("n_b"),
        count_where(F.col("a_verdict") != F.col("b_verdict")).alias("n_changed"),
        F.max(gap("p_in")).alias("p_gap"), F.max(gap("score")).alias("score_gap"),
        F.max(F.greatest(*map(gap, CORNERS))).alias("box_gap"))
    joined = cases.join(paired, "case_id", "left").fillna(0, ["n_a", "n_b", "n_changed"])
    same = F.col("n_a") == F.col("n_b")
    return joined.select("case_id", "n_a", "n_b", same.alias("same_count"),
                         (same & (F.col("n_changed") == 0)).alias("same_verdicts"),
                         *[F.when(same, F.col(g)).alias(g) for g in ("p_gap", "score_gap", "box_gap")])


def run_agreement(per_case: DataFrame) -> DataFrame:
    largest = lambda g: F.coalesce(F.max(g), F.lit(0.0))                               # noqa: E731
    n, same = F.count(F.lit(1)), count_where(F.col("same_verdicts"))
    return per_case.agg(
        n.alias("cases"), count_where(F.col("same_count")).alias("same_box_count"), same.alias("same_verdicts"),
        rate(same, n).alias("verdict_agreement"),
        F.coalesce(F.sum(F.when(F.col("same_count"), F.col("n_a"))), F.lit(0)).alias("items_compared"),
        largest("p_gap").alias("max_p_gap"), largest("box_gap").alias("max_box_gap"),
        largest("score_gap").alias("max_score_gap"))


def mismatches(per_case: DataFrame) -> DataFrame:
    return per_case.filter(~F.col("same_verdicts")).select("case_id", "n_a", "n_b", "same_count")


def mean_cosine(a: DataFrame, b: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    right = b.select(key, F.col(vector).alias("_other"))
    return a.select(key, vector).join(right, key).agg(F.avg(dot(F.col(vector), F.col("_other"))).alias("cosine"))


def _gate(rule: str, value: Column, passed: Column, wanted: str) -> Column:
    message = F.when(~passed, F.concat(F.lit(f"{rule} "), F.format_string("%.3f", value), F.lit(f", want {wanted}")))
    return F.struct(F.lit(rule).alias("rule"), value.alias("value"), passed.alias("passed"), message.alias("message"))


def detector_gates(report: DataFrame) -> DataFrame:
    """report: boxes_a, boxes_b, mean_best_iou."""
    low, high = BOX_RATIO_RANGE
    ratio = rate(F.col("boxes_b"), F.col("boxes_a"))
    overlap = F.col("mean_best_iou")
    gates = F.array(_gate("box_ratio", ratio, ratio.between(low, high), f"{low}..{high}"),
                    _gate("mean_best_iou", overlap, overlap >= MIN_BOX_IOU, f">= {MIN_BOX_IOU}"))
    return report.select(F.inline(gates))


def vector_gates(report: DataFrame) -> DataFrame:
    """report: cosine, accuracy_before, accuracy_after; a missing number passes its gate."""
    cosine = F.col("cosine")
    drop = F.col("accuracy_before") - F.col("accuracy_after")
    gates = F.array(
        _gate("cosine", cosine, F.coalesce(cosine >= MIN_COSINE, F.lit(True)), f">= {MIN_COSINE}"),
        _gate("accuracy_drop", drop, F.coalesce(drop <= MAX_ACCURACY_DROP, F.lit(True)), f"<= {MAX_ACCURACY_DROP}"))
    return report.select(F.inline(gates))


def enforce(gates: DataFrame) -> None:
    """Raise when a gate fails; there are two rows per report."""
    failed = [r.message for r in gates.filter(~F.col("passed")).collect()]
    if failed:
        raise GateError("; ".join(failed))


def agreement_cases(items: DataFrame, photos: DataFrame, scenarios: DataFrame, n: int = 30, with_boxes: int = 10,
                    seed: int = 0) -> DataFrame:
    """(case_id, photo_id, listed, true_boxes): sampled photos with their remove-1 list, else their own classes.

    The first ones by photo are repeated with the true boxes.
    """
    labels = items.groupBy("photo_id").agg(F.sort_array(F.collect_set(F.when(
        F.col("label") != FOREIGN, F.col("label")))).alias("own"))
    usable = photos.select("photo_id").join(labels, "photo_id")
    picked = hash_sample(usable, "photo_id", n, seed)
    removed = scenarios.filter(F.col("kind") == "remove-1").select("photo_id", "listed")
    place = F.row_number().over(Window.orderBy("photo_id")) - 1     # over at most n rows
    cases = picked.withColumn("_k", place).join(removed, "photo_id", "left").select(
        "photo_id", "_k", F.coalesce("listed", "own").alias("listed"))
    kinds = F.when(F.col("_k") < with_boxes, F.array(F.lit("#det"), F.lit("#oracle"))).otherwise(F.array(F.lit("#det")))
    spread = cases.select("photo_id", "listed", F.explode(kinds).alias("kind"))
    return spread.select(F.concat(F.col("photo_id").cast("string"), "kind").alias("case_id"), "photo_id", "listed",
                         (F.col("kind") == "#oracle").alias("true_boxes"))
