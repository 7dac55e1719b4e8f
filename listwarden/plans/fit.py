"""Validation data to decision parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_ABSTAIN, MAX_FALSE_ALARM, MIN_OUT_RECALL, Params
from ..functions.decisions import platt
from ..operators.calibration import calibration_report, fit_platt, fit_temperature_and_bias, with_shares
from ..operators.thresholds import (
    area_under_curve, choose_thresholds, params_of, ranked_errors, risk_coverage, selective_metrics)
from ..session import stored as write


@dataclass
class Fit:
    params: Params
    calibration: DataFrame
    thresholds: DataFrame
    no_reject: DataFrame
    curve: DataFrame
    area: DataFrame
    by_reason: DataFrame


def fit_decision(calibration: DataFrame, init: Params | None = None, max_false_alarm: float = MAX_FALSE_ALARM,
                 max_abstain: float = MAX_ABSTAIN, min_out_recall: float = MIN_OUT_RECALL, stored: bool = False) -> Fit:
    """Temperature and bias, then the sigmoid, then thresholds; every step is a few passes over the set, which is written
    once first unless it is ``stored`` already."""
    fixed = calibration if stored else write(calibration)
    fitted = fit_temperature_and_bias(fixed, init, stored=True)
    # The sigmoid is fitted to what it is then applied to: the softmax is worked out once for both.
    shares = write(with_shares(fixed.select("scenario_id", "item_idx", "y_in", "reason", "sims", "slots"), {"p_raw": fitted}))
    a, b = fit_platt(shares, p="p_raw")
    fitted = fitted.with_(platt_a=a, platt_b=b)
    scored = shares.select(
        "scenario_id", "item_idx", F.concat_ws("/", "scenario_id", F.lpad(F.col("item_idx").cast("string"), 19, "0")).alias("ord"),
        platt(F.col("p_raw"), a, b).alias("p_in"), "y_in", "reason")
    ranked = ranked_errors(scored, "ord", stored=True)
    chosen = choose_thresholds(scored, max_false_alarm, max_abstain, min_out_recall)
    params = params_of(chosen.filter("choice = 'lowest_risk'").first(), fitted)
    return Fit(
        params=params, calibration=calibration_report(fixed, params), thresholds=chosen,
        no_reject=selective_metrics(scored, 0.5, 0.5), curve=risk_coverage(scored, "ord", ranked=ranked),
        area=area_under_curve(scored, "ord", ranked),
        by_reason=selective_metrics(scored, params.theta_in, params.theta_out, ["reason"]))
