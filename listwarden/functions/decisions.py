"""Probability and verdict expressions over a similarity array.

``sims`` is aligned with the sorted class ids; ``slots`` holds the positions of the listed classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import Params


def platt(p: Column, a: float, b: float, eps: float = 1e-6) -> Column:
    if a == 1.0 and b == 0.0:
        return p
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) * F.log(q / (F.lit(1.0) - q)) + F.lit(b))))


def raw_p_in(sims: Column, slots: Column, temperature: float, unknown_bias: float | None) -> Column:
    """Softmax mass of the listed classes, with or without the virtual unknown class."""
    top = F.array_max(sims).cast("double")
    if unknown_bias is not None:
        top = F.greatest(F.coalesce(top, F.lit(unknown_bias)), F.lit(unknown_bias))

    def mass(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda t, s: t + F.exp((s.cast("double") - top) / temperature))

    total = mass(sims)
    if unknown_bias is not None:
        total = total + F.exp((F.lit(unknown_bias) - top) / temperature)
    return mass(F.transform(slots, lambda i: F.get(sims, i))) / total


def p_in(sims: Column, slots: Column, params: Params) -> Column:
    return platt(raw_p_in(sims, slots, params.temperature, params.unknown_bias), params.platt_a, params.platt_b)


def verdict(p: Column, margin: Column, params: Params) -> Column:
    """Per-item rule: "in" is tested first."""
    return (
        F.when((p >= params.theta_in) & (margin >= params.margin), "in")
        .when(p <= params.theta_out, "out")
        .otherwise("uncertain")
    )


def search_verdict(p: Column, theta_in: Column | float, theta_out: Column | float) -> Column:
    """Rule of the threshold search: "out" wins when both hold."""
    return F.when(p <= theta_out, "out").when(p >= theta_in, "in").otherwise("uncertain")


def forced_verdict(p: Column) -> Column:
    """Verdict without a reject option."""
    return F.when(p >= 0.5, "in").otherwise("out")


def severity(verdict_col: Column) -> Column:
    return F.when(verdict_col == "out", 2).when(verdict_col == "uncertain", 1).otherwise(0)


def state_name(severity_col: Column) -> Column:
    return F.when(severity_col == 2, "out").when(severity_col == 1, "uncertain").otherwise("ok")
