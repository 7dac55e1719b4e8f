"""Selective prediction: metrics at given thresholds, threshold search, risk against coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_ABSTAIN, MAX_FALSE_ALARM, MIN_OUT_RECALL, THRESHOLD_GRID, Params
from ..functions.decisions import search_verdict
from ..functions.numbers import count_where, half_even, rate
from ..session import durable
from .ordering import running_totals


def _metrics(n, out_out, in_out, out_in, in_in, n_out, n_in) -> dict[str, Column]:
    """Rates from the four decided cells; ``out_in`` is a true in item called out."""
    decided = out_out + in_out + out_in + in_in
    wrong = out_in + in_out
    return {
        "abstain_rate": rate(n - decided, n), "coverage": rate(decided, n),
        "out_recall": rate(out_out, out_out + in_out), "out_recall_strict": rate(out_out, n_out),
        "false_alarm_rate": rate(out_in, out_in + in_in), "false_alarm_rate_strict": rate(out_in, n_in),
        "out_precision": rate(out_out, out_out + out_in), "risk": rate(wrong, decided),
        "accuracy_decided": F.lit(1.0) - rate(wrong, decided),
    }


def selective_metrics(df: DataFrame, theta_in: float, theta_out: float, by: list[str] | None = None,
                      p: str = "p_in", y: str = "y_in") -> DataFrame:
    """The twelve numbers of selective prediction, overall or per group."""
    keys = by or []
    verdict, is_in = search_verdict(F.col(p), theta_in, theta_out), F.col(y) == 1
    cells = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), count_where(~is_in).alias("n_out"), count_where(is_in).alias("n_in"),
        count_where((verdict == "out") & ~is_in).alias("_oo"), count_where((verdict == "in") & ~is_in).alias("_io"),
        count_where((verdict == "out") & is_in).alias("_oi"), count_where((verdict == "in") & is_in).alias("_ii"))
    c = F.col
    values = _metrics(c("n"), c("_oo"), c("_io"), c("_oi"), c("_ii"), c("n_out"), c("n_in"))
    return cells.select(*keys, "n", "n_out", "n_in", *[v.alias(k) for k, v in values.items()])


def grid_point(index: Column, grid: int = THRESHOLD_GRID) -> Column:
    """index-th point of the even grid on [0, 1]."""
    return F.when(index == grid - 1, F.lit(1.0)).otherwise(index.cast("double") * F.lit(1.0 / (grid - 1)))


def threshold_grid(df: DataFrame, grid: int = THRESHOLD_GRID, p: str = "p_in", y: str = "y_in") -> DataFrame:
    """Metrics at every pair theta_out <= theta_in of the grid.

    One pass counts the rows per grid cell; everything after works on a table of fixed size.
    """
    last = grid - 1
    value = F.col(p)
    guess = F.least(F.lit(last), F.greatest(F.lit(0), F.floor(value * last))).cast("int")
    cell = (F.when(value < grid_point(guess, grid), guess - 1)
            .when((guess < last) & (value >= grid_point(guess + 1, grid)), guess + 1).otherwise(guess))
    cells = (
        df.select(cell.alias("cell"), value.alias("_p"), (F.col(y) == 1).alias("is_in"))
        .groupBy("cell", (F.col("_p") == grid_point(F.col("cell"), grid)).alias("on"), "is_in")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    at = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("i"))
    at_or_above = F.col("cell") >= F.col("i")
    equal = (F.col("cell") == F.col("i")) & F.col("on")
    at_or_below = (F.col("cell") < F.col("i")) | equal

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    sides = {"in": F.col("is_in"), "out": ~F.col("is_in")}
    points = at.groupBy("i").agg(
        *[total(side & cond).alias(f"{name}_{s}") for s, side in sides.items()
          for name, cond in (("ge", at_or_above), ("le", at_or_below), ("eq", equal), ("all", F.lit(True)))])
    low = points.select(F.col("i").alias("lo"), "le_in", "le_out")
    high = points.select(F.col("i").alias("hi"), "ge_in", "ge_out", "eq_in", "eq_out", "all_in", "all_out",
                         F.explode(F.sequence(F.lit(0), F.col("i"))).alias("lo"))
    pairs = high.join(low, "lo")
    same = F.col("lo") == F.col("hi")
    c = F.col
    # On the diagonal "out" wins, so rows exactly on the threshold are not "in".
    in_in = c("ge_in") - F.when(same, c("eq_in")).otherwise(0)
    in_out = c("ge_out") - F.when(same, c("eq_out")).otherwise(0)
    values = _metrics(c("all_in") + c("all_out"), c("le_out"), in_out, c("le_in"), in_in, c("all_out"), c("all_in"))
    return pairs.select("lo", "hi", grid_point(c("lo"), grid).alias("theta_out"),
                        grid_point(c("hi"), grid).alias("theta_in"), *[v.alias(k) for k, v in values.items()])


def abstain_caps(first: float) -> list[float]:
    """The caps tried in turn, 0.05 apart, while they stay within 1."""
    caps = []
    while first <= 1.0 + 1e-9:
        caps.append(first)
        first += 0.05
    return caps


def feasible(grid: DataFrame, max_false_alarm: float = MAX_FALSE_ALARM, max_abstain: float = MAX_ABSTAIN,
             min_out_recall: float = MIN_OUT_RECALL) -> DataFrame:
    return grid.filter((F.col("false_alarm_rate") <= max_false_alarm) & (F.col("abstain_rate") <= max_abstain)
                       & (F.col("out_recall") >= min_out_recall))


def choose_thresholds(df: DataFrame, max_false_alarm: float = MAX_FALSE_ALARM, max_abstain: float = MAX_ABSTAIN,
                      min_out_recall: float = MIN_OUT_RECALL, grid: int = THRESHOLD_GRID) -> DataFrame:
    """Two rows, the lowest-risk choice and the highest-recall alternative, with what was relaxed.

    Order of relaxing: the abstain cap step by step, then the recall floor, then no reject option.
    """
    caps = abstain_caps(max_abstain)
    table = durable(threshold_grid(df, grid))
    ok_alarm = F.col("false_alarm_rate") <= max_false_alarm
    step = F.lit(None).cast("int")
    for i in reversed(range(len(caps))):
        step = F.when(F.col("abstain_rate") <= caps[i], i).otherwise(step)
    whole = Window.partitionBy()     # the grid has a fixed number of rows
    ranked = table.withColumn("_step", F.when(ok_alarm & (F.col("out_recall") >= min_out_recall), step))
    ranked = ranked.withColumn("_used", F.min("_step").over(whole))
    floor_free = ok_alarm & (F.col("abstain_rate") <= max_abstain) & F.lit(min_out_recall > 0.0)
    ranked = ranked.withColumn("_free", F.max(floor_free).over(whole))
    member = F.when(F.col("_used").isNotNull(), F.col("_step") <= F.col("_used")).otherwise(floor_free)
    kept = ranked.filter(F.coalesce(member, F.lit(False)))
    middle = (grid - 1) / 2
    half = table.filter((F.col("lo") == middle) & (F.col("hi") == middle)) if middle == int(middle) else (
        selective_metrics(df, 0.5, 0.5))
    none = half.select(
        F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), F.lit(0.5).alias("theta_out"),
        F.lit(0.5).alias("theta_in"), *table.columns[4:], F.lit(None).cast("int").alias("_step"),
        F.lit(None).cast("int").alias("_used"), F.lit(False).alias("_free"))
    pool = kept.select(*none.columns).unionByName(
        none.filter(kept.select(F.count(F.lit(1))).scalar() == 0))
    pool = pool.withColumn("n_feasible", F.count(F.lit(1)).over(whole))
    orders = {
        "lowest_risk": [F.col("risk"), F.desc("out_recall"), F.col("abstain_rate"), F.col("lo"), F.col("hi")],
        "most_recall": [F.desc("out_recall"), F.col("abstain_rate"), F.col("false_alarm_rate"), F.col("lo"),
                        F.col("hi")],
    }
    # With no feasible pair at any cap the search restarts from the first cap with the floor dropped.
    cap = F.element_at(F.lit(caps), F.coalesce(F.col("_used"), F.lit(0)) + 1)
    floor = F.when(F.col("_used").isNotNull(), F.lit(min_out_recall)).otherwise(F.lit(0.0))
    rows = None
    for name, order in orders.items():
        row = pool.orderBy(*order).limit(1).select(
            F.lit(name).alias("choice"), "theta_in", "theta_out", *table.columns[4:], "n_feasible",
            cap.alias("max_abstain_used"), floor.alias("min_out_recall_used"),
            ((F.coalesce(F.col("_used"), F.lit(len(caps))) > 0) | (floor != min_out_recall)).alias("relaxed"))
        rows = row if rows is None else rows.unionByName(row)
    return rows


def ranked_errors(df: DataFrame, order: str, p: str = "p_in", y: str = "y_in", stored: bool = False) -> DataFrame:
    """(place, errors): running error count by falling confidence, ties in source order. ``stored`` rows come from a stored
    table by plain expressions and are not written again."""
    value = F.col(p)
    scored = df.select(F.greatest(value, 1 - value).alias("_conf"), F.col(order).alias("_ord"),
                       ((value >= 0.5) != (F.col(y) == 1)).cast("int").alias("_wrong"))
    return running_totals(scored, [F.desc("_conf"), F.col("_ord")],
                          {"place": F.lit(1), "errors": F.col("_wrong")}, is_stored=stored).select("place", "errors")


def curve_places(n: int, points: int = 50) -> list[int]:
    """The sampled places: an even grid from 1 to n, rounded half to even."""
    if n == 0:
        return []
    step = (n - 1) / (points - 1)
    return sorted({min(n, max(1, round(1 + i * step))) for i in range(points)})


def risk_coverage(df: DataFrame, order: str, points: int = 50, ranked: DataFrame | None = None) -> DataFrame:
    """(place, coverage, risk) at the sampled places; ``ranked`` are the ``ranked_errors`` where they are at hand.

    The rows are counted in the order, which is stored, so that ``df`` is worked out once.
    """
    ranked = ranked_errors(df, order) if ranked is None else ranked
    n = ranked.count()
    return ranked.filter(F.col("place").isin(curve_places(n, points))).select(
        "place", rate(F.col("place"), F.lit(n)).alias("coverage"),
        (F.col("errors") / F.col("place")).alias("risk"))


def area_under_curve(df: DataFrame, order: str, ranked: DataFrame | None = None) -> DataFrame:
    """Mean of all prefix risks, and the risk at full coverage; NaN on no rows."""
    ranked = ranked_errors(df, order) if ranked is None else ranked
    nan = F.lit(float("nan"))
    return ranked.agg(
        F.coalesce(F.avg(F.col("errors") / F.col("place")), nan).alias("aurc"),
        F.coalesce(F.max("errors") / F.max("place"), nan).alias("full_coverage_risk"))


def rounded(df: DataFrame, decimals: int = 5, p: str = "p_in") -> DataFrame:
    return df.withColumn(p, half_even(F.col(p), decimals))


def params_of(row, base: Params) -> Params:
    return base.with_(theta_in=float(row["theta_in"]), theta_out=float(row["theta_out"]))
