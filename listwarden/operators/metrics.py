"""Metrics over evaluation records: one row per true item per scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HEADLINE_REASONS
from ..functions.decisions import forced_verdict, severity, state_name
from ..functions.numbers import count_where, percent_text, rate
from ..session import durable, stored

COUNTS = ("n", "n_out", "n_in", "n_detected", "n_uncertain", "n_decided", "n_decided_out", "n_decided_in",
          "n_called_out", "n_out_out", "n_in_out", "n_out_in", "n_detected_out")


def _counts(verdict: Column, where: Column) -> dict[str, Column]:
    """Additive counts every rate is made of."""
    out, detected = F.col("gt") == "out", F.col("detected")
    called_in, called_out = verdict == "in", verdict == "out"
    decided = called_in | called_out
    conditions = {
        "n": F.lit(True), "n_out": out, "n_in": ~out, "n_detected": detected, "n_uncertain": verdict == "uncertain",
        "n_decided": decided, "n_decided_out": decided & out, "n_decided_in": decided & ~out,
        "n_called_out": called_out, "n_out_out": called_out & out, "n_in_out": called_in & out,
        "n_out_in": called_out & ~out, "n_detected_out": detected & out,
    }
    return {name: count_where(where & condition) for name, condition in conditions.items()}


def _rates(keys: list[str]) -> list[Column]:
    c = {name: F.col(name) for name in COUNTS}
    wrong = c["n_out_in"] + c["n_in_out"]
    rates = {
        "detection_recall": rate(c["n_detected"], c["n"]),
        "abstain_rate": rate(c["n_uncertain"], c["n_detected"]),
        "coverage": rate(c["n_decided"], c["n_detected"]),
        "out_recall": rate(c["n_out_out"], c["n_decided_out"]),
        "out_recall_strict": rate(c["n_out_out"], c["n_out"]),
        "out_accepted_rate": rate(c["n_in_out"], c["n_detected_out"]),
        "false_alarm_rate": rate(c["n_out_in"], c["n_decided_in"]),
        "false_alarm_rate_strict": rate(c["n_out_in"], c["n_in"]),
        "out_precision": rate(c["n_out_out"], c["n_called_out"]),
        "risk": rate(wrong, c["n_decided"]),
        "accuracy_decided": F.lit(1.0) - rate(wrong, c["n_decided"]),
    }
    return [*map(F.col, keys), c["n"], c["n_out"], c["n_in"],
            *[F.when(c["n"] > 0, value).alias(name) for name, value in rates.items()]]


def record_rates(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = by or []
    counted = records.groupBy(*keys).agg(*[v.alias(k) for k, v in _counts(F.col("verdict"), F.lit(True)).items()])
    return counted.select(*_rates(keys))


def is_headline(reason: Column) -> Column:
    """Rows the headline figures are about."""
    return reason.isin(*HEADLINE_REASONS)


def record_slices(records: DataFrame) -> DataFrame:
    """Rates per slice: headline, all, seen, unseen, no_reject, and every reason and kind.

    The records are read once: counts per (reason, kind, seen) add up to any slice. A fixed slice that
    holds nothing keeps its row with n = 0 and null rates.
    """
    usable = F.col("detected") & F.col("p_in").isNotNull()
    forced = {f"nr_{k}": v for k, v in _counts(forced_verdict(F.col("p_in")), usable).items()}
    cells = records.groupBy("reason", "kind", F.coalesce("seen", F.lit(True)).alias("seen")).agg(
        *[v.alias(k) for k, v in {**_counts(F.col("verdict"), F.lit(True)), **forced}.items()])
    headline = is_headline(F.col("reason"))
    known = headline & (F.col("reason") != "foreign")

    def slice_(name: Column, member: Column, prefix: str = "") -> Column:
        return F.struct(name.alias("slice"),
                        *[F.when(member, F.col(prefix + c)).otherwise(0).alias(c) for c in COUNTS])

    slices = F.array(
        slice_(F.lit("headline"), headline), slice_(F.lit("all"), F.lit(True)),
        slice_(F.lit("seen"), known & F.col("seen")), slice_(F.lit("unseen"), known & ~F.col("seen")),
        slice_(F.lit("no_reject"), headline, "nr_"),
        slice_(F.concat(F.lit("reason:"), "reason"), F.lit(True)),
        slice_(F.concat(F.lit("kind:"), "kind"), F.lit(True)),
    )
    summed = cells.select(F.explode(slices).alias("s")).groupBy("s.slice").agg(
        *[F.sum(f"s.{c}").alias(c) for c in COUNTS])
    return summed.select(*_rates(["slice"]))


def confused(records: DataFrame) -> DataFrame:
    return records.filter(F.col("detected") & F.col("best_any").isNotNull() & (F.col("label") >= 0)
                          & (F.col("label") != F.col("best_any")) & F.col("reason").isin("listed", "removed"))


def confusion_pairs(records: DataFrame, names: DataFrame, top: int = 15) -> DataFrame:
    """Most frequent (true, predicted) mistakes with their share of the true class.

    Equal counts are ordered by ascending ids.
    """
    totals = records.filter(F.col("reason").isin("listed", "removed")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_label"))
    pairs = confused(records).groupBy(F.col("label").alias("true"), F.col("best_any").alias("predicted")).agg(
        F.count(F.lit(1)).alias("count"))
    best = pairs.orderBy(F.desc("count"), "true", "predicted").limit(top)
    named = best.join(totals, best["true"] == totals["label"], "left")
    for side in ("true", "predicted"):
        lookup = names.select(F.col("class_id").alias(f"_{side}"), F.col("name").alias(f"{side}_label"))
        named = named.join(lookup, F.col(side) == F.col(f"_{side}"), "left")
    return named.select(
        "true", F.coalesce("true_label", F.col("true").cast("string")).alias("true_name"), "predicted",
        F.coalesce("predicted_label", F.col("predicted").cast("string")).alias("predicted_name"), "count",
        rate(F.col("count"), F.coalesce("n_label", F.lit(0))).alias("share_of_true"))


def confusion_examples(records: DataFrame, order: list[Column], pairs: int = 6, each: int = 4) -> DataFrame:
    """The first records of each of the most confused pairs; tasks keep at most ``each`` rows per pair.

    The records are worked out once: those of another class than the nearest, which any of the pairs is made of, are written.
    """
    records = stored(records.filter((F.col("label") >= 0) & (F.col("label") != F.col("best_any"))))
    top = confused(records).groupBy("label", "best_any").agg(F.count(F.lit(1)).alias("_n")).orderBy(
        F.desc("_n"), "label", "best_any").limit(pairs)
    hits = records.join(F.broadcast(top), ["label", "best_any"])   # at most ``pairs`` rows
    place = F.row_number().over(Window.partitionBy("label", "best_any").orderBy(*order))
    return hits.withColumn("example_no", place).filter(F.col("example_no") <= each).drop("_n")


def naming(records: DataFrame) -> DataFrame:
    """Accuracy of the nearest class over distinct items, and what wrong names of removed items cost.

    An item is right as its last scenario has it. The scenarios of an item are looked at in order only if any item is right
    in one and wrong in another, so that rows of whole numbers are counted by hash and ids are not compared.
    """
    known = records.filter(F.col("reason").isin("listed", "removed") & F.coalesce("seen", F.lit(True))
                           & F.col("detected") & F.col("best_any").isNotNull())
    right = F.col("best_any") == F.col("label")
    removed = F.col("reason") == "removed"
    wrong = removed & ~right
    zero = F.lit(0)

    def counted(last: Column, settled: Column) -> DataFrame:
        per_item = known.groupBy("photo_id", "item_idx").agg(
            last.alias("right"), settled.alias("settled"), count_where(removed).alias("removed"),
            count_where(wrong).alias("misnamed"),
            *[count_where(wrong & (F.col("verdict") == v)).alias(v) for v in ("out", "uncertain", "in")])
        return durable(per_item.agg(
            F.count(F.lit(1)).alias("n_items"), rate(count_where(F.col("right")), F.count(F.lit(1))).alias("accuracy"),
            F.coalesce(F.sum("removed"), zero).alias("removed"),
            F.coalesce(F.sum("misnamed"), zero).alias("removed_misnamed"),
            *[F.coalesce(F.sum(v), zero).alias(f"misnamed_{v}") for v in ("out", "uncertain", "in")],
            count_where(~F.col("settled")).alias("unsettled")))

    found = counted(F.max(right), F.min(right) == F.max(right))
    if found.first()["unsettled"]:
        found = counted(F.max_by(right, "scenario_id"), F.lit(True))
    return found.drop("unsettled")


def scenario_states(records: DataFrame, spurious: DataFrame | None = None) -> DataFrame:
    """(scenario_id, state, wrong): the worst verdict shown, spurious boxes included, misses invisible."""
    rows = records.select("scenario_id", severity(F.col("verdict")).alias("level"),
                          (F.col("gt") == "out").alias("wrong"))
    if spurious is not None:
        extra = spurious.select("scenario_id", severity(F.col("verdict")).alias("level"),
                                F.lit(None).cast("boolean").alias("wrong"))
        rows = rows.unionByName(extra)
    grouped = rows.groupBy("scenario_id").agg(F.max("level").alias("level"), F.bool_or("wrong").alias("wrong"))
    # A scenario without a record has a null flag: its spurious boxes do not count.
    return grouped.filter(F.col("wrong").isNotNull()).select("scenario_id", state_name(F.col("level")).alias("state"),
                                                             "wrong")


def photo_level(states: DataFrame) -> DataFrame:
    """One row: counts per state for clean and wrong photos, and the four photo-level rates."""
    cells = {f"{group}_{state}": count_where((F.col("wrong") if group == "wrong" else ~F.col("wrong"))
                                             & (F.col("state") == state))
             for group in ("clean", "wrong") for state in ("ok", "uncertain", "out")}
    counted = states.agg(F.count(F.lit(1)).alias("n_scenarios"), count_where(~F.col("wrong")).alias("n_clean"),
                         count_where(F.col("wrong")).alias("n_wrong"), *[v.alias(k) for k, v in cells.items()])
    return counted.select(
        "*", rate(F.col("wrong_out"), F.col("n_wrong")).alias("alert_recall"),
        rate(F.col("clean_out"), F.col("n_clean")).alias("false_alert_rate"),
        rate(F.col("clean_uncertain"), F.col("n_clean")).alias("check_rate_clean"),
        rate(F.col("wrong_ok"), F.col("n_wrong")).alias("silent_miss_rate"))


def photo_table(states: DataFrame) -> DataFrame:
    """Share of each state among clean and among wrong photos."""
    group = F.when(F.col("wrong"), "wrong").otherwise("clean")
    counts = states.groupBy(group.alias("grp")).agg(
        F.count(F.lit(1)).alias("n"), *[count_where(F.col("state") == s).alias(s) for s in ("ok", "uncertain", "out")])
    return counts.select("grp", "n", *[c for s in ("ok", "uncertain", "out") for c in (
        F.col(s), percent_text(rate(F.col(s), F.col("n"))).alias(f"{s}_share"))])


def unseen_groups(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, n_classes, present, n_items) for held-out and untrained classes; ``groups`` is (grp, class_id)."""
    hits = records.filter(F.col("reason") == "unseen").groupBy(F.col("label").alias("class_id")).agg(
        F.count(F.lit(1)).alias("n"))
    joined = groups.join(hits, "class_id", "left")
    present = F.sort_array(F.collect_set(F.when(F.col("n") > 0, F.col("class_id"))))
    return joined.groupBy("grp").agg(
        F.countDistinct("class_id").alias("n_classes"), F.array_join(present, ",").alias("present"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"))


def listed_without_prototype(records: DataFrame) -> DataFrame:
    return records.filter((F.col("gt") == "in") & ~F.col("seen")).select("label").distinct()


def unique_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("photo_id", "item_idx").agg(F.count(F.lit(1)).alias("n")).agg(
        F.countDistinct("photo_id").alias("n_photos"), F.count(F.lit(1)).alias("n_items"),
        F.sum("n").alias("n_records"))


def spurious_counts(spurious: DataFrame) -> DataFrame:
    return spurious.agg(F.count(F.lit(1)).alias("n_spurious"),
                        *[count_where(F.col("verdict") == v).alias(f"n_{v}") for v in ("in", "out", "uncertain")])


def presentation(slices: DataFrame) -> DataFrame:
    """Benchmark table: a rate without a denominator prints as a dash."""
    has_out, has_in = F.col("n_out") > 0, F.col("n_in") > 0
    return slices.filter("n > 0").select(
        "slice", "n", percent_text(F.when(has_out, F.col("out_recall"))).alias("out_recall"),
        percent_text(F.when(has_in, F.col("false_alarm_rate"))).alias("false_alarm"),
        percent_text(F.col("abstain_rate")).alias("abstain"),
        percent_text(F.when(has_out, F.col("out_accepted_rate"))).alias("out_accepted"))


def banners(decisions: DataFrame, photos: DataFrame, key: str = "photo_id") -> DataFrame:
    """What a user reads per photo: nothing found, an alert, something unsure, or all fine."""
    counts = decisions.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("verdict") == "out").alias("n_out"),
        count_where(F.col("verdict") == "uncertain").alias("n_uncertain"))
    joined = photos.select(key).join(counts, key, "left").fillna(0, ["n", "n_out", "n_uncertain"])
    banner = (F.when(F.col("n") == 0, "none").when(F.col("n_out") > 0, "alert")
              .when(F.col("n_uncertain") > 0, "unsure").otherwise("ok"))
    return joined.select(key, "n", "n_out", "n_uncertain", banner.alias("banner"))


def explanations(decisions: DataFrame, names: DataFrame) -> DataFrame:
    """Adds ``why`` (match, off_list, no_match or undecided) and the two names it is about: the best listed class and
    the best class of all, null where there is none. ``decisions`` carries verdict, best_listed, best_any and listed.

    Rows without a best listed class skip the join, so that they do not meet in one task.
    """
    listed_name = names.select(F.col("class_id").alias("best_listed"), F.col("name").alias("listed_name"))
    any_name = names.select(F.col("class_id").alias("best_any"), F.col("name").alias("any_name"))
    known = decisions.filter(F.col("best_listed").isNotNull()).join(listed_name, "best_listed", "left")
    none = decisions.filter(F.col("best_listed").isNull()).withColumn("listed_name", F.lit(None).cast("string"))
    joined = known.unionByName(none).join(any_name, "best_any", "left")
    off_list = F.col("best_any").isNotNull() & ~F.array_contains("listed", F.col("best_any"))
    why = (F.when(F.col("verdict") == "in", "match").when((F.col("verdict") == "out") & off_list, "off_list")
           .when(F.col("verdict") == "out", "no_match").otherwise("undecided"))
    return joined.select(*decisions.columns, why.alias("why"), "listed_name", "any_name")
