"""Counterfactual scenarios: each photo against its allow-list as written and with classes removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FOREIGN, SEED
from ..functions.hashing import seeded_hash
from ..functions.numbers import count_where


def class_array(classes: DataFrame) -> Column:
    """The sorted ids of a class table as one array; bounded by the number of classes."""
    return classes.select(F.sort_array(F.collect_set(F.col("class_id").cast("int")))).scalar()


# Tasks over which rows without an allow-list are spread.
NULL_SALTS = 4096


def with_lists(photos: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of (photo_id, allowlist_id, ...) with ``listed``, null where there is no list or it is not known.

    A null key matches nothing but would be one hash, that is one task; a salt spreads such rows. The salt of a list is
    computed (always 0), as a literal would be taken out of the join's keys.
    """
    spread = F.when(F.col("allowlist_id").isNull(), F.pmod(F.xxhash64("photo_id"), F.lit(NULL_SALTS))).otherwise(F.lit(0).cast("long"))
    known = lists.select("allowlist_id", "listed", F.pmod(F.xxhash64("allowlist_id"), F.lit(1)).alias("_salt"))
    return photos.withColumn("_salt", spread).join(known, ["allowlist_id", "_salt"], "left").drop("_salt")


def photo_lists(photos: DataFrame, items: DataFrame, lists: DataFrame, unseen: DataFrame,
                fallback: bool = True) -> DataFrame:
    """(photo_id, allowlist_id, base, present) for every photo with items.

    A missing list falls back to the photo's own classes; an empty list stays empty.
    """
    labels = items.groupBy("photo_id").agg(F.collect_set("label").alias("labels"))
    joined = with_lists(photos.select("photo_id", "allowlist_id").join(labels, "photo_id"), lists)
    if fallback:
        own = F.filter("labels", lambda c: c != FOREIGN)
        joined = joined.withColumn("listed", F.coalesce("listed", own))
    else:
        joined = joined.filter(F.col("listed").isNotNull())
    base = F.sort_array(F.array_except("listed", class_array(unseen)))
    return joined.withColumn("base", base).select(
        "photo_id", "allowlist_id", "base",
        F.sort_array(F.array_intersect("labels", F.col("base"))).alias("present"))


def choose_k(values: Column, k: int, seed: int, *scope: Column | str) -> Column:
    """k elements of an array without replacement, by seeded hash; sorted."""
    ranked = F.sort_array(F.transform(values, lambda c: F.struct(seeded_hash(seed, *scope, F.lit(k), c).alias("h"),
                                                                 c.alias("c"))))
    return F.sort_array(F.transform(F.slice(ranked, 1, k), lambda s: s["c"]))


def nested_scenarios(base_lists: DataFrame, ks: tuple[int, ...] = (1, 2), seed: int = SEED,
                     include_clean: bool = True) -> DataFrame:
    """(photo_id, allowlist_id, base, variants): the scenarios of a photo in one row, (kind, removed) each.

    Joins carry this narrow row; ``unfolded`` tells ids and lists and ``spread_scenarios`` makes rows after the last of them.
    """
    n_present, n_base = F.size("present"), F.size("base")
    variants = []
    if include_clean:
        variants.append(F.struct(F.lit("clean").alias("kind"), F.array().cast("array<int>").alias("removed")))
    for k in ks:
        possible = n_present >= k
        if k > 1:
            possible = possible & ~((n_present == k) & (n_base == k))
        removed = choose_k(F.col("present"), k, seed, "photo_id")
        variants.append(F.when(possible, F.struct(F.lit(f"remove-{k}").alias("kind"), removed.alias("removed"))))
    possible = F.filter(F.array(*variants), lambda v: v.isNotNull())
    return base_lists.select("photo_id", "allowlist_id", "base", possible.alias("variants"))


def unfolded(variants: Column, base: Column) -> Column:
    """(scenario_id, kind, listed, removed) of every variant of a photo."""
    return F.transform(variants, lambda v: F.struct(*[c.alias(n) for n, c in _told(v, base).items()]))


def _told(v: Column, base: Column) -> dict[str, Column]:
    return {"scenario_id": F.concat(F.col("photo_id").cast("string"), F.lit("#"), v["kind"]), "kind": v["kind"],
            "listed": F.array_except(base, v["removed"]), "removed": v["removed"]}


def spread_scenarios(nested: DataFrame) -> DataFrame:
    """One row per scenario, next to the other columns."""
    others = [c for c in nested.columns if c not in ("base", "variants")]
    # Ids and lists are made after the rows are, so that whoever does not read them does not make them.
    spread = nested.select(*others, "base", F.explode("variants").alias("_v"))
    return spread.select(*others, *[c.alias(n) for n, c in _told(F.col("_v"), F.col("base")).items()])


def make_scenarios(base_lists: DataFrame, ks: tuple[int, ...] = (1, 2), seed: int = SEED,
                   include_clean: bool = True) -> DataFrame:
    """(scenario_id, kind, photo_id, allowlist_id, listed, removed)."""
    return spread_scenarios(nested_scenarios(base_lists, ks, seed, include_clean)).select(
        "scenario_id", "kind", "photo_id", "allowlist_id", "listed", "removed")


def reason(label: Column, listed: Column, removed: Column, unseen: Column) -> Column:
    return (
        F.when(label == FOREIGN, "foreign").when(F.array_contains(unseen, label), "unseen")
        .when(F.array_contains(removed, label), "removed").when(F.array_contains(listed, label), "listed")
        .otherwise("unlisted")
    )


def scenario_items(scenarios: DataFrame, items: DataFrame, unseen: DataFrame, keep: list[str]) -> DataFrame:
    """Truth and reason of every item in every scenario of its photo; scenarios come one per row or nested."""
    return judged_items(scenarios.join(items.select("photo_id", *keep), "photo_id"), unseen)


def judged_items(joined: DataFrame, unseen: DataFrame) -> DataFrame:
    """Truth and reason of items that have met their scenarios."""
    if "variants" in joined.columns:
        joined = spread_scenarios(joined)
    told = joined.withColumn("reason", reason(F.col("label"), F.col("listed"), F.col("removed"), class_array(unseen)))
    return told.withColumn("gt", F.when(F.col("reason") == "listed", "in").otherwise("out"))


def summary(scenarios: DataFrame, told: DataFrame) -> DataFrame:
    """Scenario counts by kind, item counts by truth and by reason."""
    kinds = scenarios.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("kind").alias("facet"), F.col("kind").alias("value"), "n")
    facets = told.groupBy("gt", "reason").agg(F.count(F.lit(1)).alias("n"))
    spread = facets.select(F.explode(F.array(
        F.struct(F.lit("gt").alias("facet"), F.col("gt").alias("value")),
        F.struct(F.lit("reason").alias("facet"), F.col("reason").alias("value")))).alias("f"), "n")
    return kinds.unionByName(spread.groupBy("f.facet", "f.value").agg(F.sum("n").alias("n")))


def out_counts(told: DataFrame) -> DataFrame:
    return told.groupBy("scenario_id").agg(count_where(F.col("gt") == "out").alias("n_out"))
