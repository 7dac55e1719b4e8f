"""Leakage-free grouped split and the classes a model cannot have seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FOREIGN, HELD_OUT_CLASSES, SEED, TEST_FRACTION, VAL_FRACTION
from ..functions.hashing import seeded_hash
from .ordering import running_totals


def group_key(photo: str = "photo_id", allowlist: str = "allowlist_id") -> Column:
    """Photos of one allow-list stay together; a photo without one is its own group."""
    return F.coalesce(F.col(allowlist).cast("string"), F.concat(F.lit("__solo__"), F.col(photo).cast("string")))


def split_groups(photos: DataFrame, seed: int = SEED, val_fraction: float = VAL_FRACTION,
                 test_fraction: float = TEST_FRACTION) -> DataFrame:
    """(grp, n, subset): hash-ordered groups fill test, then val; the rest is train."""
    sizes = photos.groupBy(group_key().alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(sizes.withColumn("_h", seeded_hash(seed, "grp")), [F.col("_h"), F.col("grp")],
                            {"_upto": F.col("n")})
    total = photos.count()
    n_test, n_val = round(test_fraction * total), round(val_fraction * total)
    before = F.col("_upto") - F.col("n")
    test_end = F.coalesce(placed.filter(before < n_test).select(F.max("_upto")).scalar(), F.lit(0))
    subset = F.when(before < n_test, "test").when(before - test_end < n_val, "val").otherwise("train")
    return placed.select("grp", "n", subset.alias("subset"))


def make_split(photos: DataFrame, seed: int = SEED, **fractions) -> DataFrame:
    groups = split_groups(photos, seed, **fractions).select("grp", "subset")
    return photos.withColumn("grp", group_key()).join(groups, "grp").select("photo_id", "allowlist_id", "subset")


def subset_photos(items: DataFrame, split: DataFrame, subset: str) -> DataFrame:
    """Photos of a subset that have items."""
    wanted = split.filter(F.col("subset") == subset).select("photo_id")
    return items.select("photo_id").join(wanted, "photo_id", "left_semi").distinct()


def untrained_classes(items: DataFrame, split: DataFrame, held_out: DataFrame) -> DataFrame:
    """Classes of val or test photos that no train photo shows and nobody held out."""
    seen = items.select("photo_id", F.col("label").alias("class_id")).join(
        split.select("photo_id", "subset"), "photo_id").filter(F.col("class_id") != FOREIGN)
    flags = seen.groupBy("class_id").agg(F.bool_or(F.col("subset") == "train").alias("_trained"))
    return flags.filter(~F.col("_trained")).select("class_id").join(held_out, "class_id", "left_anti")


def unseen_classes(items: DataFrame, split: DataFrame, held_out: DataFrame) -> DataFrame:
    return held_out.select("class_id").union(untrained_classes(items, split, held_out)).distinct()


def choose_held_out(items: DataFrame, n: int = HELD_OUT_CLASSES, seed: int = SEED) -> DataFrame:
    """n classes of middle frequency (photos per class between the quartiles), picked by hash rank."""
    counts = (
        items.filter(F.col("label") != FOREIGN).select(F.col("label").alias("class_id"), "photo_id").distinct()
        .groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    )
    quartiles = counts.agg(F.percentile("n", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    bounds = quartiles.select("q").scalar()
    middle = F.col("n").between(F.element_at(bounds, 1), F.element_at(bounds, 2))
    flagged = counts.withColumn("_mid", middle)
    any_middle = flagged.select(F.bool_or("_mid")).scalar()
    pool = flagged.filter(F.col("_mid") | ~any_middle)
    return pool.orderBy(seeded_hash(seed, "class_id"), "class_id").limit(n).select("class_id")


def split_summary(items: DataFrame, split: DataFrame) -> DataFrame:
    """Photos, items and distinct allow-lists per subset; no allow-list counts as one value."""
    sizes = items.groupBy("photo_id").agg(F.count(F.lit(1)).alias("n"))
    key = F.coalesce(F.col("allowlist_id").cast("string"), F.lit("<null>"))
    return split.join(sizes, "photo_id", "left").groupBy("subset").agg(
        F.count(F.lit(1)).alias("n_photos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"),
        F.countDistinct(key).alias("n_lists"))


def straddling_groups(split: DataFrame) -> DataFrame:
    """Groups present in more than one subset; empty for a sound split."""
    return split.groupBy(group_key().alias("grp")).agg(F.countDistinct("subset").alias("n_subsets")).filter(
        "n_subsets > 1")
