"""Dataset profile and histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FOREIGN
from ..functions.numbers import count_where
from ..session import durable
from .ordering import exact_quantiles

UNIT_BINS_FROM = 1


def relative_widths(items: DataFrame, photos: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    joined = items.join(photos.select("photo_id", "width"), "photo_id")
    return joined.select(*keep, ((F.col("x2") - F.col("x1")) / F.col("width")).alias("rel_width"))


def items_per_photo(items: DataFrame) -> DataFrame:
    return items.groupBy("photo_id").agg(F.count(F.lit(1)).alias("n"),
                                         count_where(F.col("label") == FOREIGN).alias("n_foreign"))


def items_per_class(items: DataFrame, classes: DataFrame) -> DataFrame:
    counts = items.groupBy(F.col("label").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return classes.select("class_id").join(counts, "class_id", "left").fillna(0, ["n"])


def profile(items: DataFrame, photos: DataFrame, classes: DataFrame, lists: DataFrame) -> DataFrame:
    """(metric, value) rows. ``lists`` is (allowlist_id, listed); ``classes`` may hold classes without items."""
    # Counts per photo and per class feed several parts each.
    per_photo = durable(items_per_photo(items))
    per_class = durable(items_per_class(items, classes))
    with_items = photos.join(per_photo.select("photo_id"), "photo_id", "left_semi")
    per_list = with_items.filter(F.col("allowlist_id").isNotNull()).groupBy("allowlist_id").agg(
        F.count(F.lit(1)).alias("n"))
    sizes = lists.select(F.size("listed").alias("n"))
    parts = [
        per_photo.agg(F.count(F.lit(1)).alias("n_photos"), F.sum("n").alias("n_items"),
                      F.sum("n_foreign").alias("n_foreign_items"),
                      count_where(F.col("n_foreign") > 0).alias("n_photos_with_foreign"),
                      F.avg("n").alias("items_per_photo_mean"), F.max("n").alias("items_per_photo_max")),
        exact_quantiles(per_photo, "n", {"items_per_photo_median": 0.5}),
        per_class.agg(F.count(F.lit(1)).alias("n_classes"), F.min("n").alias("items_per_class_min"),
                      F.max("n").alias("items_per_class_max")),
        exact_quantiles(per_class, "n", {"items_per_class_p25": 0.25, "items_per_class_median": 0.5}),
        exact_quantiles(relative_widths(items, photos), "rel_width",
                        {"rel_width_p5": 0.05, "rel_width_median": 0.5, "rel_width_p95": 0.95}),
        sizes.agg(F.count(F.lit(1)).alias("n_lists"), F.avg("n").alias("classes_per_list_mean"),
                  F.max("n").alias("classes_per_list_max")),
        per_list.agg(F.avg("n").alias("photos_per_list_mean"), F.max("n").alias("photos_per_list_max")),
    ]
    rows = [
        part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                        for c in part.columns])).alias("m")).select("m.metric", "m.value")
        for part in parts
    ]
    return reduce(DataFrame.unionByName, rows)


def rare_classes(items: DataFrame, classes: DataFrame, fewer_than: int = 20) -> DataFrame:
    return items_per_class(items, classes).filter(F.col("n") < fewer_than)


def common_sizes(photos: DataFrame, top: int = 3) -> DataFrame:
    size = F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string"))
    return photos.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(top)


def unit_histogram(values: DataFrame, column: str) -> DataFrame:
    """Counts per whole number from 1 up."""
    return values.filter(F.col(column) >= UNIT_BINS_FROM).groupBy(F.col(column).cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))


def equal_histogram(values: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Counts over equal bins from the smallest to the largest value; the last bin is closed."""
    bounds = values.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi")).alias("b")).select("b").scalar()
    placed = values.select(F.col(column).alias("v"), bounds.alias("b"))
    step = (F.col("b.hi") - F.col("b.lo")) / bins
    guess = F.when(step > 0, F.least(F.floor((F.col("v") - F.col("b.lo")) / step), F.lit(bins - 1))).otherwise(0)
    guessed = placed.select("v", "b", step.alias("step"), guess.cast("int").alias("g"))
    edge = lambda i: F.col("b.lo") + i * F.col("step")                                 # noqa: E731
    index = (F.when(F.col("v") < edge(F.col("g")), F.col("g") - 1)
             .when((F.col("g") < bins - 1) & (F.col("v") >= edge(F.col("g") + 1)) & (F.col("step") > 0), F.col("g") + 1)
             .otherwise(F.col("g")))
    counted = guessed.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counted, "bin", "left").fillna(0, ["n"])
