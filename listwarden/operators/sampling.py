"""Seeded samples that do not depend on row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash, unit_uniform
from ..session import stored
from .ordering import index_within, running_totals


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: the smallest seeded hashes, ordered by key."""
    picked = df.orderBy(seeded_hash(seed, key), key).limit(n)
    return picked.orderBy(key)


def class_weights(items: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight): every item of a class weighs 1 / sqrt(class size)."""
    return items.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("weight", 1.0 / F.sqrt("n"))


def weighted_draws(items: DataFrame, key: str, n: int, seed: int = 0, label: str = "label") -> DataFrame:
    """n draws with replacement, each item with weight 1 / sqrt(class size).

    A draw first finds its class by cumulative class weight, then a position inside the class. Classes are a distributed
    table of any length: their weights are summed up along the classes, and a draw meets the class whose stretch it falls
    into by a range join.
    """
    sizes = class_weights(items, label).select(label, "n", (F.col("n") * F.col("weight")).alias("_w"))
    edges = stored(running_totals(sizes, [F.col(label)], {"_to": F.col("_w")}).select(
        label, "n", (F.col("_to") - F.col("_w")).alias("_from"), "_to"))
    n_classes, total = edges.agg(F.count(F.lit(1)), F.max("_to")).first()
    draws = items.sparkSession.range(n if n_classes else 0).select(
        F.col("id").alias("draw"),
        (unit_uniform(seeded_hash(seed, F.lit("class"), F.col("id"))) * F.lit(total or 0.0)).alias("_u"),
        unit_uniform(seeded_hash(seed, F.lit("place"), F.col("id"))).alias("_v"))
    placed = in_stretch(draws, "_u", edges, "_from", "_to", (total or 1.0) / max(1, n_classes))
    wanted = placed.select("draw", label, F.floor(F.col("_v") * F.col("n")).cast("long").alias("_place"))
    indexed = index_within(items.select(label, key), [label], [F.col(key)], "_place", "long")
    return wanted.join(indexed, [label, "_place"]).select("draw", key, label)


def in_stretch(points: DataFrame, at: str, stretches: DataFrame, low: str, high: str, cell: float) -> DataFrame:
    """Points with the stretch [low, high) they lie in, matched on cells of one width that a stretch covers.

    With cells as wide as a stretch is on average there are at most two cell rows per stretch, however uneven they are.
    """
    covered = F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))
    spread = stretches.withColumn("_cell", F.explode(covered))
    on = points.withColumn("_cell", F.floor(F.col(at) / cell))
    return on.join(spread, "_cell").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def class_index(classes: DataFrame) -> DataFrame:
    """(class_id, idx): position among the sorted class ids."""
    return index_within(classes.select("class_id").distinct().withColumn("_all", F.lit(0)), ["_all"],
                        [F.col("class_id")], "idx").select("class_id", "idx")


def indexed_labels(items: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``idx``; -1 for a class outside the list."""
    index = class_index(classes).select(F.col("class_id").alias(label), "idx")
    return items.join(index, label, "left").withColumn("idx", F.coalesce("idx", F.lit(-1)))
