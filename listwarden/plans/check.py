"""Check every item of every photo against the photo's allow-list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import Params
from ..operators.metrics import banners
from ..operators.scenarios import unfolded
from ..operators.similarity import judge
from ..session import small_side


def one_list(photo_lists: DataFrame) -> DataFrame:
    """(photo_id, lists) with the photo's own list; a photo without one lists nothing."""
    listed = F.coalesce("listed", F.array().cast("array<int>"))
    entry = F.struct(F.col("photo_id").cast("string").alias("list_id"), listed.alias("listed"))
    return photo_lists.select("photo_id", F.array(entry).alias("lists"))


def scenario_lists(scenarios: DataFrame) -> DataFrame:
    """(photo_id, lists): a photo has one scenario per kind, so the array stays short."""
    entry = F.struct(F.col("scenario_id").alias("list_id"), "listed")
    return scenarios.groupBy("photo_id").agg(F.sort_array(F.collect_list(entry)).alias("lists"))


def decide_items(items: DataFrame, lists: DataFrame, prototypes: DataFrame, params: Params,
                 keep: list[str], vectors: DataFrame | None = None) -> DataFrame:
    """Decisions per item and list; ``items`` carries photo_id and embedding, or vec_id where ``vectors`` has the embedding.

    Vectors that are looked up meet the items last, so that the join by photo does not carry them; if they are few enough to
    be sent to every task, the items with their lists are not shuffled again. Lists may come as nested scenarios, which are
    unfolded after the joins.
    """
    checked = items.join(lists, "photo_id")
    if vectors is not None:
        checked = checked.join(small_side(vectors.select("vec_id", "embedding")), "vec_id")
    if "variants" in lists.columns:
        checked = checked.withColumn("lists", F.transform(unfolded(F.col("variants"), F.col("base")), lambda v: F.struct(
            v["scenario_id"].alias("list_id"), v["listed"].alias("listed"))))
    return judge(checked, prototypes, params, keep)


def check_photos(items: DataFrame, photo_lists: DataFrame, prototypes: DataFrame, params: Params) -> DataFrame:
    """The banner of every photo."""
    decisions = decide_items(items, one_list(photo_lists), prototypes, params, ["photo_id", "item_idx"])
    return banners(decisions, photo_lists)
