"""The domain frames of one data folder, built on demand."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden import bridge
from listwarden.constants import Params
from listwarden.operators import calibration, prototypes, scenarios, split
from listwarden.plans import check, evaluate
from listwarden.session import durable, small_side, stored

PARAMS = Params(temperature=0.08, unknown_bias=0.3, theta_in=0.8, theta_out=0.3, margin=0.0, platt_a=0.9, platt_b=0.5)


class World:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @cached_property
    def items(self) -> DataFrame:
        return bridge.items(self.spark, self.folder)

    @cached_property
    def photos(self) -> DataFrame:
        return bridge.photos(self.spark, self.folder)

    @cached_property
    def vectors(self) -> DataFrame:
        return bridge.embeddings(self.spark, self.folder)

    @cached_property
    def detections(self) -> DataFrame:
        return bridge.detections(self.spark, self.folder, self.items)

    @cached_property
    def held_out(self) -> DataFrame:
        return self.vectors.select(F.col("label").alias("class_id")).distinct().filter(
            F.col("class_id").isin(*bridge.HELD_OUT))

    @cached_property
    def lists(self) -> DataFrame:
        lines = bridge.allowlist_classes(self.spark, self.folder)
        found = lines.groupBy("allowlist_id").agg(F.sort_array(F.collect_set("class_id")).alias("listed"))
        every = bridge.allowlists(self.spark, self.folder)
        return every.join(found, "allowlist_id", "left").select(
            "allowlist_id", F.coalesce("listed", F.array().cast("array<int>")).alias("listed"))

    @cached_property
    def base_lists(self) -> DataFrame:
        return scenarios.photo_lists(self.photos, self.items, self.lists, self.held_out)

    @cached_property
    def nested(self) -> DataFrame:
        """The scenarios of a photo in one row."""
        return scenarios.nested_scenarios(self.base_lists)

    @cached_property
    def scenarios(self) -> DataFrame:
        return scenarios.make_scenarios(self.base_lists)

    @cached_property
    def told(self) -> DataFrame:
        return scenarios.scenario_items(self.nested, self.items, self.held_out,
                                        ["item_idx", "item_id", "vec_id", "label"])

    @cached_property
    def split(self) -> DataFrame:
        return split.make_split(self.photos)

    @cached_property
    def class_means(self) -> DataFrame:
        return prototypes.class_means(self.vectors)

    @cached_property
    def prototypes(self) -> DataFrame:
        seen = self.vectors.join(self.held_out, self.vectors["label"] == self.held_out["class_id"], "left_anti")
        return durable(prototypes.class_means(seen).select("class_id", F.lit(0).alias("proto_no"), "vector"))

    def embedded(self, df: DataFrame) -> DataFrame:
        return df.join(small_side(self.vectors.select("vec_id", "embedding")), "vec_id")

    @cached_property
    def records(self) -> DataFrame:
        """True boxes as detections, with a fixed share of them missed; without scores and boxes of detections."""
        return self._records(())

    @cached_property
    def boxed_records(self) -> DataFrame:
        """``records`` with all that is told of a detection."""
        return self._records(tuple(evaluate.DETECTION_COLUMNS))

    def _records(self, told: tuple[str, ...]) -> DataFrame:
        self.keep_items(*(() if told else ("photo_id", "item_idx", "item_id", "vec_id", "label")))
        found = self.items.filter(F.col("vec_id") % 13 != 0)
        return evaluate.build_records(self.items, evaluate.identity_matches(found), evaluate.item_detections(found),
                                      self.nested, self.held_out, self.vectors, self.prototypes, PARAMS, told)

    def keep_items(self, *columns: str) -> None:
        """Write the items, or these columns of them, once for what reads them several times."""
        if "kept" not in self.__dict__:
            self.items = self.kept = stored(self.items.select(*columns or ["*"]))

    @cached_property
    def evaluated(self) -> tuple[DataFrame, DataFrame]:
        """(records, spurious) with detections matched to items by overlap."""
        return self.evaluated_telling(*evaluate.DETECTION_COLUMNS)

    @cached_property
    def judged(self) -> tuple[DataFrame, DataFrame]:
        """``evaluated`` for what reads neither scores nor boxes of detections."""
        return self.evaluated_telling()

    def evaluated_telling(self, *told: str) -> tuple[DataFrame, DataFrame]:
        """``evaluated`` with these columns of detections only."""
        self.keep_items()
        return evaluate.evaluate(self.items, self.detections, self.nested, self.held_out, self.vectors,
                                 self.prototypes, PARAMS, told)

    @cached_property
    def calibration(self) -> DataFrame:
        return calibration.calibration_set((self.items, self.nested, self.held_out), self.vectors, self.prototypes, "vec_id")

    @cached_property
    def calibrated(self) -> DataFrame:
        """Calibration rows with the raw and the final probability and a total source order."""
        scored = calibration.calibration_probabilities(
            (self.items, self.nested, self.held_out), self.vectors, self.prototypes, "vec_id",
            {"p_raw": PARAMS.with_(platt_a=1.0, platt_b=0.0), "p_in": PARAMS})
        return scored.withColumn(
            "ord", F.concat_ws("/", "scenario_id", F.lpad(F.col("item_idx").cast("string"), 9, "0")))

    @cached_property
    def own_list(self) -> DataFrame:
        """(photo_id, listed) of the photo's allow-list as written."""
        return scenarios.with_lists(self.photos, self.lists).select("photo_id", "allowlist_id", "listed")

    @cached_property
    def own_decisions(self) -> DataFrame:
        return check.decide_items(self.embedded(self.items), check.one_list(self.own_list), self.prototypes, PARAMS,
                                  ["photo_id", "item_idx"])
