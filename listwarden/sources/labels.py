"""Training labels of a detector: one text line per box, one path list per subset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import stem
from ..functions.numbers import half_even


def label_lines(items: DataFrame, photos: DataFrame) -> DataFrame:
    """(photo_id, item_idx, line) with normalised centre boxes; boxes without area have no line.

    A photo without lines keeps one row with an empty line and no index, the empty file it becomes.
    """
    joined = items.join(photos.select("photo_id", "width", "height"), "photo_id")
    w, h = (F.col("x2") - F.col("x1")) / F.col("width"), (F.col("y2") - F.col("y1")) / F.col("height")
    cx = (F.col("x1") + F.col("x2")) / 2 / F.col("width")
    cy = (F.col("y1") + F.col("y2")) / 2 / F.col("height")
    parts = [half_even(value, 6) for value in (cx, cy, w, h)]
    lines = joined.filter((w > 0) & (h > 0)).select(
        "photo_id", "item_idx", F.format_string("0 %.6f %.6f %.6f %.6f", *parts).alias("line"))
    return photos.select("photo_id").join(lines, "photo_id", "left").select(
        "photo_id", "item_idx", F.coalesce("line", F.lit("")).alias("line"))


def write_labels(lines: DataFrame, split: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """(photo_id, item_idx, line) under one folder per subset, in order of photo and item; photos without one are train.

    The number of files follows the data, not the number of photos.
    """
    subsets = split.select("photo_id", "subset").dropDuplicates(["photo_id"])
    rows = lines.join(subsets, "photo_id", "left").fillna("train", ["subset"])
    order = ["subset", "photo_id", "item_idx"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("subset").parquet(path)


def write_label_files(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """For small exports: text files under one folder per photo, lines in item order.

    Rows are ranged by (photo, index), so the lines of a photo of any size stay in order over its files.
    """
    ranged = lines.repartitionByRange("photo_id", "item_idx").sortWithinPartitions("photo_id", "item_idx")
    ranged.select("photo_id", F.col("line").alias("value")).write.mode(mode).partitionBy("photo_id").text(path)


def path_lists(split: DataFrame, root: str) -> DataFrame:
    """(subset, value): image paths of every subset."""
    name = F.concat(stem(F.col("photo_id").cast("string")), F.lit(".jpg"))
    return split.select("subset", F.concat(F.lit(f"{root}/images/"), name).alias("value"))


def write_path_lists(paths: DataFrame, path: str, mode: str = "errorifexists") -> None:
    ranged = paths.repartitionByRange("subset", "value").sortWithinPartitions("subset", "value")
    ranged.write.mode(mode).partitionBy("subset").text(path)
