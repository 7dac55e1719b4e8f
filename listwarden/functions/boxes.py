"""Box geometry as column arithmetic. A box is a struct or four columns x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CROP_CONTEXT, DETECTOR_INPUT, MIN_BOX_SIDE
from .numbers import half_even, half_up


def displayed_size(width: Column, height: Column, orientation: Column) -> tuple[Column, Column]:
    turned = F.coalesce(orientation, F.lit(1)).isin(5, 6, 7, 8)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def shrink_factor(width: Column, height: Column, max_side: int) -> Column:
    return F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height).cast("double"))


def shrunk_side(side: Column, factor: Column) -> Column:
    return F.greatest(F.lit(1), half_even(side * factor).cast("int"))


def scaled_corners(boxes: Column, factor: Column, width: Column, height: Column) -> Column:
    """[x, y, w, h] integer boxes -> clipped corner boxes with one decimal."""

    def clip(value: Column, upper: Column) -> Column:
        return half_even(F.greatest(F.lit(0.0), F.least(upper.cast("double"), value)), 1)

    return F.transform(boxes, lambda b: F.struct(
        clip(b[0] * factor, width).alias("x1"),
        clip(b[1] * factor, height).alias("y1"),
        clip((b[0] + b[2]) * factor, width).alias("x2"),
        clip((b[1] + b[3]) * factor, height).alias("y2"),
    ))


def large_enough(box: Column) -> Column:
    return ((box["x2"] - box["x1"]) >= MIN_BOX_SIDE) & ((box["y2"] - box["y1"]) >= MIN_BOX_SIDE)


def square_context(x1: Column, y1: Column, x2: Column, y2: Column, context: float = CROP_CONTEXT) -> Column:
    side = F.greatest(F.lit(1.0), x2 - x1, y2 - y1) * F.lit(1 + 2 * context)
    left = F.floor((x1 + x2) / 2 - side / 2).cast("int")
    top = F.floor((y1 + y2) / 2 - side / 2).cast("int")
    length = F.ceil(side).cast("int")
    return F.struct(left.alias("x1"), top.alias("y1"), (left + length).alias("x2"), (top + length).alias("y2"))


def letterbox(width: Column, height: Column, size: int = DETECTOR_INPUT) -> Column:
    factor = F.least(F.lit(float(size)) / height, F.lit(float(size)) / width)
    new_w = F.greatest(F.lit(1), half_up(width * factor)).cast("int")
    new_h = F.greatest(F.lit(1), half_up(height * factor)).cast("int")
    return F.struct(
        factor.alias("scale"), new_w.alias("new_w"), new_h.alias("new_h"),
        F.floor((F.lit(size) - new_w) / 2).cast("int").alias("pad_x"),
        F.floor((F.lit(size) - new_h) / 2).cast("int").alias("pad_y"),
    )


def undo_letterbox(value: Column, pad: Column, scale: Column, upper: Column) -> Column:
    return F.least(F.greatest((value - pad) / scale, F.lit(0.0)), upper.cast("double"))


def overlap(a: Column, b: Column) -> Column:
    dx = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    dy = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return dx * dy


def area(box: Column, clamp: bool = False) -> Column:
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    if clamp:
        w, h = F.greatest(F.lit(0.0), w), F.greatest(F.lit(0.0), h)
    return w * h


def iou(a: Column, b: Column, clamp: bool = False) -> Column:
    """Intersection over union; suppression clamps negative areas, matching does not."""
    shared = overlap(a, b)
    return shared / (area(a, clamp) + area(b, clamp) - shared + F.lit(1e-9))


def box_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
