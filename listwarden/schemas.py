"""Declared schemas of the stored tables, as DDL."""

from __future__ import annotations

from pyspark.sql.types import StructType

RAW_PHOTOS = (
    "filename STRING, bboxes ARRAY<ARRAY<INT>>, labels ARRAY<INT>, width INT, height INT, orientation INT"
)
RAW_ALLOWLISTS = (
    "filename STRING, ann_ids ARRAY<INT>, texts ARRAY<STRING>, ann_labels ARRAY<STRING>, "
    "boxes ARRAY<ARRAY<INT>>, mappings ARRAY<INT>, width INT, height INT, orientation INT"
)
PHOTOS = (
    "file STRING, orig_file STRING, src_split STRING, width INT, height INT, orig_size ARRAY<INT>, "
    "exif_orientation INT, boxes ARRAY<ARRAY<DOUBLE>>, labels ARRAY<INT>, n_dropped_boxes INT"
)
ALLOWLISTS = (
    "file STRING, orig_file STRING, src_split STRING, width INT, height INT, orig_size ARRAY<INT>, "
    "exif_orientation INT, scale DOUBLE, ann_ids ARRAY<INT>, texts ARRAY<STRING>, ann_labels ARRAY<STRING>, "
    "boxes_raw ARRAY<ARRAY<INT>>, mappings ARRAY<INT>"
)
PHOTO_ALLOWLIST = "allowlist_id STRING, photo_id STRING, ord LONG"
CROPS = (
    "item_id STRING, photo_id STRING, item_idx INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, "
    "label INT, subset STRING"
)
CLASSES = "class_id INT, name STRING, n_boxes LONG, n_images LONG"
ALIASES = "class_id INT, alias_no INT, alias STRING, votes LONG"
SCENARIOS = (
    "scenario_id STRING, kind STRING, photo_id STRING, allowlist_id STRING, listed ARRAY<INT>, removed ARRAY<INT>"
)
SCENARIO_ITEMS = "scenario_id STRING, item_idx INT, label INT, gt STRING, reason STRING"
PROTOTYPES = "class_id INT, proto_no INT, vector ARRAY<DOUBLE>"
PARAMS = (
    "temperature DOUBLE, unknown_bias DOUBLE, theta_in DOUBLE, theta_out DOUBLE, margin DOUBLE, "
    "platt_a DOUBLE, platt_b DOUBLE"
)


def struct(ddl: str) -> StructType:
    """The typed form; needs a running session."""
    return StructType.fromDDL(ddl)
