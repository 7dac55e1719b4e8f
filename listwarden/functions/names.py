"""File, item and class naming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a list number such as "3) " or "12. " in front of a name.
LIST_NUMBER = r"^\s*\d+\s*[\)\.\-:]\s*"


def stem(path: Column) -> Column:
    """Base name without its last suffix; a leading dot belongs to the name."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def jpg_name(path: Column) -> Column:
    return F.concat(stem(path), F.lit(".jpg"))


def item_id(photo: Column, index: Column) -> Column:
    return F.concat_ws("_", stem(photo.cast("string")), index.cast("string"))


def strip_list_number(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, LIST_NUMBER, ""), r"^\s+|\s+$", "")


def class_label(name: Column, class_id: Column, prefix: str = "class_") -> Column:
    return F.coalesce(name, F.concat(F.lit(prefix), class_id.cast("string")))
