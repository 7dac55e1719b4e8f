"""Class catalogue: names by vote, aliases, item counts, and what each allow-list contains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import FOREIGN
from ..functions.names import class_label, strip_list_number
from ..functions.numbers import count_where
from .ordering import index_within


def explode_lines(allowlists: DataFrame) -> DataFrame:
    """(allowlist_id, line_no, text, line_kind, class_id) from the parallel annotation arrays."""
    even = (F.size("texts") == F.size("ann_labels")) & (F.size("texts") == F.size("mappings"))
    zipped = F.when(even, F.arrays_zip("texts", "ann_labels", "mappings")).otherwise(
        F.raise_error(F.lit("texts, ann_labels and mappings differ in length")))
    return allowlists.select(F.col("file").alias("allowlist_id"), F.posexplode(zipped).alias("line_no", "_l")).select(
        "allowlist_id", "line_no", F.col("_l.texts").alias("text"), F.col("_l.ann_labels").alias("line_kind"),
        F.col("_l.mappings").alias("class_id"),
    )


def name_lines(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("line_kind") == "drugname") & (F.col("class_id") >= 0))


def name_votes(lines: DataFrame, order: list[str]) -> DataFrame:
    """Votes per (class, cleaned name) and the first place the name was seen."""
    cleaned = name_lines(lines).select("class_id", strip_list_number(F.col("text")).alias("name"), *order)
    return cleaned.groupBy("class_id", "name").agg(
        F.count(F.lit(1)).alias("votes"),
        F.min(F.struct(*order) if len(order) > 1 else F.col(order[0])).alias("first_seen"),
    )


def class_names(votes: DataFrame) -> DataFrame:
    """Most common name per class; the earliest seen wins a tie. No group is collected."""
    top = votes.groupBy("class_id").agg(F.max("votes").alias("votes"))
    return votes.join(top, ["class_id", "votes"]).groupBy("class_id").agg(
        F.min_by("name", "first_seen").alias("name"), F.max("votes").alias("votes"))


def class_aliases(votes: DataFrame) -> DataFrame:
    """Names after the winner, one row each, ranked by votes and then by first sight."""
    ranked = index_within(votes, ["class_id"], [F.desc("votes"), F.col("first_seen")], "alias_no")
    return ranked.filter("alias_no > 0").select("class_id", "alias_no", F.col("name").alias("alias"), "votes")


def listed_classes(lines: DataFrame, lists: DataFrame) -> DataFrame:
    """Sorted distinct classes per allow-list; a list without name lines is empty, not missing."""
    found = name_lines(lines).groupBy("allowlist_id").agg(F.sort_array(F.collect_set("class_id")).alias("listed"))
    empty = F.array().cast("array<int>")
    return lists.select("allowlist_id").distinct().join(found, "allowlist_id", "left").select(
        "allowlist_id", F.coalesce("listed", empty).alias("listed"))


def class_table(names: DataFrame, items: DataFrame) -> DataFrame:
    """One row per named or labelled class, the foreign sentinel apart."""
    counts = (
        items.groupBy(F.col("label").alias("class_id"), "photo_id").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("class_id").agg(F.sum("n").alias("n_boxes"), F.count(F.lit(1)).alias("n_images"))
    )
    joined = names.select("class_id", "name").join(counts, "class_id", "full")
    zero = F.lit(0).cast("long")
    return joined.filter((F.col("class_id") != FOREIGN) | F.col("name").isNotNull()).select(
        "class_id", class_label(F.col("name"), F.col("class_id")).alias("name"),
        F.coalesce("n_boxes", zero).alias("n_boxes"), F.coalesce("n_images", zero).alias("n_images"))


def foreign_items(items: DataFrame) -> DataFrame:
    return items.agg(count_where(F.col("label") == FOREIGN).alias("n_foreign"))


def class_universe(names: DataFrame, items: DataFrame) -> DataFrame:
    labelled = items.filter(F.col("label") != FOREIGN).select(F.col("label").alias("class_id"))
    return names.select("class_id").union(labelled).distinct()


def export_catalogue(prototypes: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Classes that have a prototype, with their name and aliases, one row per alias (null when none)."""
    seen = prototypes.select("class_id").distinct()
    named = seen.join(names.select("class_id", "name"), "class_id", "left")
    return named.join(aliases.select("class_id", "alias_no", "alias"), "class_id", "left").select(
        "class_id", class_label(F.col("name"), F.col("class_id")).alias("name"), "alias_no", "alias")


def seen_lists(lists: DataFrame, seen: DataFrame) -> DataFrame:
    """(allowlist_id, classes): of every list the classes that have a prototype, sorted as ``listed`` is stored."""
    known = seen.select(F.sort_array(F.collect_set("class_id"))).scalar()
    return lists.select("allowlist_id", F.array_intersect("listed", known).alias("classes"))


def sample_lists(lists: DataFrame, photo_split: DataFrame, seen: DataFrame, n: int = 24,
                 subset: str = "test", at_least: int = 2) -> DataFrame:
    """The first lists of a subset that name at least two seen classes.

    Sorted, duplicates kept out by the stored form of ``listed``.
    """
    used = photo_split.filter(F.col("subset") == subset).select("allowlist_id").distinct()
    kept = seen_lists(lists.join(used, "allowlist_id", "left_semi"), seen)
    return kept.filter(F.size("classes") >= at_least).orderBy("allowlist_id").limit(n)


def map_pairs(pairs: DataFrame) -> DataFrame:
    """Photos of each allow-list, de-duplicated; rows, because a list may own any number of photos."""
    return pairs.select("allowlist_id", "photo_id").distinct()


def photo_list(pairs: DataFrame) -> DataFrame:
    """Allow-list of each photo; the last mapping wins."""
    return pairs.groupBy("photo_id").agg(F.max_by("allowlist_id", "ord").alias("allowlist_id"))
