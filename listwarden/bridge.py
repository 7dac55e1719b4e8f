"""Domain views over the shared test tables: order = photo, customer = allow-list, line = item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import FOREIGN
from .operators.ordering import index_within
from .session import small_side

HELD_OUT = (8, 9)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings")


def items(spark: SparkSession, folder: str) -> DataFrame:
    vectors = embeddings(spark, folder)
    n_vectors = vectors.select(F.count(F.lit(1))).scalar()
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("photo_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice",
    )
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")]
    placed = index_within(lines, ["photo_id"], order, "item_idx")
    x1 = (F.col("l_partkey") * 13 + F.col("l_linenumber") * 97) % 1000
    y1 = (F.col("l_suppkey") * 29 + F.col("l_partkey")) % 700
    keyed = placed.withColumn(
        "vec_id", (F.col("l_partkey") * 31 + F.col("l_suppkey") * 7 + F.col("l_linenumber")) % n_vectors
    )
    return keyed.join(small_side(vectors.select("vec_id", F.col("label").alias("_label"))), "vec_id").select(
        "photo_id", "item_idx",
        F.concat_ws("_", F.col("photo_id").cast("string"), F.col("item_idx").cast("string")).alias("item_id"),
        "vec_id",
        F.when(F.col("l_suppkey") % 10 == 0, FOREIGN).otherwise(F.col("_label")).alias("label"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + 40 + 3 * F.col("l_quantity")).cast("double").alias("x2"),
        (y1 + 40 + F.col("l_partkey") % 50).cast("double").alias("y2"),
    )


def photos(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("photo_id"),
        F.when(F.col("o_custkey") % 17 != 0, F.col("o_custkey")).alias("allowlist_id"),
        F.lit(1280).alias("width"), F.lit(960).alias("height"),
    )


def allowlist_classes(spark: SparkSession, folder: str) -> DataFrame:
    """(allowlist_id, class_id) lines; the classes of a list are the ten fixed residues of its key."""
    known = embeddings(spark, folder).select(F.sort_array(F.collect_set("label"))).scalar()
    lists = table(spark, folder, "customer").select(F.col("c_custkey").alias("allowlist_id"))
    lines = lists.filter((F.col("allowlist_id") % 17 != 0) & (F.col("allowlist_id") % 23 != 0)).select(
        "allowlist_id", F.explode(known).alias("class_id")
    )
    return lines.filter((F.col("class_id") * 7 + F.col("allowlist_id") * 3) % 10 < 8)


def allowlists(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated lists, the ones that list nothing included."""
    return table(spark, folder, "customer").filter(F.col("c_custkey") % 17 != 0).select(
        F.col("c_custkey").alias("allowlist_id")
    )


def detections(spark: SparkSession, folder: str, source: DataFrame | None = None) -> DataFrame:
    """Misses, near duplicates (suffix d) and spurious boxes (suffix s), one pass over the items."""
    source = items(spark, folder) if source is None else source
    vec = F.col("vec_id")

    def shifted(name: Column, score: Column, dx: Column, dy: Column, present: Column) -> Column:
        return F.when(present, F.struct(
            name.alias("det_id"), score.alias("score"),
            (F.col("x1") + dx).alias("x1"), (F.col("y1") + dy).alias("y1"),
            (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"),
        ))

    variants = F.array(
        shifted(F.col("item_id"), 0.30 + (vec % 70) / 100.0, 2 * (vec % 5), vec % 3, vec % 13 != 0),
        shifted(F.concat("item_id", F.lit("d")), 0.28 + (vec % 70) / 200.0, F.lit(3), F.lit(3), vec % 4 == 0),
        shifted(F.concat("item_id", F.lit("s")), 0.26 + (vec % 50) / 100.0, F.lit(1300), F.lit(900), vec % 29 == 0),
    )
    return source.select("photo_id", "vec_id", F.explode(variants).alias("d")).filter(F.col("d").isNotNull()).select(
        "photo_id", "d.det_id", "vec_id", *[F.col(f"d.{c}").cast("double").alias(c)
                                            for c in ("score", "x1", "y1", "x2", "y2")]
    )


def catalogue_source(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", "p_name")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct names, numbered in name order."""
    names = catalogue_source(spark, folder).select(F.col("p_name").alias("name")).distinct()
    numbered = index_within(names.withColumn("_all", F.lit(0)), ["_all"], [F.col("name")], "class_id")
    return numbered.select("class_id", "name")


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    variant = (
        F.when(key % 4 == 0, name).when(key % 4 == 1, F.replace(name, F.lit("widget"), F.lit("wiget")))
        .when(key % 4 == 2, F.upper(name)).otherwise(F.concat(name, F.lit("500MG")))
    )
    return catalogue_source(spark, folder).select(
        key.alias("line_no"), F.concat((key % 9 + 1).cast("string"), F.lit(") "), variant).alias("text")
    )


def raw_photos(spark: SparkSession, folder: str) -> DataFrame:
    """Source annotation rows as they arrive: stored size, orientation and [x, y, w, h] boxes."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    width = (2001 + 2 * (key * 37 % 1050)).cast("int")
    height = (1501 + 2 * (key * 53 % 1150)).cast("int")

    def box(i: int) -> Column:
        return F.array(
            (key * (11 + i) + cust * 7) % 2100 - 20, (key * (5 + i) + cust * 3) % 1600 - 10,
            (key * 3 + cust + i) % 240, (key + cust * (2 + i)) % 180,
        ).cast("array<int>")

    return table(spark, folder, "orders").select(
        F.when(key % 3 == 0, F.concat(F.lit("cam/a."), key.cast("string"), F.lit(".JPG")))
        .when(key % 3 == 1, F.concat(F.lit("."), key.cast("string"), F.lit(".png")))
        .otherwise(F.concat(F.lit("scan/"), key.cast("string"))).alias("filename"),
        F.array(box(0), box(1), box(2)).alias("bboxes"),
        F.array(cust % 10, (cust + key) % 10, F.lit(FOREIGN)).cast("array<int>").alias("labels"),
        width.alias("width"), height.alias("height"),
        (key % 9).cast("int").alias("orientation"),
    )


def name_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Annotated text lines: one per part, mapped to a class, with list numbers and other line kinds."""
    key = F.col("p_partkey")
    return table(spark, folder, "part").select(
        F.concat(F.lit("list_"), (key % 97).cast("string")).alias("allowlist_id"),
        key.alias("line_no"),
        F.concat((key % 9 + 1).cast("string"), F.element_at(F.array(*map(F.lit, (") ", ". ", "- ", ": "))),
                 (key % 4 + 1).cast("int")), F.col("p_name")).alias("text"),
        F.when(key % 7 == 0, "date").otherwise("drugname").alias("line_kind"),
        F.when(key % 11 == 0, -1).when(key % 31 == 0, None)
        .otherwise((F.length("p_name") + F.col("p_size") % 3) % 12).cast("int").alias("class_id"),
    )


def subset_of_key(key: Column) -> Column:
    """A stored split for queries that only need one: every seventh photo is test, the next one val."""
    return F.when(key % 7 == 0, "test").when(key % 7 == 1, "val").otherwise("train")
