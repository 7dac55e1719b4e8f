"""Source annotations to the photo, item and allow-list tables. Image bytes are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import ALLOWLIST_MAX_SIDE, PHOTO_MAX_SIDE
from ..functions.boxes import displayed_size, large_enough, scaled_corners, shrink_factor, shrunk_side
from ..functions.names import jpg_name
from ..operators.ordering import running_totals
from ..schemas import ALLOWLISTS, struct


def read_shards(spark: SparkSession, folder: str, split: str, schema: StructType | str,
                first: int | None = None, pattern: str = "{split}-*.parquet") -> DataFrame:
    """Shards of a split by file name; ``first`` keeps the first n in name order."""
    glob = pattern.format(split=split)
    if first is None:
        return spark.read.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    found = sorted(matching_paths(spark, f"{folder}/{glob}"), key=lambda path: path.rsplit("/", 1)[1])[:first]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def matching_paths(spark: SparkSession, glob: str) -> list[str]:
    """Paths that match, from a listing of the file system; no file is opened."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(glob)
    files = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
    return [f.getPath().toString() for f in files] if files is not None else []


def _sized(raw: DataFrame, max_side: int) -> DataFrame:
    # A missing or zero orientation tag means upright.
    tag = F.coalesce(F.nullif(F.col("orientation"), F.lit(0)), F.lit(1))
    width, height = displayed_size(F.col("width"), F.col("height"), tag)
    shown = raw.withColumns({"exif_orientation": tag, "_ow": width, "_oh": height})
    factor = shrink_factor(F.col("_ow"), F.col("_oh"), max_side)
    return shown.withColumn("scale", factor).withColumns({
        "_w": shrunk_side(F.col("_ow"), F.col("scale")), "_h": shrunk_side(F.col("_oh"), F.col("scale"))})


def same_length(arrays: Column, first: str, second: str) -> Column:
    """``arrays``, or an error if the two columns differ in length: no pair is made up and none is lost."""
    sizes = F.coalesce(F.size(first), F.lit(0)) == F.coalesce(F.size(second), F.lit(0))
    return F.when(sizes, arrays).otherwise(F.raise_error(F.lit(f"{first} and {second} differ in length")))


def photo_rows(raw: DataFrame, split: str) -> DataFrame:
    """Photo annotations in the saved frame; boxes under two pixels leave with their labels."""
    sized = _sized(raw, PHOTO_MAX_SIDE)
    none = F.array()
    corners = scaled_corners(F.coalesce("bboxes", none.cast("array<array<int>>")), F.col("scale"), F.col("_w"),
                             F.col("_h"))
    paired = sized.withColumn("_boxes", corners).withColumn("_labels", F.coalesce("labels", none.cast("array<int>")))
    paired = paired.withColumn("_pairs", same_length(F.zip_with(
        "_boxes", "_labels", lambda box, label: F.struct(box.alias("box"), label.alias("label"))), "_boxes", "_labels"))
    kept = paired.withColumn("_kept", F.filter("_pairs", lambda p: large_enough(p["box"])))
    return kept.select(
        jpg_name(F.col("filename")).alias("file"), F.col("filename").alias("orig_file"),
        F.lit(split).alias("src_split"), F.col("_w").alias("width"), F.col("_h").alias("height"),
        F.array("_ow", "_oh").alias("orig_size"), "exif_orientation",
        F.transform("_kept", lambda p: F.array(p["box"]["x1"], p["box"]["y1"], p["box"]["x2"], p["box"]["y2"]))
        .alias("boxes"),
        F.transform("_kept", lambda p: p["label"]).alias("labels"),
        (F.size("_pairs") - F.size("_kept")).alias("n_dropped_boxes"))


def allowlist_rows(raw: DataFrame, split: str) -> DataFrame:
    """Allow-list annotations; boxes stay in source pixels and ``scale`` maps them to the saved image."""
    sized = _sized(raw, ALLOWLIST_MAX_SIDE)

    def or_empty(column: str) -> F.Column:
        return F.coalesce(F.col(column), F.array().cast(raw.schema[column].dataType))

    return sized.select(
        jpg_name(F.col("filename")).alias("file"), F.col("filename").alias("orig_file"),
        F.lit(split).alias("src_split"), F.col("_w").alias("width"), F.col("_h").alias("height"),
        F.array("_ow", "_oh").alias("orig_size"), "exif_orientation", "scale", or_empty("ann_ids").alias("ann_ids"),
        or_empty("texts").alias("texts"), or_empty("ann_labels").alias("ann_labels"),
        or_empty("boxes").alias("boxes_raw"), or_empty("mappings").alias("mappings"))


def map_rows(raw: DataFrame) -> DataFrame:
    """(allowlist_id, photo_id) of the source map, both as saved file names."""
    return raw.select(jpg_name(F.col("prescription")).alias("allowlist_id"), jpg_name(F.col("pill")).alias("photo_id"))


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; blank lines are skipped, missing keys are null, a line that is no JSON or of other types fails."""
    schema = struct(schema) if isinstance(schema, str) else schema
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_open_jsonl(spark: SparkSession, path: str, known: StructType | str) -> DataFrame:
    """Known fields typed, every other key kept as text in ``extra``."""
    known = struct(known) if isinstance(known, str) else known
    text = spark.read.text(path).filter(F.trim("value") != "")
    every = F.from_json("value", "map<string,string>")
    typed = text.select(F.from_json("value", known).alias("row"), every.alias("all"))
    return typed.select("row.*", F.map_filter("all", lambda k, _: ~k.isin(known.names)).alias("extra"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """The JSON object {allow-list: [photos]} as (allowlist_id, photo_id, ord) rows, ``ord`` in the order of the source.

    The object may be of any size: every list ends with "]", so the file is read as records that end there, in as many
    tasks as it has splits, and each record is parsed by itself. Where a name holds a "]" itself, records are put together
    again: a record belongs to the one before while the quotes so far are odd in number. Null lists have no rows; what is
    no such object fails.
    """
    pieces = spark.read.option("lineSep", "]").text(path).withColumn("at", F.monotonically_increasing_id())
    quotes = F.regexp_replace(F.regexp_replace("value", r"\\.", ""), '[^"]', "")
    pieces = pieces.withColumn("odd", F.length(quotes) % 2)
    if not pieces.filter("odd = 1").isEmpty():
        pieces = _whole_pieces(pieces)
    body = F.regexp_replace("value", r"^[\s,{]+|\s+$", "")
    whole = F.when((body == "") | body.endswith("}"), F.concat(F.lit("{"), F.rtrim(body, F.lit("}")), F.lit("}"))).otherwise(
        F.concat(F.lit("{"), body, F.lit("]}")))
    entries = pieces.select("at", F.posexplode(F.map_entries(F.from_json(
        whole, "map<string,array<string>>", {"mode": "FAILFAST"}))).alias("_no", "e"))
    photos = entries.select("at", "_no", F.col("e.key").alias("allowlist_id"), F.posexplode("e.value").alias("_at", "photo_id"))
    return photos.select("allowlist_id", "photo_id", F.struct("at", "_no", "_at").alias("ord"))


def _whole_pieces(pieces: DataFrame) -> DataFrame:
    """Neighbouring records put together where a string goes on; ``at`` is that of the last one."""
    so_far = running_totals(pieces, [F.col("at")], {"quotes": F.col("odd")})
    ended = so_far.withColumn("ends", (F.col("quotes") % 2 == 0).cast("int"))
    numbered = running_totals(ended.select("value", "at", "ends"), [F.col("at")], {"upto": F.col("ends")}).withColumn(
        "piece", F.col("upto") - F.col("ends"))
    joined = numbered.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    return joined.select(F.array_join(F.transform("parts", lambda p: p["value"]), "]").alias("value"),
                         F.array_max(F.transform("parts", lambda p: p["at"])).alias("at"))


def read_map_rows(spark: SparkSession, path: str) -> DataFrame:
    """The same map kept as JSON lines {allowlist_id, photos}, one line per list, as (allowlist_id, photo_id) rows."""
    rows = spark.read.schema("allowlist_id STRING, photos ARRAY<STRING>").option("mode", "FAILFAST").json(path)
    return rows.select("allowlist_id", F.explode("photos").alias("photo_id"))


def labelled_photos(photos: DataFrame, photo_list: DataFrame) -> DataFrame:
    """Photos with at least one label, with their allow-list attached."""
    kept = photos.filter(F.size("labels") > 0)
    return kept.join(photo_list, kept["file"] == photo_list["photo_id"], "left").drop("photo_id")


def photo_items(photos: DataFrame) -> DataFrame:
    """One row per box, indexed by its place in the annotation."""
    pairs = same_length(F.arrays_zip("boxes", "labels"), "boxes", "labels")
    spread = photos.select(F.col("file").alias("photo_id"), F.posexplode(pairs).alias("item_idx", "_p"))
    stem = F.regexp_replace("photo_id", r"(?<=.)\.[^.]+$", "")
    return spread.select(
        F.concat_ws("_", stem, F.col("item_idx").cast("string")).alias("item_id"), "photo_id", "item_idx",
        *[F.col("_p.boxes")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        F.col("_p.labels").alias("label"))


def read_allowlists(spark: SparkSession, path: str) -> DataFrame:
    """Stored allow-lists; a path that does not exist holds none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], ALLOWLISTS)
    return read_jsonl(spark, path, ALLOWLISTS)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
