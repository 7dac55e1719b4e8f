"""A corpus from raw documents to token ids, stage by stage; every stage is written as Parquet and read back.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of ``documents``. Empty tables give empty tables, null texts pass until the mix, which takes documents by their words.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwarden.llm import bpe, jaccard, language, line_dedup, mixing
from listwarden.llm.common import SPACE, n_words, possibly_in, row_key, stored
from listwarden.session import ship_package

PIECES, RANKS = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"))
NEAR_PERCENT, NEAR_WORDS = 80, 5
# Rows that a task hands to Python at a time: whole texts, which it then holds in several forms on both sides.
BATCH_ROWS, BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session gives Python at most BATCH_ROWS rows at once. A smaller setting stays; no result changes."""
    now = int(spark.conf.get(BATCH_KEY))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; an unlabelled one gets the language found, if any was learned."""
    ship_package(spark)
    small_batches(spark)
    model = language.fit(docs.filter(~language.held_out()), PIECES)
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.predict(docs, model, f"pipeline {sf_dir}").filter("lang_pred <> 'und'")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines of any length go; so does a document that keeps no word."""
    left = line_dedup.line_dedup(docs, min_words=1)
    gone = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return left.filter(~F.coalesce(gone, F.lit(False))).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(
        *docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that with the smallest id, a null id last."""
    ship_package(spark)
    small_batches(spark)
    found = jaccard.jaccard_components(docs, NEAR_PERCENT, NEAR_WORDS, keep_row=True).filter("n_shingles > 0")
    found = found.groupBy(F.col("row").alias("_pipeline_gone")).agg(
        F.first(F.col("row") != F.col("keep_row")).alias("_pipeline_copy"), F.count(F.lit(1)).alias("n"))
    gone = stored(found.filter("_pipeline_copy or n > 1").drop("n"))
    keyed = docs.withColumn("_pipeline_row", row_key("doc_id", "text"))
    maybe = possibly_in(keyed, "_pipeline_row", gone, "_pipeline_gone").join(
        gone, F.col("_pipeline_row") == F.col("_pipeline_gone"), "left_anti")
    left = maybe.union(possibly_in(keyed, "_pipeline_row", gone, "_pipeline_gone", inside=False))
    again = gone.filter("not _pipeline_copy")
    if not again.isEmpty():                     # rows equal in id and text: one of them
        left = left.union(possibly_in(keyed, "_pipeline_row", again, "_pipeline_gone").join(
            again, F.col("_pipeline_row") == F.col("_pipeline_gone")).select(*left.columns).dropDuplicates(["_pipeline_row"]))
    return left.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the copy in which the budget ends is cut to the words taken."""
    keyed = docs.withColumn("_pipeline_row", F.xxhash64(*docs.columns))
    sizes = stored(keyed.select("doc_id", "source", n_words(F.col("text")).alias("size"), "_pipeline_row"))
    taken = mixing.mix(sizes).filter("taken > 0").groupBy(F.col("_pipeline_row").alias("_pipeline_key")).agg(
        F.sum("taken").alias("_pipeline_taken"), F.first("size").alias("_pipeline_size"))
    copies = keyed.dropDuplicates(["_pipeline_row"]).join(taken, F.col("_pipeline_row") == F.col("_pipeline_key")).withColumn(
        "_pipeline_copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_pipeline_taken") / F.col("_pipeline_size")))))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    part = F.array_join(F.slice(words, F.lit(1), (F.col("_pipeline_taken") % F.col("_pipeline_size")).cast("int")), " ")
    text = F.when(F.col("_pipeline_copy") * F.col("_pipeline_size") > F.col("_pipeline_taken"), part).otherwise(F.col("text"))
    return copies.withColumn("_pipeline_old", F.col("text")).withColumn("text", text).withColumn(
        "n_chars", F.when(F.col("text") == F.col("_pipeline_old"), F.col("n_chars")).otherwise(F.length("text"))).select(
        *docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian unsigned 32-bit integers), and whether they decode to its text."""
    ship_package(spark)
    small_batches(spark)
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    back = bpe.encode(rows, RANKS, public_tokenizers.PATTERN, decoded_col="decoded")
    return back.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.col("text").cast("binary")).alias("intact"))


STAGES = [("language", language_id), ("lines", line_dedup_stage), ("near", near_dedup), ("mix", mix_sources), ("encode", encode)]
ORACLE_SQL = None       # a learned model and seeded hashes: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
