"""Registered queries of the training-data operators, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    embedding_dedup,
    exact_dedup,
    jaccard,
    language,
    lexical_search,
    line_dedup,
    mixing,
    periodic_runs,
    pii,
    sharding,
    suffix_dedup,
    token_files,
)
from .common import SPACE, documents, shared_folder, stored

PIECES, RANKS, WORDS = (public_tokenizers.path(n) for n in (
    "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"))


def op1_language(spark: SparkSession, folder: str, model_path: str = PIECES) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~language.held_out()), model_path)
    found = language.predict(docs.select("doc_id", "text"), model, folder)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))


def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return pii.find(docs, pii.fit(docs))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, folder))


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, folder)).drop("row")


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffix_dedup.suffix_dedup(documents(spark, folder))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text without the lines that go."""
    return line_dedup.line_dedup(documents(spark, folder).select("doc_id", "text"))


def op8_byte_bpe(spark: SparkSession, folder: str, ranks_path: str = RANKS) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them."""
    docs = documents(spark, folder).select("doc_id", "text")
    back = bpe.encode(docs, ranks_path, public_tokenizers.PATTERN, decoded_col="decoded")
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(stored(mixing.sized(documents(spark, folder)))).select("doc_id", "size", "source_size", "target", "taken")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    rows = sharding.shard_rows(sharding.sized(documents(spark, folder)), 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op11_token_files(spark: SparkSession, folder: str, tokenizer_path: str = WORDS) -> DataFrame:
    """Write the ids of all documents and read them back; the tokenizer drops white space and joins nothing across it."""
    place = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    token_files.write(documents(spark, folder), place, tokenizer_path, end_id=1, words_apart=True)
    return token_files.read(spark, place).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


def planted(docs: DataFrame) -> DataFrame:
    """Documents whose text the contract makes periodic from a word on, for one id hash in ten."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def made(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")

    # Bound as a variable of a lambda, the words are made once.
    words = F.array(F.filter(F.split("text", SPACE), lambda w: w != ""))
    text = F.element_at(F.transform(words, lambda w: F.when(F.size(w) > 0, made(w))), 1)
    return docs.withColumn("text", F.when(h % 10 == 0, F.coalesce(text, F.col("text"))).otherwise(F.col("text")))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted(documents(spark, folder).select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.floor(-1000 * F.col("best.l") / F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_language, op2_embedding_dedup, op3_pii, op4_exact_dedup, op5_jaccard_join, op6_suffix_dedup, op7_line_dedup,
    op8_byte_bpe, op9_mixing, op10_sharding, op11_token_files, op12_lexical_search, op13_periodic_runs)}
ORACLES = {"op4_exact_dedup": exact_dedup.ORACLE, "op7_line_dedup": line_dedup.ORACLE,
           "op12_lexical_search": lexical_search.ORACLE}
