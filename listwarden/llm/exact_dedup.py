"""Exact duplicates by progressive refinement: length, then a hash of the head, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored, text_or_empty

# Characters of the normalised text that the second level hashes.
HEAD_CHARS = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = HEAD_CHARS) -> DataFrame:
    """One narrow row per document: (doc_id, n, head, text_sha256), all of the normalised text. One scan, no shuffle."""
    norm = F.regexp_replace(text_or_empty(text_col), SPACE, " ")
    return docs.select(F.col(id_col).alias("doc_id"), norm.alias("_norm")).select(
        "doc_id",
        F.octet_length("_norm").alias("n"),
        F.xxhash64(F.octet_length("_norm"), F.substring("_norm", 1, head_chars)).alias("head"),
        F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
    )


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once; counted before the shuffle, so a hot value costs one row per task."""
    return stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(*keys))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Class of equal texts of every document.

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty.
    Returns every row once: doc_id, keep_id (smallest doc_id of the class), group_size, kept, text_sha256. Rows that
    repeat a doc_id and its text count as copies, all of them kept; a null doc_id stays only if its class has no
    other. An empty table gives no rows; further columns are ignored.

    Texts never leave the scan that digests them: level 1 reads only lengths, level 2 the head hashes of lengths
    that repeat, level 3 the full hashes of heads that repeat. Each level joins narrow rows with a stored list of
    repeated keys, a join whose large partitions Spark may split.
    """
    rows = stored(digests(docs, id_col, text_col))
    lengths = _repeated(rows, ["n"])
    heads = _repeated(rows.select("n", "head").join(lengths, "n", "left_semi"), ["head"])
    survivors = rows.select("doc_id", "head", "text_sha256").join(heads, "head", "left_semi")
    groups = stored(survivors.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


ORACLE = r"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id,
 count(*) over (partition by text_sha256) as group_size,
 doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256 from n"""
