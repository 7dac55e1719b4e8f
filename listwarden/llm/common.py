"""What several operators share: stored tables that cut lineage, word and text expressions, bounded samples."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed by the contract: ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
# Bits of a join filter: 2 MB, at most 262,144 broadcast rows.
FILTER_BITS = 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = getattr(sc, "_llm_folder", None) or tempfile.mkdtemp(prefix="llm-tables-")
        sc._llm_folder = folder
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove the files of a ``stored`` table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if "/table-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Files of shuffles that nothing can read any more go now, and not when the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hash_sample(rows: DataFrame, n_rows: int, *cols: str, seed: int = 7) -> DataFrame:
    """About ``n_rows`` rows, or all if there are no more: those whose seeded hash lies in that share of its range.

    One count and a filter; nothing is ordered or gathered. Rows equal in ``cols`` are in or out together.
    """
    total = rows.count()
    if total <= n_rows:
        return rows
    return rows.filter(F.xxhash64(F.lit(seed), *cols) < F.lit(int((2 * n_rows / total - 1) * 2 ** 63)))


def possibly_in(rows: DataFrame, col: str, keys: DataFrame, key: str, inside: bool = True) -> DataFrame:
    """Rows whose ``col`` may be among ``keys`` (inside) or surely is not, by a bit per hash of every key.

    A filter before a join that would shuffle wide rows: it never loses a match. The bits are at most FILTER_BITS
    however many keys there are, FILTER_BITS / 64 rows to broadcast; with very many keys all rows pass. Null is in no keys.
    """
    def place(c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit("filter"), F.col(c)), F.lit(FILTER_BITS))

    bits = keys.filter(F.col(key).isNotNull()).select(place(key).alias("p")).groupBy(
        F.floor(F.col("p") / 64).alias("_filter_word")).agg(F.bit_or(F.call_function(
            "shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("_filter_mask"))
    at = rows.withColumn("_filter_at", place(col))
    met = at.join(F.broadcast(bits), F.floor(F.col("_filter_at") / 64) == F.col("_filter_word"), "inner" if inside else "left")
    hit = F.getbit("_filter_mask", (F.col("_filter_at") % 64).cast("int")) == 1
    hit = F.coalesce(hit & F.col(col).isNotNull(), F.lit(False))
    return met.filter(hit if inside else ~hit).select(*[F.col(f"`{c}`") for c in rows.columns])


_KEPT: dict = {}


def kept(owner, make: Callable):
    """What ``make`` built for ``owner`` in this worker process. Only the last owner's is held: workers are reused, and
    the tables of one operator would otherwise stay in memory while the next one runs."""
    if owner not in _KEPT:
        _KEPT.clear()
        _KEPT[owner] = make()
    return _KEPT[owner]


def forget() -> None:
    """Free what ``kept`` holds, at the end of a task that makes it again at little cost: idle workers stay."""
    _KEPT.clear()


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of sorted batches, one after the other."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        change = np.flatnonzero((batch[keys].to_numpy()[1:] != batch[keys].to_numpy()[:-1]).any(axis=1)) + 1
        bounds = [0, *change.tolist(), len(batch)]
        for i, j in zip(bounds[:-2], bounds[1:-1], strict=True):
            yield batch.iloc[i:j]
        rest = batch.iloc[bounds[-2]:] if len(batch) else None
    if rest is not None and len(rest):
        yield rest


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def n_words(text: Column) -> Column:
    """Words are maximal runs outside ASCII white space; null and blank texts have none."""
    trimmed = F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(0)).otherwise(
        F.size(F.split(trimmed, SPACE))).cast("long")
