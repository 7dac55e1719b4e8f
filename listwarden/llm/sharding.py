"""Uniform shuffle into shards of exact sizes: draw how many rows each bucket sends to each shard, then permute."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, text_or_empty

# The matrix has at most MAX_BUCKETS x shards entries, whatever the input; a bucket is sorted by one task.
BUCKET_ROWS, MIN_BUCKETS, MAX_BUCKETS = 50_000, 256, 8192
BLOCK_COPIES = 10_000   # equal rows that one task writes out at a time


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows taken without replacement are good; exact by inversion, for any population size.

    Probabilities follow from the ratios of neighbours around the mode; beyond 12 standard deviations nothing is left
    that a double could hold.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    spread = int(12 * (draws * good / total * bad / total * max(total - draws, 1) / max(total - 1, 1)) ** 0.5) + 40
    k = np.arange(max(low, mode - spread), min(high, mode + spread), dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.cumsum(np.exp(logs - logs.max()))
    return int(max(low, mode - spread) + np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows each bucket sends to each shard: row sums are the bucket counts, column sums the shard sizes."""
    rng, total = np.random.default_rng(seed), int(sum(counts))
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = np.zeros((len(counts), n_shards), dtype=np.int64)
    for b, left in enumerate(counts):
        others = sum(room)
        for s in range(n_shards):
            others -= room[s]
            matrix[b, s] = hypergeometric(rng, room[s], others, left)
            left -= int(matrix[b, s])
        room = [r - int(m) for r, m in zip(room, matrix[b], strict=True)]
    return matrix


def numbered(rows: DataFrame, seed: int, block: int = BLOCK_COPIES) -> DataFrame:
    """Every row with ``_shard_h``, a hash of its columns and of its number among the rows equal to it.

    Equal rows are counted before the shuffle and written out again after it, those of a large group by blocks that
    many tasks share: which of them is which makes no difference, so no group of them is ever gathered or sorted.
    """
    names = [f"`{c}`" for c in rows.columns]
    counted = stored(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_shard_n")).withColumn(
        "_shard_h", F.xxhash64(F.lit(seed), *names)))
    few = counted.filter(F.col("_shard_n") <= block).select(
        *names, "_shard_h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shard_n") - 1)).alias("_shard_i"))
    blocks = counted.filter(F.col("_shard_n") > block).withColumn("_shard_k", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("_shard_n") - 1) / block)))).repartition("_shard_h", "_shard_k")
    first = F.col("_shard_k") * block
    many = blocks.select(*names, "_shard_h", F.explode(F.sequence(
        first, F.least(first + block, F.col("_shard_n")) - 1)).alias("_shard_i"))
    return few.unionByName(many).select(*names, F.when(F.col("_shard_i") == 0, F.col("_shard_h")).otherwise(
        F.xxhash64("_shard_h", "_shard_i")).alias("_shard_h"))


def shard_rows(rows: DataFrame, n_shards: int, seed: int = 7, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Every row with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in its shard).

    Shard sizes differ by one row at most and every assignment of rows to slots is equally likely as far as the seeded
    hash is uniform. Rows are told apart by all their columns, identical rows by a number, so any share of the table may
    be copies of one row. Nulls hash like values, long texts are hashed and carried whole, no rows give no rows, and
    reruns agree. Columns called shard, slot or starting with ``_shard_`` are replaced.
    """
    rows = rows.drop("shard", "slot", *[c for c in rows.columns if c.startswith("_shard_")])
    names = [f"`{c}`" for c in rows.columns]
    keyed = numbered(rows, seed)
    total = keyed.count()
    n_buckets = min(max(MIN_BUCKETS, total // bucket_rows), MAX_BUCKETS)
    keyed = keyed.withColumn("_shard_b", F.pmod("_shard_h", F.lit(n_buckets)).cast("int"))
    found = dict(keyed.groupBy("_shard_b").count().collect())          # n_buckets rows at most
    matrix = communication_matrix([found.get(b, 0) for b in range(n_buckets)], n_shards, seed)
    # The matrix as one literal: cuts[b][s] is the rank in bucket b where shard s ends.
    cuts = ";".join(",".join(map(str, row)) for row in np.cumsum(matrix, axis=1).tolist())
    table = rows.sparkSession.range(1).select(F.posexplode(F.split(F.lit(cuts), ";")).alias("_shard_b", "c")).select(
        "_shard_b", F.split("c", ",").cast("array<long>").alias("_shard_cuts"))
    # Permute within the bucket and hand out the ranks.
    local = Window.partitionBy("_shard_b").orderBy(F.xxhash64(F.lit("local"), "_shard_h"), "_shard_h")
    ranked = keyed.withColumn("_shard_r", F.row_number().over(local))
    sent = ranked.join(F.broadcast(table), "_shard_b").withColumn(
        "shard", F.size(F.filter("_shard_cuts", lambda end: end < F.col("_shard_r"))).cast("int"))
    # Second permutation: cells of a shard by hash, order within a cell by hash, cells one after the other.
    n_cells = max(1, n_buckets // n_shards)
    sent = stored(sent.select(
        *names, "shard", F.xxhash64(F.lit("again"), F.lit(seed), "_shard_h").alias("_shard_o"),
    ).withColumn("_shard_c", F.pmod("_shard_o", F.lit(n_cells)).cast("int")))
    before = Window.partitionBy("shard").orderBy("_shard_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "_shard_c").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "_shard_c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shard_start"))
    inside = Window.partitionBy("shard", "_shard_c").orderBy("_shard_o", *names)
    placed = sent.withColumn("_shard_i", F.row_number().over(inside))
    return placed.join(F.broadcast(starts), ["shard", "_shard_c"]).select(     # n_shards x n_cells rows at most
        *names, "shard", (F.col("_shard_start") + F.col("_shard_i") - 1).cast("long").alias("slot"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8; null text: 8) and text_crc32 (null text as empty)."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"))
