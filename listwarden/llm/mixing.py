"""Mixing sources to target weights by weighted fair queueing, with at most two passes over every source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words, stored

WEIGHTS = (5, 2, 1)     # fixed by the contract: sources by code point, null last, repeating
SHARE = 1.5             # budget as a multiple of all words
PASSES = 2              # a document is taken this many times at most
CELL_ROWS, MAX_CELLS = 20_000, 16_384
EPSILON = 1e-6          # words; sums of targets are whole up to rounding


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size), one row per source.

    Weights share the budget; what a source cannot take (more than ``passes`` times its size) goes to the others by
    weight until none is above. With sources ordered by cap / weight the capped ones come first, so the water level
    follows from running sums over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    upto, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn(
        "_w", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("_cap", F.col("source_size") * float(passes)).withColumn("_fill", F.col("_cap") / F.col("_w"))
    rows = rows.withColumn("_budget", F.sum("source_size").over(whole) * F.lit(share))
    capped, used = (F.coalesce(F.sum(c).over(upto), F.lit(0.0)) for c in ("_cap", "_w"))
    rows = rows.withColumn("_level", (F.col("_budget") - capped) / (F.sum("_w").over(whole) - used))
    # The level rises while sources are full and falls once one that is not full is counted as full.
    level = F.max(F.when(F.col("_level") <= F.col("_fill"), F.col("_level"))).over(whole)
    return rows.select("source", "source_size", "rank",
                       F.least("_cap", F.coalesce(level * F.col("_w"), F.col("_cap"))).alias("target"))


def mix(rows: DataFrame, passes: int = PASSES, seed: int = 7, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Every row of (doc_id, source, size, ...) with source_size, target, taken and finish.

    Each source's rows are shuffled by a seeded hash and queued ``passes`` times. A copy's virtual finish time is the
    words queued up to its end divided by the source's target, so every source has used up its target at time 1; as the
    targets add up to the budget, the queue of all copies in order of time is cut there. Copies that finish by then are
    taken, the one of each source that is under way is taken in part, to its source's last word: a source takes its
    target to one word (targets are rounded along the sources so that the sum is the budget), however long its next
    document. ``finish`` is the time of the first copy, infinite where the target is 0; ``in_order`` sorts by it.

    Rows without words take nothing, null sources form a source of their own, repeated rows are separate copies, very
    long texts are cut like others, an empty table gives no rows. Reruns agree. Further columns pass through; those
    called source_size, target, taken, finish or starting with ``_mix_`` are replaced.

    No source is one task: prefix sums run within hash cells of a source, whose totals (MAX_CELLS per source at most)
    are added up apart.
    """
    rows = rows.drop("source_size", "target", "taken", "finish", *[c for c in rows.columns if c.startswith("_mix_")])
    names = [f"`{c}`" for c in rows.columns]
    base = rows.withColumn("_mix_h", F.xxhash64(F.lit(seed), *names))
    sources = stored(base.groupBy("source").agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.count(F.lit(1)).alias("n")))
    quota = targets(sources.select("source", "source_size"), passes=passes).withColumnRenamed("source", "_mix_q")
    so_far = F.sum("target").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    quota = stored(quota.join(sources.select("source", "n"), F.col("_mix_q").eqNullSafe(F.col("source"))).select(
        "_mix_q", "source_size", "target", F.col("rank").alias("_mix_rank"),
        (F.floor(so_far + EPSILON) - F.floor(so_far - F.col("target") + EPSILON)).alias("_mix_words"),
        F.least(F.greatest(F.ceil(F.col("n") / cell_rows), F.lit(1)), F.lit(MAX_CELLS)).alias("_mix_cells")))
    # Shuffled order within a source: the hash as a fraction picks the cell, then decides inside it.
    cell = F.floor((F.col("_mix_h").cast("double") / F.lit(2.0 ** 64) + 0.5) * F.col("_mix_cells")).cast("int")
    inside = Window.partitionBy("_mix_rank", "_mix_cell").orderBy("_mix_h", *names)
    queued = stored(base.join(quota, F.col("source").eqNullSafe(F.col("_mix_q"))).withColumn("_mix_cell", cell).withColumn(
        "_mix_upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    ahead = Window.partitionBy("_mix_rank").orderBy("_mix_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = queued.groupBy("_mix_rank", "_mix_cell").agg(F.sum("size").alias("w")).select(
        "_mix_rank", "_mix_cell", F.coalesce(F.sum("w").over(ahead), F.lit(0)).alias("_mix_start"))
    queued = queued.join(starts, ["_mix_rank", "_mix_cell"]).withColumn(
        "_mix_end", F.col("_mix_start") + F.col("_mix_upto"))

    def got(i: int) -> Column:
        """Words of copy i before time 1: all, those up to the source's last word, or none."""
        left = F.col("_mix_words") - (F.lit(i) * F.col("source_size") + F.col("_mix_end") - F.col("size"))
        return F.greatest(F.least(left, F.col("size")), F.lit(0))

    return queued.select(
        *names, "source_size", "target", sum((got(i) for i in range(1, passes)), got(0)).cast("long").alias("taken"),
        F.when(F.col("target") > 0, F.col("_mix_end") / F.col("target")).otherwise(F.lit(float("inf"))).alias("finish"))


def in_order(mixed: DataFrame, n_slices: int, passes: int = PASSES) -> DataFrame:
    """The mix as it is read in training: every copy taken (column ``copy``, from 0; ``words`` of it) with its own
    ``finish`` time, range-sorted by it. Store ``mixed`` first; its rows are read twice."""
    i = F.col("copy")
    copies = mixed.filter("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    copies = copies.withColumn("words", F.least(F.greatest(F.col("taken") - i * F.col("size"), F.lit(0)), F.col("size")))
    return copies.filter("words > 0").withColumn(
        "finish", F.col("finish") + i * F.col("source_size") / F.col("target")).repartitionByRange(
        n_slices, "finish").sortWithinPartitions("finish")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size): words of every whole text, null text has none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       n_words(F.col(text_col)).alias("size"))
