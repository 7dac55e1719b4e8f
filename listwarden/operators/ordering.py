"""Ordered computation that never sends a whole table, or a whole large group, through one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..session import WINDOW_GROUP_ROWS, discard, split_by_group_size, stored


# Rows of a slice of an order; a task sorts one slice.
SLICE_ROWS = 500_000
# Buckets that a counting pass of a quantile search distinguishes in each open range.
BUCKETS = 1024


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, Column], is_stored: bool = False) -> DataFrame:
    """Inclusive running sums over one global order: whole numbers as 64-bit integers, others as doubles.

    The rows are written once, so that range bounds and rows come from one run of their plan (rows that are read from a
    stored table, ``is_stored``, are not), and range-partitioned by
    the order, which must be total, into slices whose number follows the rows. Each slice then adds the sum of the slices
    before it, a table of one row per slice.
    """
    marks = {name: f"_add_{name}" for name in totals}
    marked = df.select("*", *[col.alias(marks[name]) for name, col in totals.items()])
    for mark in marks.values():
        if not isinstance(marked.schema[mark].dataType, (DoubleType, FloatType)):
            marked = marked.withColumn(mark, F.col(mark).cast("long"))
    kept = marked if is_stored else stored(marked)
    n_slices = max(1, -(-kept.count() // SLICE_ROWS))
    ranged = stored(kept.repartitionByRange(n_slices, *order).withColumn("_slice", F.spark_partition_id()))
    if not is_stored:
        discard(kept)
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_slice").agg(*[F.sum(m).alias(m) for m in marks.values()]).select(
        "_slice", *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_before{m}") for m in marks.values()]
    )
    inside = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per slice, so the broadcast is bounded by the partition count.
    joined = ranged.join(F.broadcast(offsets), "_slice")
    return joined.select(
        *df.columns, *[(F.sum(m).over(inside) + F.col(f"_before{m}")).alias(name) for name, m in marks.items()]
    )


def index_within(df: DataFrame, keys: list[str], order: list[Column], name: str, kind: str = "int") -> DataFrame:
    """Zero-based position inside each group; ``kind`` long where a group may have more than 2^31 rows.

    Groups one task can hold use a window. Larger ones are ranked over the global order, less the
    position at which their group starts.
    """
    small, large = split_by_group_size(df, keys, WINDOW_GROUP_ROWS)
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = small.withColumn(name, (F.row_number().over(window) - 1).cast(kind))
    if large is None:
        return ranked
    placed = running_totals(large, [F.col(k) for k in keys] + order, {"_place": F.lit(1)})
    starts = placed.groupBy(*keys).agg(F.min("_place").alias("_start"))
    spread = placed.join(starts, keys).withColumn(name, (F.col("_place") - F.col("_start")).cast(kind))
    return ranked.unionByName(spread.select(*ranked.columns))


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one output column per share; no row without values.

    Nothing is sorted: the values, written once as a narrow table, are counted into BUCKETS equal buckets between the
    smallest and the largest, and again inside the buckets that hold a wanted rank, until such a bucket has a single
    value. A pass brings a count, a minimum and a maximum per bucket to the driver.
    """
    spark = df.sparkSession
    kept = stored(df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")))
    n, low, high = kept.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    schema = ", ".join(f"`{name}` double" for name in shares)
    if not n:
        return spark.createDataFrame([], schema)
    positions = {name: share * (n - 1) for name, share in shares.items()}
    at = {rank: (low, high, 0) for p in positions.values() for rank in (math.floor(p), math.ceil(p))}
    while ranges := sorted({(a, b) for a, b, _ in at.values() if a < b}):
        counted = _bucket_counts(kept, ranges)
        for rank, (a, b, below) in at.items():
            if a < b:
                for count, least, most in counted[ranges.index((a, b))]:
                    if rank < below + count:
                        at[rank] = (least, most, below)
                        break
                    below += count
    discard(kept)
    row = []
    for p in positions.values():
        lo, hi = at[math.floor(p)][0], at[math.ceil(p)][0]
        row.append(lo + (hi - lo) * (p - math.floor(p)))
    return spark.createDataFrame([tuple(row)], schema)


def _bucket_counts(values: DataFrame, ranges: list[tuple[float, float]]) -> list[list[tuple[int, float, float]]]:
    """(count, least, most) of the filled buckets of every range, in order; ranges do not overlap."""
    v, inside, bucket = F.col("v"), F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (a, b) in enumerate(ranges):
        hit = (v >= a) & (v <= b)
        place = F.floor((v / 2 - a / 2) / F.lit(b / 2 - a / 2) * BUCKETS).cast("int")     # halves cannot overflow
        inside = F.when(hit, i).otherwise(inside)
        bucket = F.when(hit, F.least(place, F.lit(BUCKETS - 1))).otherwise(bucket)
    found = values.select("v", inside.alias("i"), bucket.alias("b")).filter(F.col("i").isNotNull()).groupBy("i", "b").agg(
        F.count(F.lit(1)), F.min("v"), F.max("v")).collect()
    out: list[list[tuple[int, float, float]]] = [[] for _ in ranges]
    for i, _, *rest in sorted(map(tuple, found)):
        out[i].append(tuple(rest))
    return out


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def every_kth(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Systematic sample: every floor(N / n)-th row of the order, the first n of them."""
    step = max(1, df.count() // n)
    placed = running_totals(df, order, {"_place": F.lit(1)})
    place = F.col("_place") - 1
    return placed.filter((place % step == 0) & (place < step * n)).select(*df.columns)
