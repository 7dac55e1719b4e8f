"""Near-duplicate vectors by spherical-cap filters: random product codes, list decoding, a join on filters, a check."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, whole_groups
from .graph import components

# Vectors an average filter should hold, and rows of the largest block compared at once; larger filters are tiled.
OCCUPANCY, TILE = 64, 1024
MIN_RECALL, TRIALS, SEED = 0.985, 400, 7
LEAST_FILTERS, MOST_FILTERS = 4, 512    # filters that every vector is in; mean above which no code is tried


def kth_largest_sum(first: np.ndarray, second: np.ndarray, k: int) -> float:
    """The k-th largest of all sums of one score of each half, over all rows, without making the sums."""
    sorted_ = np.sort(second, axis=1)
    low, high = float((first.min(axis=1) + sorted_[:, 0]).min()), float((first.max(axis=1) + sorted_[:, -1]).max()) + 1.0
    for _ in range(60):
        middle = (low + high) / 2
        reached = sum(int((len(b) - np.searchsorted(b, middle - a)).sum()) for a, b in zip(first, sorted_, strict=True))
        low, high = (middle, high) if reached >= k else (low, middle)
    return low


class ProductCode:
    """Filters are all pairs of one code word per half of a rotated vector; a vector is in those above the threshold, and in
    its LEAST_FILTERS best ones in any case."""

    def __init__(self, dim: int, words: int, mean_filters: float):
        rng = np.random.default_rng(SEED)
        self.half = (dim + 1) // 2
        self.rotation = np.linalg.qr(rng.standard_normal((2 * self.half, 2 * self.half)))[0][:dim]
        books = rng.standard_normal((2, words, self.half))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True)
        probe = self.unit(rng.standard_normal((64, dim)))
        self.threshold = kth_largest_sum(*self.scores(probe), min(len(probe) * words * words, int(mean_filters * len(probe))))

    @staticmethod
    def unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.linalg.norm(rows, axis=1, keepdims=True)

    def scores(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = units @ self.rotation
        return turned[:, :self.half] @ self.books[0].T, turned[:, self.half:] @ self.books[1].T

    def decode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter a vector exceeds, or its best ones where it exceeds few, by row, then filter.

        Only first halves that the best second half can lift over the threshold are looked at.
        """
        first, second = self.scores(units)
        row, word = np.nonzero(first + second.max(axis=1, keepdims=True) >= self.threshold)
        hit, other = np.nonzero(second[row] + first[row, word][:, None] >= self.threshold)
        row, found = row[hit], word[hit] * second.shape[1] + other
        few = np.flatnonzero(np.bincount(row, minlength=len(units)) < LEAST_FILTERS)
        if not len(few):
            return row, found
        # The best sums are among the best words of both halves.
        n = min(LEAST_FILTERS, second.shape[1])
        a, b = (np.argsort(-x[few], axis=1, kind="stable")[:, :n] for x in (first, second))
        sums = np.take_along_axis(first[few], a, 1)[:, :, None] + np.take_along_axis(second[few], b, 1)[:, None, :]
        best = np.argsort(-sums.reshape(len(few), -1), axis=1, kind="stable")[:, :LEAST_FILTERS]
        more = np.take_along_axis(a, best // n, 1) * second.shape[1] + np.take_along_axis(b, best % n, 1)
        both = np.unique(np.stack([np.append(row, np.repeat(few, best.shape[1])), np.append(found, more)]), axis=1)
        return both[0], both[1]


@lru_cache(maxsize=8)
def product_code(dim: int, n_vectors: int, cosine: float) -> ProductCode:
    """The code for so many vectors, with as many filters per vector as pairs at exactly ``cosine`` need to meet.

    Filters grow with the input, so that one holds OCCUPANCY vectors on average; tried on random pairs.
    Where no code reaches MIN_RECALL (few dimensions), all vectors share one filter, which is compared in tiles: exact, at
    the cost of all pairs of tiles.
    """
    rng = np.random.default_rng(SEED + 1)
    a = ProductCode.unit(rng.standard_normal((TRIALS, dim)))
    side = rng.standard_normal((TRIALS, dim))
    side = ProductCode.unit(side - (side * a).sum(axis=1, keepdims=True) * a) if dim > 1 else 0 * a
    b = cosine * a + np.sqrt(max(0.0, 1 - cosine * cosine)) * side
    mean = 8.0
    while True:
        words = int(np.ceil(np.sqrt(mean * max(n_vectors, 4 * OCCUPANCY) / OCCUPANCY)))
        code = ProductCode(dim, words, mean)
        met = [set(zip(*map(np.ndarray.tolist, code.decode(x)), strict=True)) for x in (a, b)]
        if len({row for row, _ in met[0] & met[1]}) >= MIN_RECALL * TRIALS or dim == 1:
            return code
        if mean > MOST_FILTERS:
            code = ProductCode(dim, 1, 1)
            code.threshold = -np.inf
            return code
        mean *= 1.3


def _vectors(column: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dim).astype(np.float64)


def _compare(group: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Links inside one filter (or between two tiles of it): counts of pairs this filter answers for, and local roots.

    A pair may meet in many filters; the smallest one they share counts it.
    """
    dim, mine, n = int(group["dim"].iloc[0]), int(group["filter"].iloc[0]), len(group)
    units = ProductCode.unit(_vectors(group["vec"], dim))
    lists = [np.frombuffer(f, np.int32) for f in group["filters"]]
    lower = np.unique(np.concatenate(lists))
    lower = lower[lower < mine]
    owned = np.zeros((n, len(lower)), np.float32)
    for i, f in enumerate(lists):
        owned[i, np.searchsorted(lower, f[f < mine])] = 1
    near = units @ units.T >= cosine
    np.fill_diagonal(near, False)
    if group["a"].iloc[0] != group["b"].iloc[0]:
        tile = group["tile"].to_numpy()
        near &= tile[:, None] != tile[None, :]
    copies = group["copies"].to_numpy().astype(np.float64)
    counted = near & (owned @ owned.T == 0) if len(lower) else near
    links = counted.astype(np.float64) @ copies
    label, nodes = group["rep"].to_numpy().copy(), group["rep"].to_numpy()
    left, right = np.nonzero(near)
    while len(left):
        low = label.copy()
        np.minimum.at(low, left, label[right])
        if (low == label).all():
            break
        label = low
    keep = near.any(axis=1)
    return pd.DataFrame({"rep": nodes[keep], "root": label[keep], "links": links[keep].astype(np.int64)})


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9,
                 tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row, links being pairs found with cosine >= ``cosine``.

    Cosines are of the float components in double precision. Vectors that are null, empty, zero or hold a null or
    non-finite component link with nothing; vectors of different lengths never link. Equal vectors are compared once
    and counted as often as they occur; rows that repeat an id are vectors of their own. Every pair found truly links;
    pairs are missed only if they share no filter (see ``product_code``). Labels and further columns are ignored.
    """
    spark = table.sparkSession
    good = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) &
                      F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<float>").alias("vec"))
    rows = rows.withColumn("key", F.when(good, F.struct(F.xxhash64("vec").alias("x"),
                                                        F.xxhash64(F.lit("second"), "vec").alias("y"))))
    reps = stored(rows.filter("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec")).withColumn(
        "rep", F.monotonically_increasing_id()).withColumn("dim", F.size("vec")))
    n_vectors = reps.count()
    # Made once; a code for 10^7 vectors has some megabytes. Vectors have few different lengths.
    codes = spark.sparkContext.broadcast({d: product_code(d, n_vectors, cosine) for (d,) in reps.select("dim").distinct().collect()})

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, group in batch.groupby("dim"):
                packed = [np.asarray(v, np.float32).tobytes() for v in group["vec"]]
                code = codes.value[int(dim)]
                for i in range(0, len(group), 512):
                    part = group.iloc[i:i + 512]
                    row, found = code.decode(ProductCode.unit(_vectors(pd.Series(packed[i:i + 512]), int(dim))))
                    ends = np.searchsorted(row, np.arange(len(part) + 1))
                    found = found.astype(np.int32)
                    yield pd.DataFrame({"rep": part["rep"].to_numpy(), "dim": int(dim), "copies": part["copies"].to_numpy(),
                                        "vec": packed[i:i + 512],
                                        "filters": [found[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)],
                                        "list": [found[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]})

    coded = stored(reps.select("rep", "dim", "copies", "vec").mapInPandas(
        decode, "rep long, dim int, copies long, vec binary, filters binary, list array<int>"))
    member = coded.select("rep", "dim", F.explode("list").alias("filter"))
    tiles = stored(member.groupBy("dim", "filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "dim", "filter", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    placed = member.join(tiles, ["dim", "filter"]).withColumn("tile", F.pmod(F.xxhash64("rep"), "tiles").cast("int"))
    # Each pair of tiles of a crowded filter is a block of its own.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "rep", "dim", "filter", "tile", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    keys = ["dim", "filter", "a", "b"]
    full = placed.join(coded.select("rep", "copies", "vec", "filters"), "rep").repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, keys):
            yield _compare(group, cosine)

    met = stored(full.mapInPandas(compare, "rep long, root long, links long"))
    counts = met.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(met.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = stored(reps.select("rep", "key", "low", "copies").join(counts, "rep", "left").join(
        groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    out = stored(named.join(lows, "component").select(
        "key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "key").join(out, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
