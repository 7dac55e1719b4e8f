"""Reference vectors per class: the normalised mean and, for large classes, k-means centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MIN_PER_CENTRE, PROTOTYPES_PER_CLASS
from ..functions.hashing import seeded_hash
from ..functions.names import class_label
from ..functions.numbers import half_even
from ..functions.vectors import unit
from ..session import BROADCAST_BYTES, discard, durable, stored
from .ordering import running_totals
from .similarity import PrototypeBlocks, _matrix, class_similarities


def class_means(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(class_id, vector, n): normalised mean per class, summed map-side before the shuffle."""
    dense = array_to_vector(F.col(vector).cast("array<double>"))
    means = vectors.groupBy(F.col(label).alias("class_id")).agg(
        Summarizer.mean(dense).alias("_mean"), F.count(F.lit(1)).alias("n")
    )
    return means.select("class_id", unit(vector_to_array("_mean")).alias("vector"), "n")


def class_mean_table(vectors: DataFrame, classes: DataFrame, dim: int, label: str = "label",
                     vector: str = "embedding") -> DataFrame:
    """Means of a fixed class list; a class without vectors gets the zero vector."""
    zero = F.array_repeat(F.lit(0.0), dim)
    return classes.join(class_means(vectors, label, vector), "class_id", "left").select(
        "class_id", F.coalesce("vector", zero).alias("vector"), F.coalesce("n", F.lit(0)).alias("n")
    )


def build_prototypes(vectors: DataFrame, item: str = "vec_id", label: str = "label", vector: str = "embedding",
                     k: int = PROTOTYPES_PER_CLASS, min_per_centre: int = MIN_PER_CENTRE, seed: int = 0,
                     starts: int = 4) -> DataFrame:
    """(class_id, proto_no, vector): row 0 is the mean; centres follow only where at least two fit."""
    means = durable(class_means(vectors, label, vector))       # one row per class, read in every round below
    first = means.select("class_id", F.lit(0).alias("proto_no"), "vector")
    if k - 1 < 2:
        return first
    wanted = means.select("class_id", F.least(F.lit(k - 1), F.floor(F.col("n") / min_per_centre)).cast("int")
                          .alias("kc")).filter("kc >= 2")
    source = vectors.select(F.col(item).alias("item"), F.col(label).alias("class_id"),
                            F.col(vector).cast("array<double>").alias("vector")).join(wanted, "class_id")
    centres = class_centres(source, k - 1, seed, starts)
    if centres is None:
        return first
    unit_centres = centres.select("class_id", (F.col("centre") + 1).alias("proto_no"), unit("vector").alias("vector"))
    return first.unionByName(unit_centres)


# The source is written anew with fresh bounds once a round has to read more than this share of it.
STALE_SHARE = 0.3
# Small row groups, sorted by the bound that decides whether a row is read.
ROW_GROUP_BYTES = 8 << 20
SLACK = 1e-7            # rounding of distances


def class_centres(source: DataFrame, most: int, seed: int, starts: int,
                  limit_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """Lloyd's algorithm inside every class at once, best of several hash-seeded starts.

    ``source`` has (item, class_id, vector, kc) with at most ``most`` centres per class; it is written once. A task adds
    up its rows per centre, so a class of any size costs one small row per task. Classes are taken in blocks whose
    centres fit a broadcast.
    """
    spark = source.sparkSession
    kept = stored(source)
    draws = F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start")
    order = Window.partitionBy("class_id", "start").orderBy("_h", "item")
    seeds = (
        kept.select("*", draws).withColumn("_h", seeded_hash(seed, "start", "class_id", "item"))
        .withColumn("_rank", F.row_number().over(order))
        # The fixed bound lets every task drop all but its first rows before the shuffle.
        .filter(F.col("_rank") <= most).filter(F.col("_rank") <= F.col("kc"))
        .select("class_id", "start", (F.col("_rank") - 1).alias("centre"), "vector")
    )
    per_class = kept.groupBy("class_id").agg((F.max("kc") * F.max(F.size("vector")) * 8 * starts).alias("b"))
    sizes = per_class.orderBy("class_id").toArrow()
    if sizes.num_rows == 0:
        return None
    ids = sizes["class_id"].to_numpy()
    bytes_ = sizes["b"].to_numpy()
    block = (np.cumsum(bytes_) - bytes_) // limit_bytes
    found = []
    for number in np.unique(block):
        inside = ids[block == number]
        part = F.col("class_id").between(int(inside[0]), int(inside[-1]))
        found.append(_lloyd(kept.filter(part).select("class_id", "vector"), seeds.filter(part), starts))
    discard(kept)
    frames = [spark.createDataFrame(t, "class_id int, centre int, vector array<double>") for t in found]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


class Sums:
    """Rows, squared lengths and vector sums per centre. A centre at the mean of its rows has the inertia
    (squares - |sum|^2 / rows), so no row is needed to know it."""

    def __init__(self, n: np.ndarray, squares: np.ndarray, total: np.ndarray):
        self.n, self.squares, self.total = n, squares, total

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.n + other.n, self.squares + other.squares, self.total + other.total)

    def centres(self, before: np.ndarray) -> np.ndarray:
        """A centre without rows stays where it was."""
        return np.where(self.n[:, None] > 0, self.total / np.maximum(self.n, 1)[:, None], before)

    def inertia(self) -> np.ndarray:
        return np.maximum(self.squares - (self.total ** 2).sum(axis=1) / np.maximum(self.n, 1), 0.0)


class Slots:
    """Where the centres of every class and start are in the list of all centres; shared with the tasks."""

    def __init__(self, keys: np.ndarray, starts: int):
        self.of: dict[int, list[np.ndarray]] = {}
        for class_id in np.unique(keys[:, 0]).tolist():
            self.of[class_id] = [np.flatnonzero((keys[:, 0] == class_id) & (keys[:, 1] == s)) for s in range(starts)]

    def nearest(self, class_id: int, vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, margin) of every vector and start: the nearest centre and how much farther the next one is."""
        slots, margins = [], []
        for own in self.of[class_id]:
            c = centres[own]
            d = np.sqrt(np.maximum((vectors**2).sum(1)[:, None] - 2 * vectors @ c.T + (c**2).sum(1)[None, :], 0.0))
            best = d.argmin(axis=1)
            slots.append(own[best])
            two = np.partition(d, 1, axis=1)
            margins.append(two[:, 1] - two[:, 0])
        return np.stack(slots, axis=1), np.stack(margins, axis=1)


def _assigned(source: DataFrame, slots: Slots, centres: np.ndarray) -> DataFrame:
    """The source with each row's centres (one per start) and margins, sorted by the least of these."""
    shared = source.sparkSession.sparkContext.broadcast((slots, centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, centres = shared.value
        for batch in batches:
            labels, vectors = batch.column("class_id").to_numpy(), _matrix(batch.column("vector"))
            own, margin = (np.zeros((len(labels), len(next(iter(slots.of.values())))), t) for t in (np.int32, np.float64))
            for class_id in np.unique(labels).tolist():
                rows = labels == class_id
                own[rows], margin[rows] = slots.nearest(class_id, vectors[rows], centres)
            offsets = pa.array(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_id"), batch.column("vector"), pa.ListArray.from_arrays(offsets, pa.array(own.ravel())),
                 pa.ListArray.from_arrays(offsets, pa.array(margin.ravel())), pa.array(margin.min(axis=1))],
                ["class_id", "vector", "own", "margin", "least"])

    rows = source.mapInArrow(run, "class_id int, vector array<double>, own array<int>, margin array<double>, least double")
    return stored(rows.sortWithinPartitions("least"), ROW_GROUP_BYTES)


def _sums(rows: DataFrame, n_slots: int, dim: int, added) -> tuple[Sums, int]:
    """What ``added(batch)`` -> (slot, sign, vector) adds up to, and how many rows were read; a row per centre and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, squares, total, read = np.zeros(n_slots, np.int64), np.zeros(n_slots), np.zeros((n_slots, dim)), 0
        for batch in batches:
            read += batch.num_rows
            for slot, sign, vectors in added(batch):
                np.add.at(n, slot, sign)
                np.add.at(squares, slot, sign * (vectors**2).sum(axis=1))
                np.add.at(total, slot, sign[:, None] * vectors)
        used = np.flatnonzero(n.astype(bool) | (squares != 0) | total.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(n[used], read)), pa.array(np.append(squares[used], 0.0)),
             pa.array([*total[used].tolist(), [0.0] * dim], pa.list_(pa.float64()))], ["slot", "n", "squares", "total"])

    found = rows.mapInArrow(run, "slot int, n long, squares double, total array<double>").groupBy("slot").agg(
        F.sum("n").alias("n"), F.sum("squares").alias("squares"), Summarizer.sum(array_to_vector("total")).alias("total")).select(
        "slot", "n", "squares", vector_to_array("total").alias("total")).toArrow()
    out, read = Sums(np.zeros(n_slots, np.int64), np.zeros(n_slots), np.zeros((n_slots, dim))), 0
    if found.num_rows:
        slot, n = found["slot"].to_numpy(), found["n"].to_numpy()
        real = slot >= 0
        read = int(n[~real].sum())
        out.n[slot[real]], out.squares[slot[real]] = n[real], found["squares"].to_numpy()[real]
        out.total[slot[real]] = _matrix(found["total"])[real]
    return out, read


def _lloyd(source: DataFrame, seeds: DataFrame, starts: int) -> pa.Table:
    """Rounds until no class moves; a class that stands still, or gains nothing, is left out of the next pass.

    Rows keep the centre they had when they were written and by how much the next one was farther. Since then no centre
    of their class and start has moved more than d, so rows with a margin above 2d have their centre still: a round reads
    only the others (files are sorted by the margin and skipped by its statistics), finds their centres and adds what
    moved to the sums of the time of writing.
    """
    sc = source.sparkSession.sparkContext
    first = seeds.orderBy("class_id", "start", "centre").toArrow()
    keys = np.stack([first[c].to_numpy() for c in ("class_id", "start", "centre")], axis=1)
    centres = _matrix(first["vector"])
    slots, dim = Slots(keys, starts), centres.shape[1]
    classes = list(slots.of)

    def as_written(batch: pa.RecordBatch):
        vectors, own = _matrix(batch.column("vector")), _list_matrix(batch.column("own"))
        for s in range(own.shape[1]):
            yield own[:, s], np.ones(len(own), np.int64), vectors

    def write(at: np.ndarray) -> tuple[DataFrame, Sums, int]:
        table = _assigned(source, slots, at)
        return table, *_sums(table, len(keys), dim, as_written)

    table, base, n_rows = write(centres)
    written, sums, inertia = centres, base, np.full(len(keys), np.inf)
    moving = dict.fromkeys(classes, True)
    while True:
        moved, now = sums.centres(centres), sums.inertia()
        shift = np.abs(moved - centres).max(axis=1)
        fresh = np.array([moving[c] for c in keys[:, 0].tolist()], bool)        # the sums of the others are old
        now = np.where(fresh, now, inertia)
        for class_id in classes:
            own = keys[:, 0] == class_id
            gain = inertia[own].sum() - now[own].sum()
            moving[class_id] &= bool((shift[own] >= 1e-9).any() and gain > 1e-12 * max(now[own].sum(), 1e-300))
        centres, inertia = np.where(fresh[:, None], moved, centres), now
        if not any(moving.values()):
            break
        drift = np.linalg.norm(centres - written, axis=1)
        limits = {c: np.array([2 * drift[own].max() + SLACK for own in slots.of[c]]) if moving[c] else np.full(starts, -1.0)
                  for c in classes}
        shared = sc.broadcast((slots, centres, limits))

        def changed(batch: pa.RecordBatch, shared=shared):
            slots, centres, limits = shared.value
            labels, vectors = batch.column("class_id").to_numpy(), _matrix(batch.column("vector"))
            before, margin = _list_matrix(batch.column("own")), _list_matrix(batch.column("margin"))
            for class_id in np.unique(labels).tolist():
                rows = np.flatnonzero(labels == class_id)
                rows = rows[(margin[rows] <= limits[class_id]).any(axis=1)]
                if len(rows):
                    after, _ = slots.nearest(class_id, vectors[rows], centres)
                    for s in range(before.shape[1]):
                        other = after[:, s] != before[rows, s]
                        for sign, slot in ((-1, before[rows, s]), (1, after[:, s])):
                            yield slot[other], np.full(int(other.sum()), sign), vectors[rows][other]

        most = max(x.max() for x in limits.values())
        delta, read = _sums(table.filter(F.col("least") <= float(most)), len(keys), dim, changed)
        sums = base + delta
        if read > STALE_SHARE * n_rows:
            discard(table)
            table, base, n_rows = write(centres)
            written, sums = centres, base
    discard(table)
    cost: dict[tuple[int, int], float] = {}
    for (class_id, start, _), value in zip(keys.tolist(), inertia, strict=True):
        cost[class_id, start] = cost.get((class_id, start), 0.0) + value
    best: dict[int, tuple[float, int]] = {}
    for (class_id, start), value in sorted(cost.items()):
        rounded = round(value, 9)
        if class_id not in best or rounded < best[class_id][0]:
            best[class_id] = (rounded, start)
    chosen = [i for i, key in enumerate(keys.tolist()) if best[key[0]][1] == key[1]]
    return pa.table({
        "class_id": pa.array([int(keys[i][0]) for i in chosen], pa.int32()),
        "centre": pa.array([int(keys[i][2]) for i in chosen], pa.int32()),
        "vector": pa.array([centres[i].tolist() for i in chosen], pa.list_(pa.float64())),
    })


def _list_matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def export_rows(prototypes: DataFrame, classes: DataFrame, decimals: int = 4) -> DataFrame:
    """Rows of the published prototype file: names filled in, vectors rounded."""
    named = prototypes.join(classes.select("class_id", "name"), "class_id", "left")
    return named.select(
        "class_id", class_label(F.col("name"), F.col("class_id")).alias("name"), "proto_no",
        F.transform("vector", lambda x: half_even(x.cast("double"), decimals)).alias("vector"),
    )


def export_json(prototypes: DataFrame, classes: DataFrame) -> DataFrame:
    """One JSON object per class: id, name and its vectors in order (a class has few vectors)."""
    rows = export_rows(prototypes, classes)
    per_class = rows.groupBy("class_id", "name").agg(
        F.sort_array(F.collect_list(F.struct("proto_no", "vector"))).alias("_v"))
    vectors = F.transform("_v", lambda p: p["vector"]).alias("vectors")
    return per_class.select(F.to_json(F.struct(F.col("class_id").alias("id"), "name", vectors)).alias("value"))


def nearest_class(vectors: DataFrame, prototypes: DataFrame, keep: list[str]) -> DataFrame:
    """Adds ``predicted``: the class of the most similar prototype, the lowest id on a tie."""
    blocks = PrototypeBlocks(prototypes)
    scored = class_similarities(vectors, blocks, keep)
    best = F.array_position("sims", F.array_max("sims")).cast("int")
    return scored.select(*keep, F.element_at(F.lit(blocks.ids.tolist()).cast("array<int>"), best).alias("predicted"))


def nearest_accuracy(vectors: DataFrame, prototypes: DataFrame, item: str = "vec_id",
                     label: str = "label") -> DataFrame:
    """Share of vectors whose nearest prototype is their own class; NaN without vectors."""
    hit = F.avg((F.col("predicted") == F.col(label)).cast("double"))
    return nearest_class(vectors, prototypes, [item, label]).agg(F.coalesce(hit, F.lit(float("nan"))).alias("accuracy"))


def prototype_offsets(prototypes: DataFrame) -> DataFrame:
    """Start of each class in the concatenated vector list, for the ragged on-disk form."""
    counts = prototypes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    upto = running_totals(counts, [F.col("class_id")], {"_upto": F.col("n")})
    return upto.select("class_id", (F.col("_upto") - F.col("n")).alias("offset"), "n")
