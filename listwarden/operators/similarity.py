"""Match vectors against class prototypes and decide in / out / uncertain.

Prototypes reach the executors as blocks of whole classes, each below a fixed size. One block is the
usual case; with more, a task works through them for every batch and merges running maxima and masses, so no rows
meet again and streams stay append-only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..constants import Params
from ..functions.decisions import platt, verdict
from ..session import BROADCAST_BYTES

CHUNK_CELLS = 4_000_000


class PrototypeBlocks:
    """Prototypes cut into blocks of whole classes: (class ids, unit vectors, first row of each class).

    Sizes are looked up first; the vectors of a block are only fetched when it is its turn.
    """

    def __init__(self, prototypes: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> None:
        self.prototypes = prototypes
        sizes = (
            prototypes.groupBy("class_id")
            .agg((F.count(F.lit(1)) * F.max(F.size("vector")) * 8).alias("bytes"))
            .toPandas().sort_values("class_id")
        )
        self.ids = sizes["class_id"].to_numpy(dtype=np.int32)
        used = sizes["bytes"].to_numpy(dtype=np.int64)
        self._block = (np.cumsum(used) - used) // limit_bytes

    def __iter__(self) -> Iterator[tuple]:
        for number in np.unique(self._block):
            inside = self.ids[self._block == number]
            rows = (
                self.prototypes.filter(F.col("class_id").between(int(inside[0]), int(inside[-1])))
                .select("class_id", F.col("vector").cast("array<double>").alias("vector"), "proto_no")
                .toArrow().sort_by([("class_id", "ascending"), ("proto_no", "ascending")])
            )
            owner = rows["class_id"].to_numpy()
            vectors = _matrix(rows["vector"])
            vectors = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            yield owner[starts].astype(np.int32), vectors, starts


def as_blocks(prototypes: DataFrame | PrototypeBlocks, limit_bytes: int) -> PrototypeBlocks:
    return prototypes if isinstance(prototypes, PrototypeBlocks) else PrototypeBlocks(prototypes, limit_bytes)


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of one length; null or ragged vectors, or vectors of another length than the prototypes, are an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width or 1))
    sizes = column.value_lengths()
    if sizes.null_count or column.flatten().null_count:
        raise ValueError("null vector or component")
    sizes = sizes.to_numpy()
    if (sizes != (sizes[0] if width is None else width)).any():
        raise ValueError(f"vectors of unequal length: {sorted(set(sizes.tolist()))[:5]}, expected {width or int(sizes[0])}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), int(sizes[0]))


def _class_scores(vectors: np.ndarray, block: tuple) -> np.ndarray:
    _, prototypes, starts = block
    if prototypes is None:          # compared already
        return vectors
    return np.maximum.reduceat(vectors @ prototypes.T, starts, axis=1)


def _fields(df: DataFrame, names: list[str]) -> list:
    return [df.schema[n] for n in names]


def class_similarities(df: DataFrame, prototypes: DataFrame | PrototypeBlocks, keep: list[str],
                       vector: str = "embedding", limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Adds ``sims``: the best cosine per class, in ascending class order. Rows without a vector are left out.

    A task goes through the blocks one after the other for every batch, so the number of blocks changes nothing.
    """
    sc = df.sparkSession.sparkContext
    schema = StructType(_fields(df, keep)).add("sims", ArrayType(DoubleType()))
    shared = [sc.broadcast(block) for block in as_blocks(prototypes, limit_bytes)]
    rows = df.filter(F.col(vector).isNotNull()).select(*keep, vector)
    if not shared:
        return rows.select(*keep, F.array().cast("array<double>").alias("sims"))
    return rows.mapInArrow(_similarity_job(shared, keep, vector), schema)


def _similarity_job(shared: list[Broadcast], keep: list[str], vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = _matrix(batch.column(vector), shared[0].value[1].shape[1])
            scores = np.concatenate([_class_scores(vectors, b.value) for b in shared], axis=1)
            width = scores.shape[1]
            offsets = pa.array(np.arange(0, scores.size + 1, width, dtype=np.int32))
            sims = pa.ListArray.from_arrays(offsets, pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [sims], [*keep, "sims"])
    return run


def class_slots(class_ids: list[int], listed: Column) -> Column:
    """Positions of the listed classes among the sorted class ids; unknown ids are ignored."""
    ids = F.lit(class_ids).cast("array<int>")
    known = F.array_intersect(listed.cast("array<int>"), ids)
    return F.sort_array(F.transform(known, lambda c: F.array_position(ids, c).cast("int") - 1))


PARTIAL = "top DOUBLE, mass DOUBLE, listed_mass DOUBLE, s_in DOUBLE, best_listed INT, s_out DOUBLE, best_any INT"


def judge(df: DataFrame, prototypes: DataFrame | PrototypeBlocks, params: Params, keep: list[str],
          vector: str = "embedding", lists: str = "lists", limit_bytes: int = BROADCAST_BYTES,
          compared: bool = False) -> DataFrame:
    """Decide every vector against each of its allow-lists.

    ``lists`` is an array of (list_id, listed): the vector is compared with the prototypes once however
    many lists it is checked against. One output row per vector and list. A vector that is ``compared`` already holds its
    similarities to all classes, as ``class_similarities`` gives them.
    """
    sc = df.sparkSession.sparkContext
    schema = StructType(_fields(df, keep)).add(df.schema[lists].dataType.elementType["list_id"])
    for field in StructType.fromDDL(PARTIAL).fields:
        schema = schema.add(field)
    source = df.filter(F.col(vector).isNotNull()).select(*keep, vector, lists)
    blocks = as_blocks(prototypes, limit_bytes)
    if compared:
        blocks = [(blocks.ids, None, None)] if len(blocks.ids) else []
    shared = [sc.broadcast(block) for block in blocks]
    if not shared:
        empty = source.select(*keep, F.explode(lists).alias("_l")).select(*keep, "_l.list_id")
        for field in StructType.fromDDL(PARTIAL).fields:
            empty = empty.withColumn(field.name, F.lit(None).cast(field.dataType))
        return _finish(empty, params, keep)
    return _finish(source.mapInArrow(_judge_job(shared, keep, vector, lists, params.temperature), schema), params, keep)


def _finish(partial: DataFrame, params: Params, keep: list[str]) -> DataFrame:
    top, bias, temperature = F.col("top"), params.unknown_bias, params.temperature
    if bias is None:
        total = F.col("mass")
        p_raw, unknown = F.col("listed_mass") / total, F.lit(None).cast("double")
    else:
        peak = F.greatest(top, F.lit(bias))
        scale = F.coalesce(F.exp((top - peak) / temperature), F.lit(0.0))
        own = F.exp((F.lit(bias) - peak) / temperature)
        total = F.coalesce(F.col("mass"), F.lit(0.0)) * scale + own
        p_raw, unknown = F.coalesce(F.col("listed_mass"), F.lit(0.0)) * scale / total, own / total
    s_in, s_out = F.coalesce("s_in", F.lit(-1.0)), F.coalesce("s_out", F.lit(-1.0))
    decided = partial.select(
        *keep, "list_id", platt(p_raw, params.platt_a, params.platt_b).alias("p_in"), unknown.alias("p_unknown"),
        s_in.alias("s_in"), s_out.alias("s_out"), "best_listed", "best_any", (s_in - s_out).alias("margin"),
    )
    return decided.withColumn("verdict", verdict(F.col("p_in"), F.col("margin"), params))


def _judge_job(shared: list[Broadcast], keep: list[str], vector: str, lists: str, temperature: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_at_once = max(1, CHUNK_CELLS // max(len(b.value[0]) for b in shared))
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                yield _judge_chunk(batch.slice(start, rows_at_once), shared, keep, vector, lists, temperature)
    return run


def _block_scores(vectors: np.ndarray, block: tuple, owner: np.ndarray, checks: np.ndarray, wanted: np.ndarray,
                  n_checks: int, temperature: float) -> dict[str, np.ndarray]:
    """Partial results of every check against one block; scores that do not exist are minus infinity."""
    class_ids = block[0]
    sims = _class_scores(vectors, block)
    top = sims.max(axis=1)
    weights = np.exp((sims - top[:, None]) / temperature)
    slot = np.minimum(np.searchsorted(class_ids, wanted), len(class_ids) - 1)
    known = class_ids[slot] == wanted
    mask = np.zeros((n_checks, len(class_ids)), dtype=bool)
    mask[checks[known], slot[known]] = True
    scores = sims[owner]
    inside = np.where(mask, scores, -np.inf)
    return {"top": top[owner], "mass": weights.sum(axis=1)[owner], "listed_mass": (weights[owner] * mask).sum(axis=1),
            "s_in": inside.max(axis=1), "best_listed": class_ids[inside.argmax(axis=1)],
            "s_out": np.where(mask, -np.inf, scores).max(axis=1), "best_any": class_ids[sims.argmax(axis=1)][owner]}


def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray], temperature: float) -> dict[str, np.ndarray]:
    """Two blocks as if they were one; the first holds the lower class ids, which win ties."""
    top = np.maximum(a["top"], b["top"])
    scale = [np.exp((x["top"] - top) / temperature) for x in (a, b)]
    return {"top": top, **{m: a[m] * scale[0] + b[m] * scale[1] for m in ("mass", "listed_mass")},
            "s_in": np.maximum(a["s_in"], b["s_in"]), "s_out": np.maximum(a["s_out"], b["s_out"]),
            "best_listed": np.where(b["s_in"] > a["s_in"], b["best_listed"], a["best_listed"]),
            "best_any": np.where(b["top"] > a["top"], b["best_any"], a["best_any"])}


def _judge_chunk(batch: pa.RecordBatch, shared: list[Broadcast], keep: list[str], vector: str, lists: str,
                 temperature: float) -> pa.RecordBatch:
    ids, prototypes, _ = shared[0].value
    vectors = _matrix(batch.column(vector), len(ids) if prototypes is None else prototypes.shape[1])
    column = batch.column(lists)
    owner = np.repeat(np.arange(batch.num_rows), column.value_lengths().fill_null(0).to_numpy())
    nested = column.flatten()
    fields = dict(zip([f.name for f in nested.type], nested.flatten()))
    listed = fields["listed"]
    checks = np.repeat(np.arange(len(nested)), listed.value_lengths().fill_null(0).to_numpy())
    wanted = listed.flatten().to_numpy(zero_copy_only=False)
    found: dict[str, np.ndarray] | None = None
    for block in shared:
        part = _block_scores(vectors, block.value, owner, checks, wanted, len(nested), temperature)
        found = part if found is None else _merged(found, part, temperature)
    any_in, any_out = np.isfinite(found["s_in"]), np.isfinite(found["s_out"])
    absent = {"s_in": ~any_in, "best_listed": ~any_in, "s_out": ~any_out}
    names = ["top", "mass", "listed_mass", "s_in", "best_listed", "s_out", "best_any"]
    results = [pa.array(found[n], mask=absent.get(n)) for n in names]
    kept = [batch.column(k).take(pa.array(owner)) for k in keep]
    return pa.RecordBatch.from_arrays([*kept, fields["list_id"], *results], [*keep, "list_id", *names])
