"""Calibration of p_in: likelihood, calibration error, and the fits of its parameters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..constants import CALIBRATION_BINS, TRAINING_SCALE, Params
from ..functions.decisions import platt
from ..session import discard, stored
from .scenarios import judged_items
from .similarity import CHUNK_CELLS, PrototypeBlocks, _matrix, class_similarities, class_slots


def clipped_nll(p: Column, y: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.avg(-(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q)))


def bin_edge(index: Column, bins: int = CALIBRATION_BINS) -> Column:
    return F.when(index == bins, F.lit(1.0)).otherwise(index.cast("double") * F.lit(1.0 / bins))


def bin_of(p: Column, bins: int = CALIBRATION_BINS) -> Column:
    """Bins are (lo, hi]; the first also holds 0. The guess is corrected against the edges themselves."""
    guess = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(p * bins))).cast("int")
    return (F.when((guess > 1) & (p <= bin_edge(guess - 1, bins)), guess - 2)
            .when((guess < bins) & (p > bin_edge(guess, bins)), guess).otherwise(guess - 1))


def calibration_bins(df: DataFrame, p: str = "p_in", y: str = "y_in", bins: int = CALIBRATION_BINS,
                     by: list[str] | None = None) -> DataFrame:
    """(bin, lo, hi, n, conf, acc); an empty bin has n = 0 and nulls."""
    keys = by or []
    filled = df.groupBy(*keys, bin_of(F.col(p), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    spark = df.sparkSession
    if keys:
        frame = filled.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
                                                       .alias("bin"))
    else:
        frame = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(filled, [*keys, "bin"], "left").select(
        *keys, "bin", bin_edge(F.col("bin"), bins).alias("lo"), bin_edge(F.col("bin") + 1, bins).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"), "conf", "acc")


def calibration_error(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = by or []
    weighted = F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.greatest(F.lit(1), F.sum("n"))
    return binned.groupBy(*keys).agg(F.coalesce(weighted, F.lit(0.0)).alias("ece"))


def reliability(binned: DataFrame) -> DataFrame:
    return binned.filter("n > 0").select("bin", ((F.col("lo") + F.col("hi")) / 2).alias("centre"),
                                         F.col("acc").alias("share"), "n")


def calibration_set(told: DataFrame | tuple[DataFrame, DataFrame, DataFrame], vectors: DataFrame, prototypes: DataFrame,
                    key: str) -> DataFrame:
    """(scenario_id, item key, sims, slots, y_in, seen, reason) for items that have a vector.

    Similarities are computed once per vector and meet the scenarios afterwards. ``told`` comes one row per scenario item,
    or as (items, nested scenarios, unseen classes): then items meet similarities before they are spread over scenarios.
    """
    blocks = PrototypeBlocks(prototypes)
    return _scenario_rows(told, class_similarities(vectors, blocks, [key]), blocks.ids.tolist(), key, ["sims"])


def calibration_probabilities(told: DataFrame | tuple[DataFrame, DataFrame, DataFrame], vectors: DataFrame,
                              prototypes: DataFrame, key: str, variants: dict[str, Params]) -> DataFrame:
    """The calibration set with one probability column per parameter set in place of ``sims`` and ``slots``.

    The weights of a softmax are made once per vector; a scenario row only adds up those of its listed classes.
    """
    blocks = PrototypeBlocks(prototypes)
    names, settings = list(variants), list(variants.values())
    softmax = [(p.temperature, p.unknown_bias) for p in settings]
    first = [softmax.index(s) for s in softmax]
    weighed = class_weights(class_similarities(vectors, blocks, [key]), [key], {f"_{i}": settings[i] for i in sorted(set(first))})
    rows = _scenario_rows(told, weighed, blocks.ids.tolist(), key, [c for c in weighed.columns if c != key])

    def listed(i: int) -> Column:
        return F.aggregate("slots", F.lit(0.0), lambda t, s: t + F.get(F.col(f"_{i}_weights"), s)) / F.col(f"_{i}_total")

    keep = ["scenario_id", "photo_id", "item_idx", "y_in", "seen", "reason"]
    raw = rows.select(*keep, *[listed(i).alias(f"_{i}") for i in sorted(set(first))])
    return raw.select(*keep, *[platt(F.col(f"_{i}"), p.platt_a, p.platt_b).alias(n) for n, p, i in zip(names, settings, first)])


def _scenario_rows(told: DataFrame | tuple[DataFrame, DataFrame, DataFrame], scored: DataFrame, classes: list[int], key: str,
                   carried: list[str]) -> DataFrame:
    """Items with the ``carried`` columns of their vector, spread over scenarios; unlisted ones are left out."""
    if isinstance(told, tuple):
        items, nested, unseen = told
        met = items.select("photo_id", "item_idx", "label", key).join(nested.drop("allowlist_id"), "photo_id")
        joined = judged_items(met.join(scored, key), unseen).filter(F.col("reason") != "unlisted")
    else:
        joined = told.filter(F.col("reason") != "unlisted").join(scored, key)
    return joined.select(
        "scenario_id", "photo_id", "item_idx", *carried, class_slots(classes, F.col("listed")).alias("slots"),
        (F.col("gt") == "in").cast("int").alias("y_in"),
        F.array_contains(F.lit(classes).cast("array<int>"), F.col("label")).alias("seen"), "reason")


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, similarities, listed mask) of the batch, in pieces of bounded size."""
    sims = _matrix(batch.column("sims"))
    at_once = max(1, CHUNK_CELLS // max(1, sims.shape[1]))
    for start in range(0, batch.num_rows, at_once):
        part = sims[start:start + at_once]
        slots = batch.column("slots").slice(start, at_once)
        owner = np.repeat(np.arange(len(part)), slots.value_lengths().fill_null(0).to_numpy())
        mask = np.zeros(part.shape, dtype=bool)
        mask[owner, slots.flatten().to_numpy(zero_copy_only=False)] = True
        yield start, part, mask


def _weights(sims: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """Softmax weights of the classes and their sum, the unknown class included."""
    if sims.shape[1] == 0:
        return sims, np.ones(len(sims))
    best = sims.max(axis=1)
    e = np.exp((sims - best[:, None]) / params.temperature)
    total = e.sum(axis=1)
    if params.unknown_bias is not None:
        # A bias far above every similarity overflows to infinity, which is p = 0.
        with np.errstate(over="ignore"):
            total = total + np.exp((params.unknown_bias - best) / params.temperature)
    return e, total


def _listed_share(sims: np.ndarray, mask: np.ndarray, params: Params) -> np.ndarray:
    e, total = _weights(sims, params)
    return (e * mask).sum(axis=1) / total


def class_weights(similarities: DataFrame, keep: list[str], variants: dict[str, Params]) -> DataFrame:
    """Replace ``sims`` by ``<name>_weights`` and ``<name>_total`` per parameter set."""
    schema = StructType([similarities.schema[c] for c in keep])
    for name in variants:
        schema = schema.add(f"{name}_weights", ArrayType(DoubleType())).add(f"{name}_total", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column("sims")
            sims = _matrix(column) if len(column.flatten()) else np.zeros((batch.num_rows, 0))
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * sims.shape[1], pa.int32())
            found = []
            for params in variants.values():
                e, total = _weights(sims, params)
                found += [pa.ListArray.from_arrays(offsets, pa.array(e.ravel())), pa.array(total)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *found], names=schema.names)

    return similarities.select(*keep, "sims").mapInArrow(run, schema)


def with_probabilities(calibration: DataFrame, variants: dict[str, Params]) -> DataFrame:
    """Replace ``sims`` and ``slots`` by one probability column per parameter set.

    The softmax runs on Arrow batches; the sigmoid stays a column expression.
    """
    keep = [c for c in calibration.columns if c not in ("sims", "slots")]
    scored = with_shares(calibration, variants)
    return scored.select(*keep, *[platt(F.col(n), p.platt_a, p.platt_b).alias(n) for n, p in variants.items()])


def with_shares(calibration: DataFrame, variants: dict[str, Params]) -> DataFrame:
    """Replace ``sims`` and ``slots`` by the softmax mass of the listed classes per parameter set, before any sigmoid."""
    keep = [c for c in calibration.columns if c not in ("sims", "slots")]
    names = list(variants)
    settings = list(variants.values())
    # The softmax of two variants that differ in their sigmoid only is computed once.
    softmax = [(p.temperature, p.unknown_bias) for p in settings]
    first = [softmax.index(s) for s in softmax]
    schema = StructType([calibration.schema[c] for c in keep] + [StructField(n, DoubleType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            shares = np.empty((len(settings), batch.num_rows))
            for start, sims, mask in _arrays(batch):
                for i, same in enumerate(first):
                    part = slice(start, start + len(sims))
                    shares[i, part] = shares[same, part] if same < i else _listed_share(sims, mask, settings[i])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(s) for s in shares],
                                             keep + names)

    return calibration.select(*keep, "sims", "slots").mapInArrow(run, schema)


def with_p_in(calibration: DataFrame, params: Params, name: str = "p_in") -> DataFrame:
    return with_probabilities(calibration, {name: params})


def before_params() -> Params:
    """The network's own training softmax: no unknown class."""
    return Params(temperature=1.0 / TRAINING_SCALE, unknown_bias=None)


def calibration_report(calibration: DataFrame, after: Params, before: Params | None = None) -> DataFrame:
    """(phase, n, nll, ece) before and after, from one pass over the set."""
    before = before or before_params()
    scored = with_probabilities(calibration.select("y_in", "sims", "slots"), {"_before": before, "_after": after})
    both = scored.select("y_in", F.explode(F.array(
        F.struct(F.lit("before").alias("phase"), F.col("_before").alias("p_in")),
        F.struct(F.lit("after").alias("phase"), F.col("_after").alias("p_in")),
    )).alias("_r")).select("y_in", "_r.phase", "_r.p_in")
    y = F.col("y_in").cast("double")
    terms = both.groupBy("phase", bin_of(F.col("p_in")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_in").alias("_p"), F.sum(y).alias("_y"),
        (clipped_nll(F.col("p_in"), y) * F.count(F.lit(1))).alias("_nll"))
    return terms.groupBy("phase").agg(
        F.sum("n").alias("n"), (F.sum("_nll") / F.sum("n")).alias("nll"),
        (F.sum(F.abs(F.col("_p") - F.col("_y"))) / F.sum("n")).alias("ece"))


# Probabilities are clipped for the loss; a clipped row is constant.
CLIP = 1e-7
# Fitted points stay where a softmax of cosines means something: temperatures of some 0.001 to 50.
LOG_T_RANGE = (-7.0, 4.0)


def _log_mass(mass: np.ndarray, first: np.ndarray, square: np.ndarray, u: np.ndarray, zu: float, t: float) -> np.ndarray:
    """Derivatives by (log T, bias) of the logarithm of a sum of exponentials: two first, three second ones.

    ``mass``, with the unknown class in it, is the sum; ``first`` and ``square`` are the sums of the classes' weights times
    their exponents and squared exponents; ``u`` and ``zu`` are weight and exponent of the unknown class (u = 0: not in
    the sum). Derivatives are means and covariances under the softmax of the sum.
    """
    mean, square, share = (first + u * zu) / mass, (square + u * zu * zu) / mass, u / mass
    return np.stack([-mean, share / t, mean + square - mean * mean, share / t * (mean - 1 - zu), share * (1 - share) / (t * t)])


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of row, and the place among those of every row's kind. A clash of hashes keeps all rows."""
    h = np.zeros(len(rows), np.uint64)
    for column in np.ascontiguousarray(rows).view(np.uint64).T:
        h = (h ^ column) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, first, place = np.unique(h, return_index=True, return_inverse=True)
    if not (rows[first[place]] == rows).all():
        first = place = np.arange(len(rows))
    return first, place


def _block(s: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the loss reads of some rows: similarities that differ (the scenarios of an item share theirs), and per row which
    of them, the classes whose probability counts, whether the unknown class is one of them, and how much it counts."""
    first, place = _distinct(s)
    yes, no = np.flatnonzero(y != 0), np.flatnonzero(y != 1)
    return (s[first], np.concatenate([place[yes], place[no]]), np.concatenate([mask[yes], ~mask[no]]),
            np.repeat([0.0, 1.0], [len(yes), len(no)]), np.concatenate([y[yes], 1 - y[no]]))


def _block_terms(s: np.ndarray, owner: np.ndarray, side: np.ndarray, unknown: np.ndarray, weight: np.ndarray,
                 points: list[tuple[float, float]], second: bool) -> np.ndarray:
    """Summed loss of a block at every point and, if asked for, its two first and three second derivatives.

    Weights of classes are made once per temperature and once for rows that share their similarities.
    """
    out = np.zeros((len(points), 6))
    if not s.shape[1]:
        out[:, 0] = -(weight * np.log(np.clip(unknown, CLIP, 1 - CLIP))).sum()
        return out
    best, side = s.max(axis=1), side.astype(float)
    for log_t in dict.fromkeys(x for x, _ in points):
        t = math.exp(log_t)
        sums = [np.exp((s - best[:, None]) / t)]
        if second:
            sums += [sums[0] * (s / t), sums[0] * (s / t) ** 2]
        whole = [x.sum(axis=1) for x in sums]
        own = [np.einsum("ij,ij->i", x[owner], side) for x in sums]
        for k, bias in ((k, b) for k, (x, b) in enumerate(points) if x == log_t):
            u = np.exp(np.minimum((bias - best) / t, 500.0))        # far above every similarity: p = 0 either way
            total, mine = whole[0] + u, u[owner] * unknown
            mass = own[0] + mine
            p = mass / total[owner]
            out[k, 0] = -(weight * np.log(np.clip(p, CLIP, 1 - CLIP))).sum()
            if second:
                inside = (p > CLIP) & (p < 1 - CLIP)
                w, mass = np.where(inside, weight, 0.0), np.where(inside, mass, 1.0)
                out[k, 1:] = (_log_mass(total, *whole[1:], u, bias / t, t) @ np.bincount(owner, w, len(s))
                              - _log_mass(mass, *own[1:], mine, bias / t, t) @ w)
    return out


def _point_terms(s: np.ndarray, mask: np.ndarray, y: np.ndarray, log_t: float, bias: float, second: bool) -> np.ndarray:
    """Summed loss of some rows at one point and, if asked for, its two first and three second derivatives."""
    return _block_terms(*_block(s, mask, y), [(log_t, bias)], second)[0]


BLOCK = {"sims": np.float64, "owner": np.int32, "side": np.uint8, "unknown": np.float64, "weight": np.float64}


def _blocks(calibration: DataFrame) -> DataFrame:
    """The set as the passes of a fit read it, written once: a row holds a block of bounded size in a few binary columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            truth = batch.column("y_in").to_numpy(zero_copy_only=False).astype(float)
            for start, s, mask in _arrays(batch):
                s, owner, side, unknown, weight = _block(s, mask, truth[start:start + len(s)])
                parts = (s, owner, np.packbits(side, axis=1), unknown, weight)
                packed = [np.ascontiguousarray(p, kind).tobytes() for p, kind in zip(parts, BLOCK.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.shape[1]], pa.int32()), pa.array([len(mask)], pa.int64()), *[pa.array([p], pa.binary()) for p in packed]],
                    ["classes", "n", *BLOCK])

    return stored(calibration.select("sims", "slots", "y_in").mapInArrow(
        run, "classes int, n long, " + ", ".join(f"{c} binary" for c in BLOCK)))


def _terms(blocks: DataFrame, points: np.ndarray, second: bool = True) -> np.ndarray:
    """Mean loss, gradient (2) and Hessian (3) at every (log temperature, bias) point, from one pass: a task adds up its
    blocks and returns one row per point."""
    shared = blocks.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [tuple(p) for p in shared.value.tolist()]
        sums, rows = np.zeros((len(own), 6)), 0
        for batch in batches:
            for i in range(batch.num_rows):
                classes = batch.column("classes")[i].as_py()
                s, owner, side, unknown, weight = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in BLOCK.items())
                side = np.unpackbits(side.reshape(len(owner), -(-classes // 8)), axis=1, count=classes)
                s = s.reshape(-1, classes) if classes else np.zeros((1, 0))
                sums += _block_terms(s, owner, side, unknown, weight, own, second)
                rows += batch.column("n")[i].as_py()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(own), dtype=np.int32)), *map(pa.array, sums.T), pa.array([rows] * len(own), pa.int64())],
            ["point", *TERMS, "n"])

    totals = (
        blocks.mapInArrow(run, f"point int, {', '.join(f'{t} double' for t in TERMS)}, n long")
        .groupBy("point").agg(*[(F.sum(t) / F.greatest(F.lit(1), F.sum("n"))).alias(t) for t in TERMS])
        .orderBy("point").toArrow()
    )
    return np.stack([totals[t].to_numpy() for t in TERMS], axis=1) if totals.num_rows else np.zeros((len(points), 6))


TERMS = ("loss", "g_t", "g_b", "h_tt", "h_tb", "h_bb")


def trust_step(gradient: np.ndarray, hessian: np.ndarray, reach: float) -> tuple[np.ndarray, float]:
    """The step that lowers the quadratic model most within ``reach``, and by how much (positive)."""
    values, axes = np.linalg.eigh(hessian)
    g = axes.T @ gradient

    def step(shift: float) -> np.ndarray:
        bent = values + shift
        return -np.divide(g, bent, out=np.zeros_like(g), where=np.abs(bent) > 1e-300)

    low = max(0.0, -float(values[0]) + 1e-12)
    if values[0] > 0 and np.linalg.norm(step(0.0)) <= reach:
        best = step(0.0)
    else:
        high = low + np.linalg.norm(g) / reach + 1e-12
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if np.linalg.norm(step(middle)) > reach else (low, middle)
        best = step(high)
        if np.linalg.norm(best) < 0.99 * reach and values[0] < 0:       # along the most bent axis up to the rim
            best[0] += math.copysign(math.sqrt(max(reach**2 - best @ best, 0.0)), -g[0])
    gain = -(g @ best + 0.5 * (values * best) @ best)
    return axes @ best, float(gain)


def fit_temperature_and_bias(calibration: DataFrame, init: Params | None = None, tolerance: float = 1e-7,
                             side: int = 7, stored: bool = False, n_starts: int = 4, rounds: int = 60) -> Params:
    """Minimise the loss over (log T, bias) by Newton steps in a trust region, from several points at once.

    Loss, gradient and Hessian are sums over rows, so every round is one pass that returns a handful of numbers per task
    for all starts together. A first pass looks at the losses of a grid of ``side`` x ``side`` points and of the starting
    points (0.05, 0.5), (0.1, 0.3), (0.02, 0.7) and ``init``; the ``n_starts`` best go on. A start is done when the model
    promises no gain or its region is smaller than ``tolerance``. The set is read once, whether it is ``stored`` or not, and
    the passes read blocks made of it. An empty set returns the first starting point's neighbourhood: there is nothing to fit.
    """
    blocks = _blocks(calibration)
    init = init or Params()
    bias = Params().unknown_bias if init.unknown_bias is None else init.unknown_bias
    starts = [(math.log(init.temperature), bias), (math.log(0.05), 0.5), (math.log(0.1), 0.3), (math.log(0.02), 0.7)]
    axes = [np.linspace(c - r, c + r, side) for c, r in ((math.log(0.06), 1.6), (0.4, 0.8))]
    grid = np.array([*starts, *((float(a), float(b)) for a in axes[0] for b in axes[1])])
    at = grid[np.argsort(_terms(blocks, grid, second=False)[:, 0], kind="stable")[:n_starts]]
    now, reach = _terms(blocks, at), np.full(len(at), 0.5)
    for _ in range(rounds):
        steps = [trust_step(f[1:3], np.array([[f[3], f[4]], [f[4], f[5]]]), r) for f, r in zip(now, reach, strict=True)]
        live = np.flatnonzero([gain > 1e-15 and r > tolerance for (_, gain), r in zip(steps, reach, strict=True)])
        if not len(live):
            break
        trial = np.array([at[i] + steps[i][0] for i in live])
        trial[:, 0] = np.clip(trial[:, 0], *LOG_T_RANGE)
        for i, x, f in zip(live, trial, _terms(blocks, trial), strict=True):
            length, ratio = float(np.linalg.norm(steps[i][0])), (now[i, 0] - f[0]) / steps[i][1]
            if ratio < 0.25:
                reach[i] = length / 4
            elif ratio > 0.75 and length > 0.9 * reach[i]:
                reach[i] = min(2 * reach[i], 2.0)
            if f[0] < now[i, 0]:
                at[i], now[i] = x, f
    discard(blocks)
    best = at[int(now[:, 0].argmin())]
    return init.with_(temperature=math.exp(best[0]), unknown_bias=float(best[1]), platt_a=1.0, platt_b=0.0)


def fit_platt(df: DataFrame, p: str = "p_in", y: str = "y_in", eps: float = 1e-6, rounds: int = 60) -> tuple[float, float]:
    """(a, b) of sigmoid(a * logit(p) + b), an unpenalised logistic regression on one feature.

    Newton steps from the identity, halved while they do not help; a round is six sums over a narrow table written once.
    With nothing to tell a and b apart (no rows, or one value of p) the identity, or the last point reached, stays.
    """
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(p)))
    points = stored(df.select(F.log(q / (F.lit(1.0) - q)).alias("x"), F.col(y).cast("double").alias("y")))
    x, truth = F.col("x"), F.col("y")
    now, step, loss = np.array([1.0, 0.0]), np.zeros(2), math.inf
    for _ in range(rounds):
        at = now + step
        z = at[0] * x + F.lit(float(at[1]))
        share = 1 / (1 + F.exp(-z))
        bend = share * (1 - share)
        # log(1 + exp(z)) without overflow, less what the true class takes off.
        cost = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - truth * z
        found = points.agg(*map(F.sum, (x * (truth - share), truth - share, bend * x * x, bend * x, bend, cost))).first()
        if found[0] is None:
            break
        if found[5] > loss + 1e-9 * abs(loss):
            step = step / 2
            continue
        g1, g2, h11, h12, h22, loss = found
        now, flat = at, h11 * h22 - h12 * h12
        if flat <= 1e-12 * max(h11 * h22, 1e-300):
            break
        step = np.array([h22 * g1 - h12 * g2, h11 * g2 - h12 * g1]) / flat
        if np.abs(step).max() < 1e-10:
            break
    discard(points)
    return float(now[0]), float(now[1])
