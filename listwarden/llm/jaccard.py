"""Exact Jaccard join of shingle sets: pivots make regions, triangle-inequality windows bound what is compared in them.

Every prefix shingle of a set is a seat; two sets that link meet at a seat with a bounded sum of their places there.
The most central set of a seat becomes a pivot and every member that may link with it is measured; what falls into one
component needs no more comparison among itself. That repeats with new pivots while components keep growing. Then each
set belongs to the largest region (Voronoi cell) among the pivots that it is near to. Regions are joined in bands of the
distance to their pivot: by the triangle inequality a set is only copied to its own band and those next to it, and a
block of two bands is compared inside one task. Sets of different regions are compared where they meet at a seat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import discard, forget, hash_sample, kept, possibly_in, row_key, stored, sweep, whole_groups
from .graph import components

# Shingles in HOT_DOCS or more of about SAMPLE_DOCS documents come last in the order of shingles (HOT_SHINGLES at most).
# Which shingles these are affects the work only, never the result.
SAMPLE_DOCS, HOT_DOCS, HOT_SHINGLES = 4000, 8, 50_000
CHUNK_CHARS, CACHE_WORDS, PAIRS_PER_TASK = 2_000_000, 300_000, 2_000
# A pivot's region holds sets up to this distance; regions of fewer sets are left to the seats. Sets of a block.
REACH, LEAST_REGION, TILE, COLUMNS = 0.5, 32, 256, 8192
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
CLASS_SHIFT = np.uint64(58)
# Shingles to a class of the finer counts: sets of other texts then lie further apart in them than a link allows.
CLASS_SHINGLES = 12


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * B
    x = (x ^ (x >> np.uint64(27))) * C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words make one shingle, no word makes none.

    A-Z are lower-cased; words lie between ASCII white space.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    known = kept("words", dict)
    if len(known) > CACHE_WORDS:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(width, len(h))
    out = np.full(max(0, len(h) - span + 1) if span else 0, span, np.uint64)
    for k in range(span):
        out = mixed(out * A + h[k:len(h) - span + 1 + k])
    return np.unique(out)


def needed(percent: int, n: np.ndarray | int) -> np.ndarray | int:
    """Smallest overlap with which a set of n can link at all."""
    return -(-percent * n // 100)


def room(percent: int, a: Column, b: Column) -> Column:
    """Most shingles that two linked sets of these sizes have apart from each other, both sides together."""
    return F.floor((100 - percent) * (a + b) / (100 + percent))


def ordered(found: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Shingles in the global order: by hash, the frequent ones last. 63 bits of the hash remain."""
    return np.sort((found >> np.uint64(1)) | np.where(np.isin(found, hot), np.uint64(1) << np.uint64(63), np.uint64(0)))


def frequent(docs: DataFrame, width: int) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"s": shingles(text, width).view(np.int64)})

    sample = hash_sample(docs, SAMPLE_DOCS, "row").select("text")
    rows = sample.mapInPandas(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= HOT_DOCS).orderBy(F.desc("n"), "s").limit(HOT_SHINGLES).toPandas()
    return np.sort(rows["s"].to_numpy(np.int64).view(np.uint64))


def fine_counts(found: np.ndarray) -> bytes:
    """Shingles, mixed, per class of their first bits, 255 at most: 64 classes, in large sets as many as keep them small."""
    bits = max(6, int(np.ceil(np.log2(max(1, len(found)) / CLASS_SHINGLES))))
    return np.minimum(np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """What two sets lie apart at least, by their finer counts."""
    a, b = sorted((np.frombuffer(x, np.uint8).astype(np.int64) for x in (a, b)), key=len)
    return int(np.abs(np.minimum(b.reshape(len(a), -1).sum(axis=1), 255) - a).sum())


def sketches(docs: DataFrame, hot: np.ndarray, width: int, percent: int) -> DataFrame:
    """(row, doc_id, n, x, y, prefix, counts, fine) of every text: size of its set, two checksums, the first shingles in the
    global order, shingles per hash class, and those per finer class."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)       # HOT_SHINGLES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i, j in chunks([t or "" for t in texts], CHUNK_CHARS):
                sets = [ordered(shingles(t, width), shared.value) for t in texts[i:j]]
                n = np.fromiter(map(len, sets), np.int64, j - i)
                keep = np.where(n > 0, n - needed(percent, n) + 1, 0)
                x = [int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in sets]
                spread = [mixed(s) for s in sets]
                y = [int(s.sum(dtype=np.uint64)) if len(s) else 0 for s in spread]
                prefix = np.concatenate([s[:k] for s, k in zip(sets, keep, strict=True)] or [np.zeros(0, np.uint64)])
                counts = np.concatenate([np.bincount((s >> CLASS_SHIFT).astype(np.int64), minlength=64) for s in spread])
                counts = np.minimum(counts, 32767).astype(np.int16)
                fine = [fine_counts(s) for s in spread]
                offsets = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n),
                     pa.array(np.array(x, np.uint64).view(np.int64)), pa.array(np.array(y, np.uint64).view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, 64 * (j - i) + 1, 64, dtype=np.int32)), pa.array(counts)),
                     pa.array(fine, pa.binary())],
                    names=["row", "doc_id", "n", "x", "y", "prefix", "counts", "fine"])
        forget()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("row", "doc_id", "text").mapInArrow(
        run, f"row long, doc_id {kind}, n long, x long, y long, prefix array<long>, counts array<smallint>, fine binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(rep, shingles) of the wanted (rep, row), from their texts. Only texts that may be wanted are shuffled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, j in chunks(batch["text"].tolist(), CHUNK_CHARS):
                part = batch.iloc[i:j]
                yield pd.DataFrame({"rep": part["rep"], "shingles": [shingles(t, width).tobytes() for t in part["text"]]})
        forget()

    near = possibly_in(docs.select(F.col("row").alias("at"), "text"), "at", wanted, "row")
    return stored(near.join(wanted, F.col("at") == F.col("row")).select("rep", "text").dropDuplicates(["rep"]).mapInPandas(
        run, "rep long, shingles binary"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared) of pairs (a, b): each b's set goes once to every task that compares it with some thousand a's."""
    counts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PAIRS_PER_TASK).cast("int").alias("parts"))
    spread = pairs.join(counts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    left = spread.join(sets.withColumnRenamed("rep", "a"), "a").select("b", "part", "a", "shingles")
    right = counts.join(sets.withColumnRenamed("rep", "b"), "b").select(
        "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"), "shingles")
    order = left.union(right).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = None
        for batch in batches:
            out = []
            for b, a, packed in zip(batch["b"], batch["a"], batch["shingles"], strict=True):
                found = np.frombuffer(packed, np.uint64)
                if pd.isna(a):
                    mine = found
                else:
                    out.append((int(a), b, len(np.intersect1d(mine, found, assume_unique=True))))
            yield pd.DataFrame(out, columns=["a", "b", "shared"])

    return order.mapInPandas(run, "a long, b long, shared long")


def _region_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links that join the sets of one block (two tiles of a region) into components: (a, b) with b the least reachable."""
    rep, label = group["rep"].to_numpy(), group["rep"].to_numpy().copy()
    sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(column) > 1
    place = np.cumsum(often) - 1
    row, column = row[often[column]], place[column[often[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(often.sum()), COLUMNS):
        i, j = np.searchsorted(column, [start, start + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[i:j], column[i:j] - start] = 1
        shared += part @ part.T
    shared = shared.astype(np.int64)
    near = shared * 100 >= (sizes[:, None] + sizes[None, :] - shared) * percent
    np.fill_diagonal(near, False)
    left, right = np.nonzero(near)
    while len(left):
        low = label.copy()
        np.minimum.at(low, left, label[right])
        if (low == label).all():
            break
        label = low
    return pd.DataFrame({"a": rep, "b": label})[rep != label]


def region_of(measured: DataFrame, pivots: DataFrame) -> DataFrame:
    """(rep, region, d): the largest region of LEAST_REGION sets or more that each set is near to, and its distance."""
    d = 1 - F.col("shared") / F.col("all")
    near = measured.filter(d <= REACH).withColumn("d", d)
    either = near.select(F.col("a").alias("region"), F.col("b").alias("rep"), "d").union(near.select("b", "a", "d"))
    found = stored(either.join(pivots, "region").union(pivots.select("region", "region", F.lit(0.0))).distinct())
    large = stored(found.groupBy("region").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= LEAST_REGION))
    return stored(found.join(large, "region").groupBy("rep").agg(F.max(F.struct("size", "region", "d")).alias("m")).select(
        "rep", "m.region", "m.d"))


def region_join(inside: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) inside all regions that still hold more than one component."""
    now = inside.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "group", F.coalesce("component", "rep"))
    open_ = now.groupBy("region").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).filter("g0 < g1")
    radius = (100 - percent) / 100
    now = stored(now.join(open_.select("region"), "region").select(
        "region", "rep", F.floor(F.col("d") / F.lit(radius) + 1e-9).cast("int").alias("band")))
    tiles = stored(now.groupBy("region", "band").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")))
    mine = now.join(tiles, ["region", "band"]).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    # Windows: a set meets its own band, and as boundary the next ones on both sides.
    window = mine.withColumn("other_band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    other = tiles.select("region", F.col("band").alias("other_band"), F.explode(
        F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other_tile"))
    own, far = F.struct("band", "tile"), F.struct(F.col("other_band").alias("band"), F.col("other_tile").alias("tile"))
    rows = window.join(other, ["region", "other_band"]).select("rep", "region", F.least(own, far).alias("p"), F.greatest(
        own, far).alias("q")).select("rep", "region", F.col("p.band").alias("b1"), F.col("p.tile").alias("t1"),
                                     F.col("q.band").alias("b2"), F.col("q.tile").alias("t2"))
    keys = ["region", "b1", "t1", "b2", "t2"]
    blocks = rows.join(sets, "rep").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, keys):
            yield _region_links(group, percent)

    return stored(blocks.mapInPandas(run, "a long, b long"))


def _with_sides(pairs: DataFrame, reps: DataFrame, col: str) -> DataFrame:
    """Stored pairs (a, b, na, nb) with ``col`` of both as pa and pb. Of the other sets none is shuffled."""
    wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    side = possibly_in(reps.select("rep", col), "rep", wanted, "rep")
    return pairs.join(side.toDF("a", "pa"), "a").join(side.toDF("b", "pb"), "b")


def _in_few_classes(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Stored pairs (a, b, na, nb) whose finer counts leave room for a link. These are a twentieth of the prefixes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [least_apart(pa_, pb) <= (100 - percent) * (na + nb) // (100 + percent) for pa_, pb, na, nb in zip(
                batch["pa"], batch["pb"], batch["na"], batch["nb"], strict=True)]
            yield batch.loc[np.array(keep, bool), ["a", "b", "na", "nb"]]

    return _with_sides(pairs, reps, "fine").mapInPandas(run, "a long, b long, na long, nb long")


def _close_enough(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Stored pairs (a, b, na, nb) whose prefixes leave room for a link: what lies apart in the part of the order that both
    prefixes cover is already apart in the sets."""
    both = _with_sides(pairs, reps, "prefix")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for pa_, pb, na, nb in zip(batch["pa"], batch["pb"], batch["na"], batch["nb"], strict=True):
                pa_, pb = (np.asarray(p, np.int64).view(np.uint64) for p in (pa_, pb))
                end = min(pa_[-1], pb[-1])
                pa_, pb = pa_[:np.searchsorted(pa_, end, "right")], pb[:np.searchsorted(pb, end, "right")]
                apart = len(pa_) + len(pb) - 2 * len(np.intersect1d(pa_, pb, assume_unique=True))
                keep.append(apart <= (100 - percent) * (na + nb) // (100 + percent))
            yield batch.loc[np.array(keep, bool), ["a", "b", "na", "nb"]]

    return both.mapInPandas(run, "a long, b long, na long, nb long")


def _apart(a: Column, b: Column) -> Column:
    """What the counts of shingles per hash class differ by, summed: the sets lie at least as far apart."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def _open_members(member: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(seat, rep, n, place, group) of the seats that hold more than one component."""
    if groups is None:
        now = member.withColumn("group", F.col("rep"))
    else:
        now = member.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("group", F.coalesce("component", "rep"))
    open_ = now.groupBy("seat").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).filter("g0 < g1")
    return now.join(open_.select("seat"), "seat").select("seat", "rep", "n", "place", "group")


def jaccard_components(docs: DataFrame, percent: int = 85, width: int = 4, id_col: str = "doc_id",
                       text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """row, doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row; row is a hash of id and
    text by which a row can be found again (``row_key``). With ``keep_row`` also that hash of one row per component: the
    smallest id, null last, then the smallest hash.

    Two rows link when 100 * intersection >= percent * union of their sets of shingles. Sets of texts without words are
    empty and link with nothing. Equal sets are one class and always link; rows that repeat an id are rows of their
    own. Null ids take part; a component's id is null only if all its ids are. No rows give no rows; further columns are
    ignored. Exact up to collisions of 63-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"),
                       F.col(text_col).alias("text"))
    rows = stored(sketches(docs, frequent(docs, width), width, percent).withColumn("rep", F.monotonically_increasing_id()))
    first = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")] if keep_row else []
    classes = rows.filter("n > 0").groupBy("n", "x", "y").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("row", "rep")).alias("one"), *first)
    classes = stored(classes.withColumns({"row": F.col("one.row"), "rep": F.col("one.rep")}).drop("one"))
    # Prefixes are read where they are stored: only rows that may not be the one of their class are shuffled.
    reps = rows.filter("n > 0").select("rep", "row", "n", "prefix", "counts", "fine")
    others = stored(rows.filter("n > 0").select("rep").join(classes.select("rep"), "rep", "left_anti"))
    if not others.isEmpty():
        reps = possibly_in(reps, "rep", others, "rep").join(others, "rep", "left_anti").union(
            possibly_in(reps, "rep", others, "rep", inside=False))
    # Seats of regions: prefix shingles of two classes or more.
    seats = reps.select("rep", "n", F.posexplode("prefix").alias("place", "seat"))
    shared = stored(seats.groupBy("seat").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("seat"))
    sweep(spark)
    member = stored(seats.join(shared, "seat").select("seat", "rep", F.col("n").cast("int").alias("n"), "place"))
    discard(shared)
    sweep(spark)
    n_reps, links, sets, measured, used = reps.count(), None, None, None, None
    groups = None

    def fits(a: str, b: str) -> Column:
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (
            F.col(f"{a}.place") + F.col(f"{b}.place") <= room(percent, na, nb))

    def pair_up(met: DataFrame, a: str, b: str) -> DataFrame:
        first = F.col(f"{a}.rep") < F.col(f"{b}.rep")
        return met.select(*[F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).cast("long").alias(n) for n, x, y, c in (
            ("a", a, b, "rep"), ("b", b, a, "rep"), ("na", a, b, "n"), ("nb", b, a, "n"))]).distinct()

    def measure(pairs: DataFrame) -> DataFrame:
        """Distances of the pairs that may link; adds the sets this needs."""
        nonlocal sets
        pairs = stored(_in_few_classes(stored(pairs), reps, percent))
        pairs = stored(_close_enough(pairs, reps, percent))
        sweep(spark)
        wanted = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
        if sets is not None:
            wanted = wanted.join(sets.select("rep"), "rep", "left_anti")
        more = whole_sets(docs, stored(wanted.join(reps.select("rep", "row"), "rep")), width)
        sets = more if sets is None else sets.union(more)
        found = overlaps(pairs.select("a", "b"), sets).join(pairs, ["a", "b"])
        found = stored(found.select("a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("all")))
        sweep(spark)
        return found

    spent = [member]            # tables that ``member`` reads
    while True:
        # Members with their component so far; a seat whose members are all in one is done.
        now = stored(_open_members(member, groups))
        for table in spent:
            discard(table)
        pivots = stored(now.groupBy("seat").agg(F.min(F.struct("place", "rep", "n", "group")).alias("p")))
        met = now.select("seat", F.struct("place", "rep", "n", "group").alias("m")).join(pivots, "seat")
        pairs = pair_up(met.filter((F.col("m.group") != F.col("p.group")) & fits("m", "p")), "m", "p")
        if measured is not None:
            pairs = pairs.join(measured.select("a", "b"), ["a", "b"], "left_anti")
        found = measure(pairs)
        measured = found if measured is None else measured.union(found)
        linked = found.filter(F.col("shared") * 100 >= F.col("all") * percent).select("a", "b")
        links = linked if links is None else links.union(linked)
        own = stored(pivots.select("p.rep").distinct())
        used = own if used is None else used.union(own)
        groups = components(links)
        # A pivot has met everybody at its seat.
        member, spent = now.join(pivots, "seat").filter(F.col("rep") != F.col("p.rep")).select("seat", "rep", "n", "place"), [now, pivots]
        if linked.count() * 100 <= n_reps:
            break
    # Rounds no longer join much: join inside the pivots' regions, then what meets at a seat and is in no region together.
    regions = region_of(measured, used.toDF("region").distinct())
    links = links.union(region_join(regions, groups, sets, percent))
    groups = components(links)
    rest = _open_members(member, groups).join(regions.select("rep", "region"), "rep", "left").join(
        reps.select("rep", "counts"), "rep")
    rest = stored(rest.select("seat", F.struct("place", "rep", "n", "group", "region", "counts").alias("m")))
    for table in spent:
        discard(table)
    sweep(spark)
    met = rest.join(rest.withColumnRenamed("m", "o"), "seat").filter(
        (F.col("m.rep") < F.col("o.rep")) & (F.col("m.group") != F.col("o.group")) &
        F.coalesce(F.col("m.region") != F.col("o.region"), F.lit(True)) & fits("m", "o") &
        (_apart(F.col("m.counts"), F.col("o.counts")) <= room(percent, F.col("m.n"), F.col("o.n"))))
    found = measure(pair_up(met, "m", "o").join(measured.select("a", "b"), ["a", "b"], "left_anti"))
    links = links.union(found.filter(F.col("shared") * 100 >= F.col("all") * percent).select("a", "b"))
    groups = components(links)
    named = stored(classes.join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component", F.coalesce("component", "rep")))
    best = [F.min("best").getField("row").alias("keep_row")] if keep_row else []
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"), *best)
    kept = [F.coalesce("keep_row", "row").alias("keep_row")] if keep_row else []
    told = stored(rows.select("row", "doc_id", "n", "x", "y"))
    for table in (rows, rest, sets):
        discard(table)
    out = stored(named.join(lows, "component").select("n", "x", "y", "component_id", *(["keep_row"] if keep_row else [])))
    return told.join(out, ["n", "x", "y"], "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *kept)
