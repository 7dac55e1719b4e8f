"""Repeated 50-byte strings across documents, from merged Burrows-Wheeler transforms of shards.

A 50-byte window belongs to its seed, the leftmost of its 16-byte grams with the lowest hash; equal windows have equal
seeds at the same place, so strings around different seeds never need to meet. Seeds in one document only are left out.
The text around every other seed goes to the seed's bucket, lined up at the seed. There every shard (what one task sent)
has its own transform: the symbol before each suffix, in the order of suffixes, for one place after the other from the
right end of the windows to the left. Shards are merged by refining their interleave: symbols are read from the
shards' transforms in the current interleave, which is then split stably by symbol. No suffix is compared or sorted
again; common prefixes of neighbours follow from range minima of the step before. (A departure from transforms of whole
shards: those would have to meet in one task. Seeds, not the transform, bring together what may be equal, and each
bucket's transforms are merged by themselves.) Once 50 symbols have been taken up,
stretches of neighbours with a common prefix of 50 or more are the repeated windows.

However often a string occurs, a chunk of texts sends it once: equal surroundings in a chunk are one entry with their
smallest document, whose verdict is known for all larger ones. Seeds that occur more than HOT times, whose surroundings
may all differ, send every window as an entry of its own, to a bucket chosen by the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import possibly_in, stored, text_or_empty, whole_groups
from .jaccard import mixed

WINDOW, GRAM = 50, 16
LEFT = WINDOW - GRAM                    # a seed is at most this far from its window's start
WIDTH = LEFT + WINDOW                   # bytes around a seed that its windows may need
BUCKET_BYTES, CHUNK_CHARS, SHARD = 4 << 20, 3_000_000, 20_000
PART_BYTES, WAITING_BYTES = 64 << 10, 64 << 20  # marks sent to a part at once, and kept in a task before they are sent
HOT = 1 << 15                           # a seed with more occurrences is split by windows
SEEDS, MORE, KNOWN, ROWS, SPLIT = range(5)      # kinds of rows in the exchange of seeds
FACTOR = 0x9E3779B97F4A7C15
END = 255                               # no byte of UTF-8: what lies outside the windows of a seed
LAST = (1 << 63) - 1                    # where null ids come in the order of documents


def seeds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Seeds of texts laid end to end: (text, place, hash, most, least), windows starting most to least before the place."""
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.int64))
    gram, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < GRAM:
        gram = gram[:-size] * np.uint64(pow(FACTOR, size, 1 << 64)) + gram[size:]
        size *= 2
    gram = mixed(gram)
    low = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    span, width = 1, LEFT + 1                                 # minimum over the grams of a window, by doubling
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.zeros(len(place) + 1, np.int32)
    long_ = ends - starts >= WINDOW
    np.add.at(change, starts[long_], 1)
    np.add.at(change, ends[long_] - WINDOW + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    place = np.where(valid, place, -1)
    cuts = np.flatnonzero(np.diff(place, prepend=-2))
    first, after = cuts, np.append(cuts[1:], len(place))
    keep = place[first] >= 0
    first, after = first[keep], after[keep]
    place = place[first]
    text = np.searchsorted(starts, first, "right") - 1
    # Empty texts share their start with the next one; the window lies in the last text that starts there.
    return text, place, gram[place], place - first, place - after + 1


def laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes)
    return np.frombuffer(b"".join(raw), np.uint8), ends - sizes, ends


def six(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


KEY = np.uint64((1 << 48) - 1)


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    return (mixed(hashes) % np.uint64(n)).astype(np.int64)


def alike(data: np.ndarray, place: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A hash of every surrounding and its windows, the same wherever it lies."""
    inverse = np.uint64(pow(FACTOR, -1, 1 << 64))
    power, back = (np.cumprod(np.append(np.uint64(1), np.full(len(data), f, np.uint64))) for f in (np.uint64(FACTOR), inverse))
    summed = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1]))
    a, b = place - most, place + WINDOW - least
    return mixed((summed[b] - summed[a]) * back[a] + mixed((most * WIDTH + least).astype(np.uint64)))


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether the surroundings at places a and b, with the same windows, are equal."""
    out, offset = np.zeros(len(a), bool), np.arange(-LEFT, WINDOW)
    for i in range(0, len(a), SHARD):
        x, y, m, n = (v[i:i + SHARD, None] for v in (a, b, most, least))
        outside = (offset < -m) | (offset >= WINDOW - n)
        out[i:i + SHARD] = (outside | (data[np.clip(x + offset, 0, len(data) - 1)] == data[np.clip(y + offset, 0, len(data) - 1)])).all(axis=1)
    return out


def every_bit(most: np.ndarray, least: np.ndarray) -> np.ndarray:
    return ((np.uint64(1) << (most - least + 1).astype(np.uint64)) - np.uint64(1)) << least.astype(np.uint64)


def _split(order_by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(order_by):
        return
    order = np.argsort(order_by, kind="stable")
    cuts = np.flatnonzero(np.diff(order_by[order], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        yield int(order_by[order[a]]), order[a:b]


def shared_seeds(docs: DataFrame, n_buckets: int) -> DataFrame:
    """(row, hot, keys): the packed keys of the seeds that a document shares with another (hot = -1), and every shared
    seed with more than HOT occurrences (column hot)."""
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows = batch["text"].tolist(), batch["row"].to_numpy()
            for i, j in chunks(texts, CHUNK_CHARS):
                text, _, hashes, _, _ = seeds(*laid_out(texts[i:j]))
                own = rows[i:j]
                # Places count, so that rows that occur twice do not cancel.
                marked = mixed(own.view(np.uint64) + mixed(np.arange(1, len(own) + 1, dtype=np.uint64)))
                name = int(mixed(np.array([np.bitwise_xor.reduce(marked)]))[0] >> np.uint64(1))
                key = hashes & KEY
                order = np.argsort(key, kind="stable")          # texts stay in order
                key, text = key[order], text[order]
                first = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1)))
                count = np.diff(np.append(first, len(key)))
                last = first + count - 1
                several = text[first] != text[last]
                # One or two texts of a seed look for others; all further texts of the chunk have met each other.
                sent = np.concatenate([first, last[several]])
                rest = np.repeat(several, count) & (np.diff(text, prepend=-1) != 0)
                rest[sent] = False
                out = [(b, name, SEEDS, six(key[sent[at]]), text[sent[at]].astype(np.uint32).tobytes())
                       for b, at in _split(bucket_of(key[sent], n_buckets))]
                many = np.flatnonzero(count > 2)
                out += [(b, name, MORE, six(key[first[many[at]]]), (count - several - 1)[many[at]].astype(np.uint32).tobytes())
                        for b, at in _split(bucket_of(key[first[many]], n_buckets))]
                # Which rows the chunk has travels once, to any bucket, and so does what is known.
                out.append((name % n_buckets, name, ROWS, b"", own.tobytes()))
                if rest.any():
                    out.append((name % n_buckets, name, KNOWN, six(key[rest]), text[rest].astype(np.uint32).tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "chunk", "kind", "keys", "rows"])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, ["bucket"]):
            lists, more = group[group["kind"].isin([ROWS, KNOWN])], group[group["kind"] == MORE]
            bucket, group = int(group["bucket"].iloc[0]), group[group["kind"] == SEEDS]
            out = list(zip(lists["chunk"], lists["kind"], lists["keys"], lists["rows"], strict=True))
            if len(group):
                keys = [from_six(k) for k in group["keys"]]
                texts = [np.frombuffer(r, np.uint32) for r in group["rows"]]
                key = np.concatenate(keys)
                # Two entries of a chunk for one seed are two texts, and so are entries of two chunks.
                order = np.argsort(key, kind="stable")
                cuts = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] + np.uint64(1)))
                count = np.diff(np.append(cuts, len(key)))
                keep = np.zeros(len(key), bool)
                keep[order] = np.repeat(count > 1, count)
                ends = np.cumsum([len(k) for k in keys])
                for chunk, k, t, end in zip(group["chunk"], keys, texts, ends, strict=True):
                    mine = keep[end - len(k):end]
                    if mine.any():
                        out.append((chunk, KNOWN, six(k[mine]), t[mine].tobytes()))
                known, total = key[order[cuts]], count.copy()
                for k, n in zip(more["keys"], more["rows"], strict=True):
                    total[np.searchsorted(known, from_six(k))] += np.frombuffer(n, np.uint32)
                hot = known[(total > HOT) & (count > 1)]
                if len(hot):
                    out.append((bucket, SPLIT, six(hot), b""))
            yield pd.DataFrame(out, columns=["chunk", "kind", "keys", "rows"])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, ["chunk"]):
            hot = [int(k) for packed in group.loc[group["kind"] == SPLIT, "keys"] for k in from_six(packed)]
            if hot:
                yield pd.DataFrame({"row": 0, "hot": hot, "keys": [b""] * len(hot)})
            lists, group = group.loc[group["kind"] == ROWS, "rows"], group[group["kind"] == KNOWN]
            if len(group):
                table = np.frombuffer(lists.iloc[0], np.int64)
                key = np.concatenate([from_six(k) for k in group["keys"]])
                text = np.concatenate([np.frombuffer(r, np.uint32) for r in group["rows"]])
                order = np.argsort(text, kind="stable")
                cuts = np.flatnonzero(np.diff(text[order].astype(np.int64), prepend=-1))
                yield pd.DataFrame({"row": table[text[order[cuts]]], "hot": -1, "keys": [
                    six(key[order[a:b]]) for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True)]})

    sent = docs.select("row", "text").mapInPandas(send, "bucket long, chunk long, kind long, keys binary, rows binary")
    met = sent.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(
        meet, "chunk long, kind long, keys binary, rows binary")
    rows = met.repartition("chunk").sortWithinPartitions("chunk").mapInPandas(gather, "row long, hot long, keys binary")
    return stored(rows.dropDuplicates(["row", "hot"]))


def surroundings(joined: DataFrame, n_buckets: int, hot: np.ndarray) -> DataFrame:
    """(bucket, rows, orders, places, most, least, bytes, like): packed surroundings of shared seeds, one row per chunk's
    share. Behind them, rows and places have further occurrences in the same document, ``like`` the numbers of the
    surroundings they equal. A row without surroundings has known verdicts, bits in place of orders.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, rows = batch["text"].tolist(), batch["row"].to_numpy()
            orders, wanted = batch["o"].to_numpy(), batch["keys"].tolist()
            for i, j in chunks(texts, CHUNK_CHARS):
                data, starts, ends = laid_out(texts[i:j])
                text, place, hashes, most, least = seeds(data, starts, ends)
                lists = [from_six(k) for k in wanted[i:j]]
                owner = np.repeat(np.arange(j - i), [len(x) for x in lists]).astype(np.uint64)
                salt = np.uint64(0xD6E8FEB86659FD93)
                keep = np.isin(mixed((hashes & KEY) + text.astype(np.uint64) * salt),
                               mixed(np.concatenate(lists) + owner * salt))
                text, place, hashes, most, least = (x[keep] for x in (text, place, hashes, most, least))
                split = np.isin(hashes & KEY, hot)
                if split.any():                                 # every window by itself
                    n = np.where(split, most - least + 1, 1)
                    at = np.repeat(np.arange(len(n)), n)
                    k = least[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                    split, text, place, hashes = split[at], text[at], place[at], hashes[at]
                    most, least = np.where(split, k, most[at]), np.where(split, k, least[at])
                if not len(text):
                    continue
                hashed, own, order = alike(data, place, most, least), rows[i:j][text], orders[i:j][text]
                target = bucket_of(np.where(split, hashed, hashes), n_buckets)
                by = np.lexsort((order, hashed))
                cuts = np.flatnonzero(np.diff(hashed[by], prepend=hashed[by[:1]] + np.uint64(1)))
                like = np.empty(len(by), np.int64)              # the same surrounding in the smallest document here
                like[by] = np.repeat(by[cuts], np.diff(np.append(cuts, len(by))))
                other = np.flatnonzero(like != np.arange(len(like)))
                fails = other[~same_bytes(data, place[other], place[like[other]], most[other], least[other])]
                like[fails] = fails
                apart, known = like == np.arange(len(like)), order > order[like]
                further = np.flatnonzero(~apart & ~known)
                further, number = further[np.argsort(like[further], kind="stable")], np.zeros(len(like), np.uint32)
                start, at_place, single, out = like[further], place - starts[text], np.flatnonzero(apart), []
                for b, at in _split(target[single]):
                    at = single[at]
                    number[at] = np.arange(len(at))
                    lo, hi = np.searchsorted(start, at), np.searchsorted(start, at, "right")
                    again = further[np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(
                        np.cumsum(hi - lo) - (hi - lo), hi - lo)]
                    offset = np.arange(-LEFT, WINDOW)
                    near = place[at][:, None] + offset
                    inside = (offset >= -most[at][:, None]) & (offset < WINDOW - least[at][:, None])
                    around = np.where(inside, data[np.clip(near, 0, len(data) - 1)], END).astype(np.uint8)
                    both = np.concatenate([at, again])
                    out.append((b, own[both].tobytes(), order[at].tobytes(), at_place[both].tobytes(),
                                most[at].astype(np.uint8).tobytes(), least[at].astype(np.uint8).tobytes(), around.tobytes(),
                                number[like[again]].tobytes()))
                if known.any():
                    out.append((int(own[known][0]) % n_buckets, own[known].tobytes(), every_bit(most, least)[known].tobytes(),
                                at_place[known].tobytes(), b"", b"", b"", b""))
                yield pd.DataFrame(out, columns=["bucket", "rows", "orders", "places", "most", "least", "bytes", "like"])

    return joined.select("row", "o", "text", "keys").mapInPandas(
        run, "bucket long, rows binary, orders binary, places binary, most binary, least binary, bytes binary, like binary")


class Transform:
    """One shard: ``symbols[t]`` is the column at place t in the order of the suffixes that start one place further
    right, ``order[t]`` the order of those that start at t (kept where windows start)."""

    def __init__(self, around: np.ndarray):
        order = np.arange(len(around))
        self.symbols, self.order = [b""] * WIDTH, {}
        for t in range(WIDTH - 1, -1, -1):
            column = around[order, t]
            self.symbols[t] = column
            order = order[np.argsort(column, kind="stable")]
            if t <= LEFT:
                self.order[t] = order


def merged_intervals(shards: list[Transform], sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(t, members, starts): for every place t of window starts, all suffixes in merged order (numbered shard by shard)
    and where stretches with a common prefix of WINDOW symbols begin."""
    kind = np.uint8 if len(shards) < 256 else np.uint16 if len(shards) < 65536 else np.int64
    weave = np.repeat(np.arange(len(shards)), sizes).astype(kind)
    common = np.zeros(len(weave), np.int16)
    bases = np.cumsum(sizes) - sizes
    for t in range(WIDTH - 1, -1, -1):
        read = np.argsort(weave, kind="stable")               # the places of every shard's entries, shard by shard
        symbols = np.empty(len(weave), np.uint8)
        symbols[read] = np.concatenate([s.symbols[t] for s in shards])
        order = np.argsort(symbols, kind="stable")
        ends = np.cumsum(np.bincount(symbols, minlength=256))
        fresh = np.zeros(len(weave), np.int16)
        for c in np.flatnonzero(np.diff(ends, prepend=0) > 1):
            if c != END:
                at = order[(ends[c - 1] if c else 0):ends[c]]
                least = np.minimum.reduceat(common[:at[-1] + 1], at[:-1] + 1)
                fresh[ends[c] - len(at) + 1:ends[c]] = np.minimum(least + 1, WINDOW)
        weave, common = weave[order], fresh
        if t <= LEFT:
            members = np.empty(len(weave), np.int64)
            members[np.argsort(weave, kind="stable")] = np.concatenate(
                [s.order[t] + base for s, base in zip(shards, bases, strict=True)])
            yield t, members, np.flatnonzero(common < WINDOW)


def repeated(around: list[np.ndarray], orders: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every surrounding a bit per distance k: whether the window k before its seed starts in a smaller document."""
    out = np.zeros(len(orders), np.uint64)
    sizes = np.array([len(a) for a in around])
    for t, members, starts in merged_intervals([Transform(a) for a in around], sizes):
        k = LEFT - t
        o = orders[members]
        low = np.repeat(np.minimum.reduceat(o, starts), np.diff(np.append(starts, len(o))))
        hit = members[(o > low) & (most[members] >= k) & (least[members] <= k)]
        out[hit] |= np.uint64(1) << np.uint64(k)
    return out


def marks(around: DataFrame) -> DataFrame:
    """(row, marks), one row per document some of whose windows go: packed (place, bits) of their seeds.

    A task keeps the marks of all its buckets apart by parts of the documents, as many as a shuffle has, and sends a part once PART_BYTES
    have come together, so rows follow the bytes of marks and not the number of buckets a document is in.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}

        def flush(parts: list[int]) -> pd.DataFrame:
            packed = [np.concatenate(waiting.pop(p), axis=1) for p in parts]
            for p in parts:
                del size[p]
            return pd.DataFrame({"part": parts, "marks": [x.tobytes() for x in packed]})

        for group in whole_groups(batches, ["bucket"]):
            done = group[group["bytes"].str.len() == 0]
            group = group[group["bytes"].str.len() > 0]
            parts = [np.frombuffer(b, np.uint8).reshape(-1, WIDTH) for b in group["bytes"]]
            shards, waits = [], []
            for p in parts:
                waits.append(p)
                if sum(map(len, waits)) >= SHARD:
                    shards.append(np.concatenate(waits))
                    waits = []
            shards += [np.concatenate(waits)] if waits else []
            order = np.frombuffer(b"".join(group["orders"]), np.int64)
            most, least = (np.frombuffer(b"".join(group[c]), np.uint8) for c in ("most", "least"))
            own = repeated(shards, order, most, least) if shards else np.zeros(0, np.uint64)
            bits, base = [np.frombuffer(b"".join(done["orders"]), np.uint64)], 0
            for p, like in zip(parts, group["like"], strict=True):
                bits += [own[base:base + len(p)], own[base + np.frombuffer(like, np.uint32).astype(np.int64)]]
                base += len(p)
            bits = np.concatenate(bits)
            row, place = (np.frombuffer(b"".join([*done[c], *group[c]]), np.int64) for c in ("rows", "places"))
            hit = np.flatnonzero(bits)
            found = np.stack([row[hit], place[hit], bits[hit].view(np.int64)])
            for part, at in _split(bucket_of(row[hit].view(np.uint64), n_parts)):
                waiting.setdefault(part, []).append(found[:, at])
                size[part] = size.get(part, 0) + 24 * len(at)
            full = [p for p, n in size.items() if n >= PART_BYTES]
            if sum(size.values()) >= WAITING_BYTES:
                full = list(size)
            if full:
                yield flush(full)
        if size:
            yield flush(list(size))

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, ["part"]):
            row, place, bits = np.concatenate([np.frombuffer(m, np.int64).reshape(3, -1) for m in group["marks"]], axis=1)
            order = np.argsort(row, kind="stable")
            row, place, bits = row[order], place[order], bits[order]
            cuts = np.flatnonzero(np.diff(row, prepend=row[:1] - 1))
            yield pd.DataFrame({"row": row[cuts], "marks": [
                place[a:b].tobytes() + bits[a:b].tobytes() for a, b in zip(cuts, np.append(cuts[1:], len(row)), strict=True)]})

    n_parts = int(around.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = around.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, "part long, marks binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInPandas(unpack, "row long, marks binary")


def cut(raw: bytes, packed: list[bytes]) -> tuple[int, int, bytes]:
    """(bytes removed, runs removed, what stays) of one text, given the marks of its seeds."""
    starts = np.zeros(len(raw) + 1, np.int8)
    if packed:
        place = np.frombuffer(b"".join(p[:len(p) // 2] for p in packed), np.int64)
        bits = np.frombuffer(b"".join(p[len(p) // 2:] for p in packed), np.uint64)
        for k in range(LEFT + 1):
            starts[place[(bits >> np.uint64(k) & np.uint64(1)).astype(bool)] - k] = 1
        starts[WINDOW:] -= starts[:-WINDOW].copy()
    gone = np.cumsum(starts[:-1], dtype=np.int32) > 0
    return int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes()


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` is what stays of its text, as bytes.

    A byte goes if a WINDOW-byte string that covers it also starts in a document with a smaller id; matches never cross
    documents and are judged on the input. Null texts are empty; texts shorter than WINDOW lose nothing. Rows of one id
    do not take bytes from each other; a null id is larger than all others. Repeated rows come out alike, further
    columns are ignored, no rows give no rows. Texts are shuffled once, only those that share a seed with another.
    """
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("o"), text_or_empty(text_col).alias("text"))
    docs = docs.select(F.xxhash64("o", "text").alias("row"), "o", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(16, total // BUCKET_BYTES)
    found = shared_seeds(docs, n_buckets)
    shared = found.filter("hot < 0").select("row", "keys")
    hot = np.array([r[0] for r in found.filter("hot >= 0").select("hot").collect()], np.uint64)     # one in HOT seeds at most
    maybe = possibly_in(docs, "row", shared, "row")
    keys = shared.select(F.col("row").alias("at"), "keys")
    joined = maybe.join(keys, F.col("row") == F.col("at"))
    found = marks(surroundings(joined, n_buckets, hot)).select(F.col("row").alias("at"), F.array("marks").alias("marks"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, texts, packed = (batch.column(k) for k in range(3))
            for i, j in chunks([t for t in texts.to_pylist()], CHUNK_CHARS):
                raw = [t.encode("utf-8", "surrogatepass") for t in texts.slice(i, j - i).to_pylist()]
                done = [cut(r, p or []) for r, p in zip(raw, packed.slice(i, j - i).to_pylist(), strict=True)]
                removed, spans, kept = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [orders.slice(i, j - i), pa.array([len(r) for r in raw], pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=["o", "n_bytes", "n_removed", "n_spans", "kept"])

    touched = maybe.join(found, F.col("row") == F.col("at"), "left").select("o", "text", "marks").mapInArrow(
        finish, "o long, n_bytes long, n_removed long, n_spans long, kept binary")
    whole = possibly_in(docs, "row", shared, "row", inside=False).select(
        "o", F.octet_length("text").cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("text").cast("binary"))
    return touched.union(whole).select(F.when(F.col("o") != LAST, F.col("o")).alias("doc_id"), "n_bytes", "n_removed",
                                       "n_spans", "kept")
