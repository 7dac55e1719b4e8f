"""Periodic runs of words by internal pattern matching.

A run with period q in [L, 2L), L a power of two, is at least 4q long, so it holds a block of 2L words that starts at a
multiple of L and occurs again q words on. Occurrences of a block that start within 2L words of it form one arithmetic
progression, all of whose members overlap; only its difference, the distance to the next occurrence, can be a smallest
period. So each block gives at most one candidate: the successor of its own place among the suffixes that begin with
it, a range of the suffix array, found by a wavelet tree. Prefix doubling makes the suffix array; its classes, equal for
equal stretches of 1, 2, 4, ... words, give the ranges of all blocks and, by doubling again, how far a candidate's
period extends to both sides.

Many texts are laid end to end and worked on together; a word is a symbol of its text and every text ends with a symbol
of its own, so nothing reaches across.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import chunks

LEAST, EXPONENT = 6, 4          # a run has LEAST words and EXPONENT periods at least
CHUNK_CHARS = 500_000           # texts worked on together
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_classes(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """For k = 0, 1, ... while 2^k <= longest, the class of the 2^k symbols at every place: the rank of the first suffix
    that begins with them. Classes of one member are final; only the others are looked at again."""
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.diff(symbols[order], prepend=symbols[order[:1]] - 1))
    count = np.diff(np.append(first, len(symbols)))
    ranks = np.empty(len(symbols), np.int64)
    ranks[order] = np.repeat(first, count)
    levels, active, span = [ranks], order[np.repeat(count > 1, count)], 1
    while 2 * span <= longest:
        ranks = ranks.copy()
        if len(active):
            key = ranks[active] * len(symbols) + ranks[active + span]     # active places have no end within the span
            by = np.argsort(key, kind="stable")
            active, key = active[by], key[by]
            new = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            count, old = np.diff(np.append(new, len(key))), ranks[active]
            begins = np.flatnonzero(np.diff(old, prepend=-1))
            base = np.repeat(begins, np.diff(np.append(begins, len(old))))
            ranks[active] = np.repeat(old[new] + new - base[new], count)
            active = active[np.repeat(count > 1, count)]
        levels.append(ranks)
        span *= 2
    return levels


class WaveletTree:
    """Values below 2^bits; a level per bit, each with counts of zeros before every place."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            one = (values >> b & 1).astype(bool)
            self.levels.append((b, np.append(0, np.cumsum(~one, dtype=np.int32))))
            values = np.concatenate([values[~one], values[one]])

    def successor(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The smallest value above ``value`` in each range [low, high), -1 if there is none."""
        above, a, b, k = value + 1, low, high, np.zeros(len(low), np.int64)
        for bit, zeros in self.levels:                      # how many are below value + 1
            za, zb = zeros[a], zeros[b]
            one = (above >> bit & 1).astype(bool)
            k += np.where(one, zb - za, 0)
            a, b = (np.where(one, zeros[-1] + x - z, z) for x, z in ((a, za), (b, zb)))
        some = k < high - low
        a, b, k, found = low[some], high[some], k[some], np.zeros(int(some.sum()), np.int64)
        for bit, zeros in self.levels:                      # the next one in order
            za, zb = zeros[a], zeros[b]
            one = k >= zb - za
            k -= np.where(one, zb - za, 0)
            found |= one.astype(np.int64) << bit
            a, b = (np.where(one, zeros[-1] + x - z, z) for x, z in ((a, za), (b, zb)))
        out = np.full(len(low), -1, np.int64)
        out[some] = found
        return out


def common_after(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from i and from j on are equal."""
    n = np.zeros(len(i), np.int64)
    for k in [len(levels) - 1] * 4 + list(range(len(levels) - 2, -1, -1)):      # the top level covers a quarter at least
        n += (levels[k][i + n] == levels[k][j + n]).astype(np.int64) << k
    return n


def common_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols before i and before j (i < j) are equal."""
    n = np.zeros(len(i), np.int64)
    for k in [len(levels) - 1] * 4 + list(range(len(levels) - 2, -1, -1)):
        a, b = i - n - (1 << k), j - n - (1 << k)
        n += ((a >= 0) & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)])).astype(np.int64) << k
    return n


def find_runs(texts: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, length, period) of all runs of every list of words, by start, then period."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    longest, none = int(sizes.max(initial=0)), np.zeros(0, np.int64)
    if longest < LEAST:
        return [(none, none, none)] * len(texts)
    number: dict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    symbols = np.full(ends[-1], 0xFFFFFFFF, np.int64)       # the end of a text
    inside = np.ones(ends[-1], bool)
    inside[ends - 1] = False
    symbols[inside] = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    levels = suffix_classes(owner << 32 | symbols, max(2, longest // 2))
    # Only suffixes whose first two words occur again can be asked for.
    array = np.argsort(levels[-1], kind="stable")
    often = np.bincount(levels[1], minlength=len(symbols))[levels[1][array]] > 1
    place = np.append(0, np.cumsum(often))
    tree = WaveletTree(array[often], len(symbols).bit_length())
    found = []
    for k in range(1, len(levels)):
        step, ranks = 1 << (k - 1), levels[k]
        count = np.bincount(ranks, minlength=len(symbols))
        at = np.arange(0, len(symbols) - step, step)
        # In a run the next block, a step on, occurs again too.
        at = at[(count[ranks[at]] > 1) & (count[ranks[at + step]] > 1)]
        if not len(at):
            continue
        low = ranks[at]
        then = tree.successor(place[low], place[low + count[low]], at)
        q = then - at
        some = (then >= 0) & (q >= step) & (q < 2 * step)
        at, q = at[some], q[some]
        before = common_before(levels, at, at + q)
        length = before + common_after(levels, at, at + q) + q
        good = length >= np.maximum(LEAST, EXPONENT * q)
        found.append(np.stack([at[good] - before[good], length[good], q[good]]))
    if not found:
        return [(none, none, none)] * len(texts)
    # A stretch that many blocks gave, or a multiple of its period, counts once, with the smallest period.
    start, length, q = np.concatenate(found, axis=1)
    by = np.lexsort((q, length, start))
    start, length, q = start[by], length[by], q[by]
    new = np.append(True, (np.diff(start) != 0) | (np.diff(length) != 0))[:len(start)]
    start, length, q = start[new], length[new], q[new]
    by = np.lexsort((q, start))
    start, length, q = start[by], length[by], q[by]
    text = owner[start]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [(start[a:b] - s, length[a:b], q[a:b]) for s, a, b in zip(starts, cuts[:-1], cuts[1:], strict=True)]


def collapsed(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not len(runs[0]):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[0] + runs[2], 1)
    np.add.at(change, runs[0] + runs[1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row with ``n_words``, ``runs`` (start, length and period in words, by start, then period) and ``collapsed``
    (the words that stay, joined by one space).

    A run is a stretch of words, what ASCII white space separates, with smallest period q and at least LEAST words and
    EXPONENT periods, that no neighbouring word extends. A word goes if some run has it after that run's first period.
    Null, empty and blank texts have no runs and an empty rest. Rows are independent: no shuffle, repeated rows come out
    alike, further columns pass through and those of the three names are replaced; no rows give no rows. A text is held
    whole, with some 8 bytes per word and level of doubling: memory for a text of n words is about 8 n log2(n) bytes.
    """
    rest = docs.drop("n_words", "runs", "collapsed")
    at = rest.columns.index(text_col)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v or "" for v in batch.column(at).to_pylist()]
            for a, b in chunks(values, CHUNK_CHARS):
                words = [v.encode().split() for v in values[a:b]]           # bytes split at ASCII white space alone
                runs = find_runs(words)
                made = [pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), map(int, r), strict=True))
                                   for r in zip(*own, strict=True)] for own in runs], pa.list_(RUN)),
                        pa.array([b" ".join(collapsed(w, r)).decode() for w, r in zip(words, runs, strict=True)], pa.string())]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[
                    *part.schema.names, "n_words", "runs", "collapsed"])

    return rest.mapInArrow(run, ", ".join([
        *fields, "n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"]))
