"""Byte-level BPE: a segment tree per pre-token keeps the leftmost pair of lowest rank; merges update it in log time."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import kept

# A worker's memory: pre-tokens kept with their ids, and characters tokenised before results go out.
CACHE_PIECES, CHUNK_CHARS, CHUNK_PIECES = 400_000, 500_000, 100_000
TREE_BYTES = 1 << 15     # bytes of pre-tokens whose trees are worked on together; they should fit the CPU cache
NONE = np.iinfo(np.int64).max


class Encoder:
    """Ranks of one vocabulary file and the pre-tokens encoded so far, one per worker process."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = sorted((self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items()
                       for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.pairs = np.array([p for p, _ in pairs], dtype=np.int64)
        self.pair_ranks = np.array([r for _, r in pairs], dtype=np.int64)
        self.cache: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours make, -1 if none; ids below 0 stand for no neighbour."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def merged(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes (a power of two): one tree per piece, all worked on together.

        Leaf p of a tree holds rank * width + p of the pair that starts at byte p, so the root is the leftmost pair of
        the lowest rank.
        """
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        alive = np.arange(width) < sizes[:, None]
        ids = np.full((n, width), -1, np.int64)
        ids[alive] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        before = after - 2
        tree = np.full((n, 2 * width), NONE, np.int64)
        right = np.full_like(ids, -1)
        right[:, :-1] = ids[:, 1:]
        rank = self.pair_rank(ids, right)
        tree[:, width:] = np.where(rank < 0, NONE, rank * width + np.arange(width))
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.arange(n)
        while True:
            root = tree[live * 2 * width + 1]
            live, root = live[root < NONE], root[root < NONE]
            if not len(live):
                break
            row, top = live * width, live * 2 * width
            at, token = root % width, root // width
            gone = after[row + at]
            then, prior = after[row + gone], before[row + at]
            ids[row + at], ids[row + gone], after[row + at] = token, -1, then
            has_next, has_prior = then < width, prior >= 0
            before[(row + then)[has_next]] = at[has_next]
            next_id = np.where(has_next, ids[np.minimum(row + then, len(ids) - 1)], -1)
            prior_id = np.where(has_prior, ids[np.maximum(row + prior, 0)], -1)
            for leaf, rank in ((gone, None), (at, self.pair_rank(token, next_id)), (prior, self.pair_rank(prior_id, token))):
                if rank is None:
                    base, node = top, leaf + width
                    tree[base + node] = NONE
                else:
                    inside = leaf >= 0
                    base, node = top[inside], (leaf + width)[inside]
                    tree[base + node] = np.where(rank < 0, NONE, rank * width + leaf)[inside]
                node = node >> 1
                while len(node) and node[0]:
                    tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
                    node = node >> 1
        left = ids.reshape(n, width) >= 0
        flat = ids.reshape(n, width)[left].astype("<u4").tobytes()
        ends = np.cumsum(left.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of pieces that are not known yet into the cache."""
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        by_width: dict[int, list[str]] = {}
        for piece in set(pieces).difference(self.cache):
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append(piece)
        for width, group in by_width.items():
            step = max(1, TREE_BYTES // width)
            for i in range(0, len(group), step):
                part = group[i:i + step]
                self.cache.update(zip(part, self.merged([p.encode() for p in part], width), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        split = [self.pattern.findall(t) for t in texts]
        self.learn(p for pieces in split for p in pieces)
        return [b"".join(map(self.cache.__getitem__, pieces)) for pieces in split]

    def encode_long(self, text: str) -> bytes:
        """The same for one text whose pieces are better not held at once."""
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while part := list(islice(found, CHUNK_PIECES)):
            self.learn(part)
            out.append(b"".join(map(self.cache.__getitem__, part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(ranks_path: str, pattern: str) -> Encoder:
    return kept(("bpe", ranks_path, pattern), lambda: Encoder(ranks_path, pattern))


def chunks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _with_columns(docs: DataFrame, names: list[str], source: str, convert) -> DataFrame:
    """``docs`` with binary columns that ``convert`` makes of a list of values of ``source``, some at a time."""
    rest = docs.drop(*names)
    at = rest.columns.index(source)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields] + [f"`{n}` binary" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [v or "" for v in batch.column(at).to_pylist()]
            for a, b in chunks(values, CHUNK_CHARS):
                made = [pa.array(column, pa.binary()) for column in convert(values[a:b])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])

    return rest.mapInArrow(run, ", ".join(fields))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids",
           decoded_col: str | None = None) -> DataFrame:
    """Every row with ``ids_col``: the ids of its whole text as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded by itself, without special tokens; a match that is a token of the vocabulary
    is that token. Null and empty texts have no ids (an empty value). With ``decoded_col`` the ids are also decoded
    right away, in the same worker. Rows are independent: no shuffle, repeated rows and further columns stay, columns
    of these names are replaced, no rows give no rows. ``ranks_path`` must exist on every machine.
    """
    def convert(texts: list[str]) -> list[list[bytes]]:
        own = encoder(ranks_path, pattern)
        ids = [own.encode_long(texts[0])] if len(texts) == 1 and len(texts[0]) > CHUNK_CHARS else own.encode(texts)
        return [ids, [own.decode(i) for i in ids]] if decoded_col else [ids]

    return _with_columns(docs, [ids_col, *([decoded_col] if decoded_col else [])], text_col, convert)


def decode(rows: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Every row with ``out_col``: the bytes its ids stand for. Null ids give no bytes; an unknown id fails the job."""
    def convert(values: list) -> list[list[bytes]]:
        own = encoder(ranks_path, pattern)
        return [[own.decode(v) if v else b"" for v in values]]

    return _with_columns(rows, [out_col], ids_col, convert)
