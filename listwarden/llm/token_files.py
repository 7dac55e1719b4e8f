"""Token ids as files: texts in id order, their ids in patched frame-of-reference blocks, with an index of block starts.

A folder written by ``write`` holds two Parquet tables, so that any store Spark can write to will do and a lost task
leaves nothing half done. ``segments`` has a row per stretch of whole documents: (shard, segment, first, n_ids, doc_ids,
n_tokens, data), ``first`` being the position of its first id in its shard. ``shards`` has a row per shard: (shard, start),
the ids of all shards before it. ``data`` is a self-contained image (little-endian):

    "PFB1", u32 blocks, u64 ids, u32 block starts (blocks + 1 of them, from the end of this index), blocks
    block: u32 minimum, u8 width, u8 exceptions, BLOCK values of ``width`` bits (value minus minimum, low bit first),
           u8 places of the exceptions, u32 their values (minus the minimum)

The width of a block holds PERCENTILE of its values; larger ones are exceptions, with a 0 in their place. The last block
is filled up with its last id. An id is found by shard start, segment and block start, without reading other blocks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, text_or_empty

BLOCK, PERCENTILE, MAGIC = 256, 90, b"PFB1"
CUT = -(-BLOCK * PERCENTILE // 100) - 1             # in sorted order, the value whose width a block takes
HEAD, INDEX = 6, 16                                 # bytes before a block's values, and before the block starts
SHARD_BYTES, SEGMENT_IDS = 64 << 20, 1 << 16        # text of a shard on average; ids after which a segment ends
CHUNK_CHARS, CACHE_WORDS, WORD_BYTES = 500_000, 500_000, 64
LOWER = bytes(range(256)).lower()                   # A-Z alone
UPPER_AND_REST = "".join(map(chr, range(32, 127)))
SIGNS = r"([^a-z0-9'\x80-\U0010ffff]*)"             # of ASCII, and none that begins a contraction
LETTERS = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x530)]       # looked at one by one: Latin, Greek, Cyrillic


def _at(starts: np.ndarray, n: int) -> np.ndarray:
    return starts[:, None] + np.arange(n)


def _ranks(rows: np.ndarray) -> np.ndarray:
    """For sorted row numbers, how many equal ones come before."""
    return np.arange(len(rows)) - np.searchsorted(rows, rows)


def pack(ids: np.ndarray) -> bytes:
    """The image of some ids (unsigned, 32 bits)."""
    n, n_blocks = len(ids), -(-len(ids) // BLOCK)
    rows = np.pad(ids.astype(np.uint32), (0, n_blocks * BLOCK - n), "edge").reshape(n_blocks, BLOCK) if n else np.zeros(
        (0, BLOCK), np.uint32)
    low = rows.min(axis=1, initial=0xFFFFFFFF)
    rest = rows - low[:, None]
    width = np.frexp(np.partition(rest, CUT, axis=1)[:, CUT].astype(np.float64))[1].astype(np.int64)
    large = rest.astype(np.uint64) >> width[:, None].astype(np.uint64) > 0
    count = large.sum(axis=1)
    starts = np.append(0, np.cumsum(HEAD + BLOCK // 8 * width + 5 * count))
    out = np.zeros(starts[-1], np.uint8)
    out[_at(starts[:-1], 4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts[:-1] + 4], out[starts[:-1] + 5] = width, count
    inline = np.where(large, 0, rest)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        bits = (inline[own][:, :, None] >> np.arange(w, dtype=np.uint32)).astype(np.uint8) & 1
        out[_at(starts[own] + HEAD, BLOCK // 8 * w)] = np.packbits(bits.reshape(len(own), -1), axis=1, bitorder="little")
    row, place = np.nonzero(large)
    at, rank = starts[row] + HEAD + BLOCK // 8 * width[row], _ranks(row)
    out[at + rank] = place
    out[_at(at + count[row] + 4 * rank, 4)] = rest[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = MAGIC + np.array([n_blocks], "<u4").tobytes() + np.array([n], "<u8").tobytes()
    return head + starts.astype("<u4").tobytes() + out.tobytes()


def unpack(image: bytes, first: int = 0, n: int | None = None) -> np.ndarray:
    """Ids ``first`` to ``first + n`` (all by default) of an image; only the blocks that hold them are looked at."""
    if image[:4] != MAGIC:
        raise ValueError("not an image of token ids")
    n_blocks, total = int(np.frombuffer(image, "<u4", 1, 4)[0]), int(np.frombuffer(image, "<u8", 1, 8)[0])
    stop = total if n is None else min(total, first + n)
    if first >= stop:
        return np.zeros(0, np.uint32)
    a, b = first // BLOCK, -(-stop // BLOCK)
    starts = np.frombuffer(image, "<u4", n_blocks + 1, INDEX)[a:b].astype(np.int64)
    data = np.frombuffer(image, np.uint8, offset=INDEX + 4 * (n_blocks + 1))
    low = np.ascontiguousarray(data[_at(starts, 4)]).view("<u4").astype(np.uint32)
    width, count = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    rest = np.zeros((b - a, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        bits = np.unpackbits(data[_at(starts[own] + HEAD, BLOCK // 8 * w)], axis=1, bitorder="little").reshape(-1, BLOCK, w)
        value = np.zeros((len(own), BLOCK), np.uint32)
        for k in range(w):
            value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        rest[own] = value
    row = np.repeat(np.arange(b - a), count)
    at, rank = starts[row] + HEAD + BLOCK // 8 * width[row], _ranks(row)
    rest[row, data[at + rank]] = np.ascontiguousarray(data[_at(at + count[row] + 4 * rank, 4)]).view("<u4").ravel()
    return (rest + low).ravel()[first - a * BLOCK:stop - a * BLOCK]


class Words(dict):
    """Ids of words, encoded when they are first asked for. What came in the last two generations is held."""

    def __init__(self, ids_of_word: Callable[[bytes], bytes]):
        super().__init__()
        self.ids_of_word, self.older = ids_of_word, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.ids_of_word(word)
        if len(word) <= WORD_BYTES:
            self[word] = ids
        return ids

    def grow_old(self, most: int) -> None:
        """At more than ``most`` words, forget those that came only before the last such time."""
        if len(self) > most:
            self.older = dict(self)
            self.clear()

    def forget(self) -> None:
        self.older = {}
        self.clear()


class Encoder:
    """A tokenizer file of the tokenizers library, and the words encoded so far, one per worker process."""

    def __init__(self, path: str, words_apart: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one thread per task
        from tokenizers import Tokenizer

        self.tokenizer, self.words_apart, self.words = Tokenizer.from_file(path), words_apart, Words(self.ids_of_word)
        self.tokenizer.encode_special_tokens = True         # their strings in a text are ordinary text
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if words_apart:
            self.normal = self.tokenizer.normalizer
            if self.normal is None or self.normal.normalize_str(UPPER_AND_REST) != UPPER_AND_REST.lower():
                raise ValueError("the tokenizer keeps capitals: encode whole texts")
            both, one, other = self.ids_of(["a b", "a", "b"])
            if both != one + other:
                raise ValueError("the tokenizer joins words: encode whole texts")
            self.tokenizer.normalizer = None                # words are normalised here, where they need it
            self.model, self.pieces = self.tokenizer.model, self.letter_pieces()
            self.raw = [i.to_bytes(4, "little") for i in range(max(self.tokenizer.get_vocab().values()) + 1)]
            run = "".join(map(chr, self.pieces))
            self.stem = re.compile(f"{SIGNS}([{run}]+){SIGNS}" if run else "(?!)").fullmatch

    def letter_pieces(self) -> dict[int, str]:
        """What the tokenizer's normaliser and splitter make of single letters, if that is what they make of runs of them."""
        split, found = self.tokenizer.pre_tokenizer, {}
        for c in map(chr, LETTERS if split is not None else ()):
            small = self.normal.normalize_str(c)
            own = split.pre_tokenize_str(small) if c.isalpha() and small.isalpha() else []
            if len(own) == 1:
                found[ord(c)] = own[0][0]
        run = split.pre_tokenize_str(self.normal.normalize_str("".join(["-", *map(chr, found), "-"]))) if found else []
        return found if [p for p, _ in run] == ["-", "".join(found.values()), "-"] else {}

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of_word(self, word: bytes) -> bytes:
        """Ids of a word without white space and ASCII capitals.

        A run of letters goes to the library's model at once, since nothing before the model would change or part it; one
        with signs around it is made of its parts; other words go through the whole tokenizer.
        """
        text = word.decode()
        m = self.stem(text)
        if m is None:                   # ASCII in lower case is what the normaliser would make of it
            return self.ids_of([text if word.isascii() else self.normal.normalize_str(text)])[0]
        if len(m[2]) < len(text):
            return b"".join([self.words[p.encode()] for p in m.groups() if p])
        piece = text if word.isascii() else text.translate(self.pieces)
        return b"".join([self.raw[t.id] for t in self.model.tokenize(piece)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        if not self.words_apart:
            return self.ids_of(texts)
        out = []
        for text in texts:
            self.words.grow_old(CACHE_WORDS // 2)
            # Split at ASCII white space alone; other white space stays inside what is encoded together.
            out.append(b"".join(map(self.words.__getitem__, text.encode().translate(LOWER).split())))
        return out

    def encode_long(self, text: str) -> bytes:
        """The same for one text whose words are better not held at once: pieces of it that end at spaces."""
        if not self.words_apart:
            return self.encode([text])[0]
        out, start = [], 0
        while start < len(text):
            end = text.find(" ", start + CHUNK_CHARS)
            end = len(text) if end < 0 else end
            out += self.encode([text[start:end]])
            start = end
        return b"".join(out)


def byte_chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of some ``most`` bytes; a longer text is a stretch of its own. Holds no text."""
    sizes = np.asarray(pc.binary_length(texts), np.int64)
    part, long_ = np.cumsum(sizes) // most, sizes > most
    cuts = np.flatnonzero((part[1:] != part[:-1]) | long_[1:] | long_[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(sizes)]
    return zip(bounds[:-1], bounds[1:], strict=True) if len(sizes) else iter(())


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = None, words_apart: bool = False,
          id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES,
          segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of every whole text, in ascending order of ``id_col``, to ``folder`` (see above).

    Null and empty texts have no ids but ``end_id``, which follows every document. Null ids come first; rows of one id
    are ordered by a hash of their text, and equal rows, which are alike, by the task that read them, so that no id and
    no group of copies is one shard. Very long texts make segments of their own. Further columns are ignored whatever
    their names; no rows give two empty tables. ``words_apart`` says that the tokenizer lower-cases,
    drops white space, never joins what it separates and parts letters from signs, so that words can be encoded one by
    one and kept. Texts are read twice before, for their
    size and for the range bounds, and shuffled once, to the shard that writes them.
    """
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keyed = own.withColumn("tie", F.xxhash64("text")).withColumn("task", F.spark_partition_id())
    kind = own.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("token_files", tokenizer_path, words_apart), lambda: Encoder(tokenizer_path, words_apart))
        shard, first, number = TaskContext.get().partitionId(), 0, 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        names, counts, waiting, n = [], [], [], 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(waiting), "<u4")
            lists = [pa.array([v], pa.list_(t)) for v, t in ((pa.concat_arrays(names), id_type), (counts, pa.int64()))]
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([first], pa.int64()),
                 pa.array([n], pa.int64()), *lists, pa.array([pack(ids)], pa.binary())],
                names=["shard", "segment", "first", "n_ids", "doc_ids", "n_tokens", "data"])

        for batch in batches:
            id_type, column = batch.column(0).type, batch.column(1)
            keys = batch.column(0).take(pa.array(np.arange(len(batch))))    # a copy, which does not hold the texts
            for a, b in byte_chunks(column, CHUNK_CHARS):
                texts = column.slice(a, b - a).to_pylist()
                long_ = b - a == 1 and len(texts[0]) > CHUNK_CHARS
                for i, ids in enumerate([encoder.encode_long(texts[0])] if long_ else encoder.encode(texts), a):
                    names.append(keys.slice(i, 1))
                    waiting.append(ids + end)
                    counts.append(len(waiting[-1]) // 4)
                    n += counts[-1]
                    if n >= segment_ids:
                        yield segment()
                        first, number = first + n, number + 1
                        names, counts, waiting, n = [], [], [], 0
        if names:
            yield segment()
        encoder.words.forget()  # an idle worker holds no words
        pa.default_memory_pool().release_unused()

    placed = keyed.repartitionByRange(max(1, -(-size // shard_bytes)), "id", "tie", "task").sortWithinPartitions(
        "id", "tie", "task").select("id", "text")
    placed.mapInArrow(run, f"shard int, segment long, first long, n_ids long, doc_ids array<{kind}>, "
                           "n_tokens array<long>, data binary").write.parquet(f"{folder}/segments")
    spark = docs.sparkSession
    found = spark.read.parquet(f"{folder}/segments").groupBy("shard").agg(F.sum("n_ids").alias("n"))
    sizes = sorted(map(tuple, found.collect()))             # a row per shard, that is one per shard_bytes of text
    starts = np.cumsum([0, *[n for _, n in sizes]])
    spark.createDataFrame([(s, int(a)) for (s, _), a in zip(sizes, starts[:-1], strict=True)],
                          "shard int, start long").coalesce(1).write.parquet(f"{folder}/shards")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document written: ids before it, number of its ids, and the ids
    themselves as little-endian unsigned 32-bit integers, unpacked from the blocks."""
    segments, shards = (spark.read.parquet(f"{folder}/{t}") for t in ("segments", "shards"))
    rows = segments.join(F.broadcast(shards), "shard").select(      # a row of 12 bytes per shard
        (F.col("start") + F.col("first")).alias("start"), "doc_ids", "n_tokens", "data")
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                start, names, counts, data = (batch.column(c)[k] for c in range(4))
                raw = unpack(data.as_py()).astype("<u4").tobytes()
                counts = np.array(counts.values)
                ends = np.cumsum(counts)
                ids = [raw[4 * a:4 * b] for a, b in zip(ends - counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(start.as_py() + ends - counts), pa.array(counts), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")


def read_span(spark: SparkSession, folder: str, start: int, n: int) -> np.ndarray:
    """``n`` ids from position ``start`` of all ids on (fewer at the end): a training step's reading. Only segments that
    overlap are read, and of them only the blocks that do."""
    segments, shards = (spark.read.parquet(f"{folder}/{t}") for t in ("segments", "shards"))
    near = shards.filter(F.col("start") < start + n).orderBy(F.desc("start"))
    last = near.filter(F.col("start") <= start).first()
    if last is None:
        return np.zeros(0, np.uint32)
    found = segments.join(F.broadcast(near.filter(F.col("start") >= last["start"])), "shard").withColumn(
        "at", F.col("start") + F.col("first")).filter((F.col("at") < start + n) & (F.col("at") + F.col("n_ids") > start))
    parts = [unpack(r.data, max(0, start - r.at), start + n - max(start, r.at))
             for r in sorted(found.select("at", "data").collect(), key=lambda r: r.at)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
