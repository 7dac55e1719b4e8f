"""Language ID by unigram pieces with every segmentation of a text summed over."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import hash_sample, kept, stored

# The model is fitted on about FIT_ROWS labelled rows, chosen by a seeded hash; prediction reads everything.
FIT_ROWS, ROUNDS, PRIOR = 4000, 4, 0.05
CACHE_WORDS, CHUNK_CHARS, LOOKUP_WORDS = 300_000, 2_000_000, 20_000
LONG_WORD = 128     # longer words are cut where no piece crosses
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
TINY = 1e-120
LETTER = regex.compile(r"\p{L}")
MARK = "▁"     # stands for the space before a word in the vocabulary


def vocabulary(model_path: str) -> list[str]:
    """Pieces of a public sentencepiece file; control and byte pieces stand for nothing here."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return ["" if model.is_control(i) or model.is_byte(i) or model.is_unknown(i) else model.id_to_piece(i)
            for i in range(model.get_piece_size())]


class Pieces:
    """Finds vocabulary pieces inside many words at once by rolling hashes of their characters."""

    def __init__(self, model_path: str):
        pieces = vocabulary(model_path)
        self.unknown = len(pieces)              # any character without a piece of its own
        self.size = len(pieces) + 1
        known = {i: p for i, p in enumerate(pieces) if p and MARK not in p[1:]}
        self.longest = max(map(len, known.values()))
        self.tables = {}
        for length in range(1, self.longest + 1):
            own = [(self.hashes([p])[0][0, length], i) for i, p in known.items() if len(p) == length]
            own.sort()
            self.tables[length] = (np.array([h for h, _ in own], np.uint64), np.array([i for _, i in own], np.int64))
        self.powers = [pow(int(MULTIPLIER), k, 1 << 64) for k in range(self.longest + 1)]

    @staticmethod
    def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every prefix of every word, and the words' lengths."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        codes = np.zeros((len(words), width), np.uint64)
        codes[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32)
        out = np.zeros((len(words), width + 1), np.uint64)
        for i in range(width):
            out[:, i + 1] = out[:, i] * MULTIPLIER + codes[:, i] + np.uint64(1)
        return out, sizes

    def found(self, words: list[str]) -> tuple[list[tuple[int, int, np.ndarray, np.ndarray]], np.ndarray]:
        """(end, start, rows, piece ids) of all pieces in order of their end; lengths. Unknown characters are pieces."""
        prefix, sizes = self.hashes(words)
        out = []
        for end in range(1, prefix.shape[1]):
            rows_here = np.flatnonzero(sizes >= end)
            for length in range(1, min(end, self.longest) + 1):
                keys, ids = self.tables[length]
                start = end - length
                value = prefix[rows_here, end] - prefix[rows_here, start] * np.uint64(self.powers[length])
                if not len(keys):
                    at, hit = np.zeros(len(value), np.int64), np.zeros(len(value), bool)
                else:
                    at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                    hit = keys[at] == value
                if length == 1:
                    out.append((end, start, rows_here, np.where(hit, ids[at], self.unknown)))
                elif hit.any():
                    out.append((end, start, rows_here[hit], ids[at[hit]]))
        return out, sizes

    def cut(self, word: str) -> list[str]:
        """``word`` cut at every place that no piece of two or more characters crosses.

        A segmentation of the word is one of each part, so the sum over all is the product of the parts' sums.
        """
        codes = np.frombuffer(word.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) + np.uint64(1)
        n, value, crossed = len(codes), np.zeros(len(codes), np.uint64), np.zeros(len(codes) + 1, np.int64)
        for length in range(1, min(self.longest, n) + 1):
            value = value[:n - length + 1] * MULTIPLIER + codes[length - 1:]
            keys = self.tables[length][0]
            if length > 1 and len(keys):
                at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
                starts = np.flatnonzero(keys[at] == value)
                crossed[starts + 1] += 1
                crossed[starts + length] -= 1
        free = np.flatnonzero(np.cumsum(crossed)[:n] == 0).tolist()     # 0 is one: nothing crosses the beginning
        return [word[a:b] for a, b in zip(free, free[1:] + [n], strict=True)]


def pieces_of(model_path: str) -> Pieces:
    return kept(("pieces", model_path), lambda: Pieces(model_path))


def forward(found: list, sizes: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum over all segmentations of every prefix, (word, position, language); logs of the scale; logs of the totals.

    ``chances`` is (piece, language). Where sums get tiny a word's running sums are scaled up, so length is no limit.
    """
    n, width, langs = len(sizes), int(sizes.max()), chances.shape[1]
    sums = np.zeros((n, width + 1, langs))
    sums[:, 0] = 1
    scale = np.zeros((n, width + 1, langs))     # log of the factor that a position's sums were multiplied by
    last = 0
    for end, start, rows, ids in found:
        if end != last and last:
            _rescale(sums, scale, last)
        last = end
        shift = scale[rows, end] - scale[rows, start]
        step = sums[rows, start] * chances[ids]
        sums[rows, end] += step if end < 8 else step * np.exp(shift)
    if last:
        _rescale(sums, scale, last)
    at = np.arange(n)
    return sums, scale, np.log(sums[at, sizes]) - scale[at, sizes]


def _rescale(sums: np.ndarray, scale: np.ndarray, at: int) -> None:
    small = (sums[:, at] < TINY) & (sums[:, at] > 0)
    if small.any():
        factor = np.where(small, 1 / np.where(small, sums[:, at], 1), 1.0)
        sums[:, at] *= factor
        scale[:, at] += np.log(factor)
    if at + 1 < scale.shape[1]:
        scale[:, at + 1] = scale[:, at]


def expected_counts(pieces: Pieces, words: list[str], weights: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of weighted words of one language (the E step)."""
    found, sizes = pieces.found(words)
    sums, scale, totals = forward(found, sizes, chances[:, None])
    width = int(sizes.max())
    back = np.zeros((len(words), width + 1))
    back_scale = np.zeros((len(words), width + 1))
    back[np.arange(len(words)), sizes] = 1
    out = np.zeros(pieces.size)
    last = width + 1
    for end, start, rows, ids in sorted(found, key=lambda f: -f[0]):
        if end != last:
            # All pieces that start here have been added: they end further right.
            tiny = (back[:, end] < TINY) & (back[:, end] > 0)
            if tiny.any():
                back_scale[tiny, end] -= np.log(back[tiny, end])
                back[tiny, end] = 1
            last = end
        ahead = np.log(np.maximum(back[rows, end], 1e-300)) - back_scale[rows, end]
        use = np.exp(np.log(np.maximum(sums[rows, start, 0], 1e-300)) - scale[rows, start, 0] + np.log(chances[ids])
                     + ahead - totals[rows, 0])
        np.add.at(out, ids, use * weights[rows] * (back[rows, end] > 0))
        # Bring the start's sum to the end's scale before adding.
        empty = back[rows, start] == 0
        back_scale[rows, start] = np.where(empty, back_scale[rows, end], back_scale[rows, start])
        back[rows, start] += back[rows, end] * chances[ids] * np.exp(back_scale[rows, start] - back_scale[rows, end])
    return out


class Model:
    """Learned languages and log-free piece chances, (piece, language)."""

    def __init__(self, model_path: str, langs: list[str], chances: np.ndarray):
        self.model_path, self.langs, self.chances = model_path, langs, chances

    def digest(self) -> str:
        return hashlib.sha256(repr((self.model_path, self.langs)).encode() + self.chances.tobytes()).hexdigest()


def _words(text: Column) -> Column:
    return F.explode(F.split(text, r"\s+"))


def fit(labelled: DataFrame, model_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Piece chances per language by EM over the word counts of about ``fit_rows`` labelled rows.

    Rows without text or language teach nothing. The E step runs on the executors; what comes back is one number per
    piece and language. Without any labelled row there is no language, and every text is undetermined.
    """
    rows = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = hash_sample(rows, fit_rows, "id", "lang", "text", seed=seed)
    counts = stored(rows.select("lang", _words(F.col("text")).alias("word")).filter("word <> ''").groupBy(
        "lang", "word").agg(F.count(F.lit(1)).cast("double").alias("n")))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())    # about fit_rows values at most
    size = pieces_of(model_path).size
    chances = np.full((size, len(langs)), 1.0 / size)

    def estimate(current: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pieces, out = pieces_of(model_path), np.zeros((size, len(langs)))
            for batch in batches:
                for lang, group in batch.groupby("lang"):
                    words, n, k = [MARK + w for w in group["word"]], group["n"].to_numpy(), langs.index(lang)
                    order = sorted(range(len(words)), key=lambda i: len(words[i]))
                    for a, b in chunks([words[i] for i in order], 200_000):
                        part = order[a:b]
                        out[:, k] += expected_counts(pieces, [words[i] for i in part], n[part], current[:, k])
            at = np.nonzero(out)
            yield pd.DataFrame({"piece": at[0], "k": at[1], "n": out[at]})
        return run

    for _ in range(rounds):
        total = counts.mapInPandas(estimate(chances), "piece long, k long, n double").groupBy("piece", "k").agg(
            F.sum("n").alias("n")).toPandas()                                   # pieces x languages at most
        fresh = np.full_like(chances, PRIOR)
        np.add.at(fresh, (total["piece"].to_numpy(), total["k"].to_numpy()), total["n"].to_numpy())
        chances = fresh / fresh.sum(axis=0)
    return Model(model_path, langs, chances)


class Scorer:
    """Log chance of every word seen so far under every language, one table per worker process."""

    def __init__(self, model: Model):
        self.model, self.at, self.table = model, {}, np.zeros((1024, len(model.langs)), np.float32)
        self.pieces = Pieces(model.model_path)

    def learn(self, words: set[str]) -> None:
        if len(self.at) > CACHE_WORDS:
            self.at.clear()
        fresh = sorted(words.difference(self.at), key=len)
        need = len(self.at) + len(fresh)
        if need > len(self.table):
            self.table = np.vstack([self.table, np.zeros((2 * need - len(self.table), self.table.shape[1]), np.float32)])
        for a, b in chunks(fresh, LOOKUP_WORDS * 10):
            part = fresh[a:b]
            found, sizes = self.pieces.found([w[1:] if w[0] == " " else MARK + w for w in part])
            start = len(self.at)
            self.table[start:start + len(part)] = forward(found, sizes, self.model.chances)[2]
            self.at.update(zip(part, range(start, start + len(part)), strict=True))

    def parts(self, words: list[str]) -> list[str]:
        """Long words in parts, as texts without spaces are; a part begins with a space, which no word does."""
        return [p for w in words for p in (
            [" " + p for p in self.pieces.cut(MARK + w)] if len(w) > LONG_WORD else (w,))]

    def score(self, texts: list[str]) -> np.ndarray:
        split = [t.split() for t in texts]
        split = [self.parts(words) if max(map(len, words), default=0) > LONG_WORD else words for words in split]
        self.learn({w for words in split for w in words})
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter((self.at[w] for words in split for w in words), np.int64, int(sizes.sum()))
        sums = np.concatenate([np.zeros((1, len(self.model.langs))), np.cumsum(self.table[at], axis=0, dtype=np.float64)])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]


def predict(docs: DataFrame, model: Model, key: str, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with lang_pred and score (chance of that language among the learned ones, 0 to 1).

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. Only the text decides; repeated
    rows and further columns stay, columns called lang_pred or score are replaced. No shuffle. ``key`` and the
    model's digest tell models of one application apart.
    """
    rest = docs.drop("lang_pred", "score")
    at = rest.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)
    digest = model.digest()
    shared = docs.sparkSession.sparkContext.broadcast((model.model_path, model.langs, model.chances))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(("scorer", key, digest), lambda: Scorer(Model(*shared.value)))
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in chunks(texts, CHUNK_CHARS):
                letters = np.array([LETTER.search(t) is not None for t in texts[a:b]], bool)
                names, score = ["und"] * (b - a), np.zeros(b - a)
                if own.model.langs:
                    logs = own.score(texts[a:b])
                    best = logs.argmax(axis=1)
                    score = np.where(letters, 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1), 0.0)
                    names = [own.model.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names), pa.array(score)],
                                                 names=[*part.schema.names, "lang_pred", "score"])

    return rest.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
