"""Ranked lexical search, term at a time with a limited number of accumulators.

Documents become shards of an index: the postings of every term that some item asks for, and the length of every
document. A task takes shards one after the other and answers all items on each. An item's terms come rarest first;
every posting opens or adds to the accumulator of its document. Once the bounds of the terms still to come, the largest
that any posting of the shard gives, add up to less than the score in place k so far (of this shard's partial scores
and of what the task has found before), no document without an accumulator can enter the first k, not even by a tie, and
no more are opened. The survivors are still updated with all further terms, so that the scores that come out are exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import stored, text_or_empty

# Fixed by the contract: what is not in a term, and how a score is made.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IN_TERM = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256)).lower()

SHARD_DOCS, SHARD_BYTES = 1 << 14, 64 << 20     # documents and bytes of text in a shard
GROUP_TERMS = 1 << 20                           # (item, term) pairs that are sent to every task at once
LAST = (1 << 63) - 1                            # where null ids come

INDEX = ("doc_ids binary, n_words binary, terms array<int>, counts array<int>, places binary, times binary, "
         "n_docs long, all_words long")


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


def build_index(docs: DataFrame, vocabulary: list[str], shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row per shard of (id, text): ids and numbers of words of its documents that have any, and for every term of
    the vocabulary (by number) that occurs in it, how many documents hold it, which and how often."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        names, sizes, terms, places, times, n_bytes = [], [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            term, place, time = (np.array(x, np.int64) for x in (terms, places, times))
            order = np.argsort(term, kind="stable")
            found, count = np.unique(term, return_counts=True)
            n_words = np.array(sizes, "<i8")
            row = {"doc_ids": np.array(names, "<i8").tobytes(), "n_words": n_words.tobytes(),
                   "terms": found.tolist(), "counts": count.tolist(), "places": place[order].astype("<u4").tobytes(),
                   "times": time[order].astype("<u4").tobytes(), "n_docs": len(names), "all_words": int(n_words.sum())}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.encode().translate(IN_TERM).split()
                if not words:
                    continue
                count = Counter(words)
                for term in count.keys() & number.keys():
                    terms.append(number[term])
                    places.append(len(names))
                    times.append(count[term])
                names.append(name)
                sizes.append(len(words))
                n_bytes += len(text)
                if len(names) >= shard_docs or n_bytes >= SHARD_BYTES:
                    yield shard()
                    names, sizes, terms, places, times, n_bytes = [], [], [], [], [], 0
        if names:
            yield shard()

    schema = pa.schema([("doc_ids", pa.binary()), ("n_words", pa.binary()), ("terms", pa.list_(pa.int32())),
                        ("counts", pa.list_(pa.int32())), ("places", pa.binary()), ("times", pa.binary()),
                        ("n_docs", pa.int64()), ("all_words", pa.int64())])
    return docs.mapInArrow(run, INDEX)


def length_factors(n_words: np.ndarray, n_docs: int, all_words: int) -> np.ndarray:
    """m of every document: 50 plus half its length in percent of the mean length."""
    if 50 * int(n_words.max(initial=0)) * n_docs > LAST:        # beyond 64 bits: Python's integers
        return np.array([50 + 50 * n * n_docs // all_words for n in n_words.tolist()], np.int64)
    return 50 + 50 * n_words * n_docs // all_words


class Answers:
    """The best ``k`` (score, doc id) of every item so far."""

    def __init__(self, items: list[list[tuple[int, int]]], k: int):
        self.items, self.k = items, k                           # per item (term, weight), rarest first
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]
        self.opened = self.postings = 0                         # accumulators, and postings met

    def take(self, doc_ids: np.ndarray, postings: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """One shard, with (place, impact) of the postings of every term in it; an impact times a weight is a score."""
        top = {t: int(impact.max()) for t, (_, impact) in postings.items()}
        for i, item in enumerate(self.items):
            own = [(t, w) for t, w in item if t in postings]
            if own:
                self.best[i] = self.answer(own, doc_ids, postings, top, *self.best[i])

    def answer(self, terms: list, doc_ids: np.ndarray, postings: dict, top: dict, scores: np.ndarray,
               names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to_come = np.cumsum([w * top[t] for t, w in terms][::-1])[::-1]
        partial, live = np.zeros(len(doc_ids), np.int64), np.zeros(len(doc_ids), bool)
        opening, kth = True, int(scores.min()) if len(scores) == self.k else 0
        for (t, w), bound in zip(terms, to_come, strict=True):
            place, impact = postings[t]
            self.postings += len(place)
            opening = opening and bound >= kth
            if opening:
                live[place] = True
            else:
                seen = live[place]
                place, impact = place[seen], impact[seen]
            partial[place] += w * impact
            if opening:
                now = np.concatenate([partial[live], scores])
                if len(now) >= self.k:
                    kth = int(np.partition(now, len(now) - self.k)[len(now) - self.k])
        self.opened += int(live.sum())
        good = np.flatnonzero(live & (partial > 0))
        scores, names = np.concatenate([scores, partial[good]]), np.concatenate([names, doc_ids[good]])
        if len(scores) > self.k:
            scores, names = (x[np.lexsort((names, -scores))[:self.k]] for x in (scores, names))
        return scores, names


def search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", shard_docs: int = SHARD_DOCS,
           group_terms: int = GROUP_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for every item, all if fewer.

    Terms are the maximal runs of ASCII letters and digits and of characters beyond ASCII, only A-Z lower-cased. The
    score is that of the query's contract: integer impacts times integer weights of an item's terms, once each. Null
    and empty texts have no terms and are never found; items without terms find nothing; rows of one item id are one
    item with the terms of all. Repeated documents are found each; equal scores come by ascending id, null ids (and
    those of the largest 64-bit value) last. Ids are whole numbers. Very long texts count as a whole. Further columns
    are ignored whatever their names; no documents or no items give no rows.

    The documents are read once for every ``group_terms`` (item, term) pairs, without a shuffle: a shard is what one
    task reads, so a source or a group of copies of any size is spread as its rows are. Items, their weights and the
    vocabulary go to every task; that is at most ``group_terms`` entries (more only if a single item has more terms).
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), text_or_empty(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item_id"), F.explode(terms_of(F.col(item_text_col))).alias("term")).distinct()
    asked = stored(asked)
    kind = asked.schema["item_id"].dataType.simpleString()
    n_groups = max(1, -(-asked.count() // group_terms))
    group = F.pmod(F.xxhash64("item_id"), F.lit(n_groups))
    found = [_search_group(own, asked.filter(group == g), kind, k, shard_docs) for g in range(n_groups)]
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "score")


def _search_group(docs: DataFrame, asked: DataFrame, kind: str, k: int, shard_docs: int) -> DataFrame:
    """Candidates (item_id, doc_id, score), k at most for each item and task, of items that every task can hold."""
    spark = docs.sparkSession
    of_item = [(r.item_id, r.terms) for r in asked.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()]
    vocabulary = sorted({t for _, terms in of_item for t in terms})
    number = {t: i for i, t in enumerate(vocabulary)}
    index = stored(build_index(docs, vocabulary, shard_docs))
    n_docs, all_words = index.agg(F.sum("n_docs"), F.sum("all_words")).first()
    n_docs, all_words = n_docs or 0, all_words or 0
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("x.*")
    df = dict(map(tuple, pairs.groupBy("terms").agg(F.sum("counts")).collect()))        # the vocabulary at most
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    listed = [sorted((number[t] for t in terms if number[t] in df), key=lambda t: (df[t], t)) for _, terms in of_item]
    shared = spark.sparkContext.broadcast(
        ([name for name, _ in of_item], [[(t, weight[t]) for t in terms] for terms in listed]))

    id_type = to_arrow_type(asked.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists = shared.value
        answers = Answers(lists, k)
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, n_words = (np.frombuffer(row[c], "<i8") for c in ("doc_ids", "n_words"))
                places, times = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("places", "times"))
                m = length_factors(n_words, n_docs, all_words)
                impact = 1_000_000_000 * times // (1000 * times + 20 * m[places])
                ends = np.cumsum(row["counts"])
                answers.take(doc_ids, {t: (places[e - n:e], impact[e - n:e])
                                       for t, n, e in zip(row["terms"], row["counts"], ends, strict=True)})
        for name, (scores, ids) in zip(names, answers.best, strict=True):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ids), id_type), pa.array(ids), pa.array(scores)],
                    names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, f"item_id {kind}, doc_id long, score long")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS r
  FROM documents WHERE text IS NOT NULL
), sized AS (
  SELECT r, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0
), totals AS (
  SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS all_words FROM sized
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), held AS (
  SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held CROSS JOIN totals GROUP BY term, n_docs
), scored AS (
  SELECT a.item_id, h.r, s.doc_id,
    sum(w.w * ((1000000000 * h.tf) // (1000 * h.tf + 20 * (50 + (50 * s.n * t.n_docs) // t.all_words))))::BIGINT AS score
  FROM asked a JOIN held h USING (term) JOIN weights w USING (term) JOIN sized s ON s.r = h.r CROSS JOIN totals t
  GROUP BY a.item_id, h.r, s.doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS "rank",
    doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, "rank", doc_id, score FROM ranked WHERE "rank" <= 50
"""
