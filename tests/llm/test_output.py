"""Token files, lexical search and periodic runs against a library, SQL or plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from listwarden.llm import lexical_search, periodic_runs, queries, token_files

from .helpers import awkward, table

WORDS = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 40), st.integers(0, 2**32 - 1)), max_size=1200), st.integers(0, 1300), st.integers(0, 600))
def test_blocks_round_trip(ids, first, n):
    ids = np.array(ids, np.uint32)
    image = token_files.pack(ids)
    assert token_files.unpack(image).tolist() == ids.tolist()
    assert token_files.unpack(image, first, n).tolist() == ids[first:first + n].tolist()


def test_blocks_are_packed_at_the_percentile():
    ids = np.arange(2560, dtype=np.uint32) % 7 + 1000
    ids[::100] = 49_000
    assert len(token_files.pack(ids)) < 16 + 11 * 4 + 10 * (6 + 96 + 5 * 3) + 1


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(WORDS)
    own.encode_special_tokens = True
    return own


@pytest.fixture(scope="module")
def encoder():
    return token_files.Encoder(WORDS, True)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("a 's\n\t\x0b\x1c\x1f\x85\xa0 \u3000\u0301ΣσİIA9"))))
def test_words_alone_give_the_same_ids(tokenizer, text):
    got = np.frombuffer(token_files.Encoder(WORDS, True).encode([text])[0], "<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeéÉßŸſǅжЖΣςİ\u212a\u0301\u0338'sd-\"(.,|<>9 \x1c"), max_size=8), max_size=40))
def test_letters_with_signs_around_them(tokenizer, encoder, texts):
    assert encoder.encode(texts) == [
        np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_that_come_again_are_not_encoded_again(tokenizer, encoder, monkeypatch):
    asked, whole, of_word, of_texts = [], [], encoder.ids_of_word, encoder.ids_of
    monkeypatch.setattr(encoder, "words", token_files.Words(lambda w: asked.append(w) or of_word(w)))
    monkeypatch.setattr(encoder, "ids_of", lambda texts: whole.extend(texts) or of_texts(texts))
    monkeypatch.setattr(token_files, "CACHE_WORDS", 40)
    texts = [f"the Été, {'ab' * (i % 20 + 1)} \"жук\" {'x' * 100} it's" for i in range(200)]
    assert encoder.encode(texts) == [
        np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for word in ("the", "Été,", "it's"):                        # though the words held were given up several times
        assert asked.count(word.encode()) == 1
    assert set(whole) == {",", '"', "it's"}                     # letters go to the model alone
    assert len(encoder.words) + len(encoder.words.older) <= 60


def test_stretches_of_bytes():
    texts = ["a" * n for n in (3, 4, 0, 50, 2, 2, 2, 2, 2, 11, 11)] + ["é" * 6]
    got = list(token_files.byte_chunks(pa.array(texts), 10))
    assert [a for a, _ in got] + [12] == [0] + [b for _, b in got]
    for a, b in got:
        sizes = [len(t.encode()) for t in texts[a:b]]
        assert sum(sizes) <= 20 and max(sizes) <= 10 or len(sizes) == 1
    assert list(token_files.byte_chunks(pa.array([], pa.string()), 10)) == []


def test_token_files(spark, tokenizer, tmp_path):
    rows = awkward(4) + [(500, "same text", "en", "a")] * 80 + [(501, "<|endoftext|> Ünï\u0301", "en", "a"), (502, "wort " * 150_000, "de", "b")]
    folder = str(tmp_path / "ids")
    token_files.write(table(spark, rows).repartition(5), folder, WORDS, end_id=1, words_apart=True, shard_bytes=20_000, segment_ids=900)
    got = sorted(map(tuple, token_files.read(spark, folder).collect()), key=lambda r: r[1])
    ids = [np.frombuffer(r[3], "<u4").tolist() for r in got]
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r[1] for r in got] == [sum(map(len, ids[:i])) for i in range(len(ids))]
    assert [r[2] for r in got] == [len(x) for x in ids]
    want = [(str(r[0]), *tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1) for r in rows]
    assert Counter(want) == Counter((str(r[0]), *x) for r, x in zip(got, ids, strict=True))
    flat = [i for x in ids for i in x]
    for start, n in ((0, 10), (len(flat) - 5, 50), (1234, 4321), (len(flat), 3), (7, len(flat))):
        assert token_files.read_span(spark, folder, start, n).tolist() == flat[start:start + n]
    one = str(tmp_path / "whole")
    token_files.write(table(spark, rows), one, WORDS, end_id=1)      # whole texts, one shard
    assert Counter((str(r.doc_id), *np.frombuffer(r.ids, "<u4").tolist()) for r in token_files.read(spark, one).collect()) == Counter(want)
    none = str(tmp_path / "none")
    token_files.write(table(spark, rows).limit(0), none, WORDS)
    assert token_files.read(spark, none).count() == 0 and len(token_files.read_span(spark, none, 0, 5)) == 0


def brute_search(docs, items, k):
    def terms(text):
        return re.findall(lexical_search.TERM, (text or "").translate(str.maketrans(lexical_search.UPPER, lexical_search.LOWER)))

    own = [(i, Counter(t), len(t)) for i, t in ((d[0], terms(d[1])) for d in docs) if t]
    n_docs, words, df = len(own), sum(n for _, _, n in own), Counter(t for _, c, _ in own for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c, n in own:
            m = 50 + 50 * n * n_docs // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in wanted if t in c)
            if score > 0:
                scores.append((score, i))
        scores.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(item, r, i, s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def test_search(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Über", "ÜBER", "a-b", "日本", "x_y"]
    rows = awkward(5) + [(1000 + i, " ".join(rng.choices(words, k=rng.randint(1, 40))), "en", "a") for i in range(300)]
    rows += [(2000 + i, rows[70][1], "en", "a") for i in range(150)]                # one group of copies: ties
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(15)] + [
        (20, None), (21, "nowhere"), (22, "the und"), (22, "w1 w2"), (None, "w3 über"), (23, rows[70][1]), (24, "- _")]
    asked = spark.createDataFrame([(*r, "x", 1) for r in items], "item_id long, text string, term string, doc_id int")
    for docs, k, size, groups in ((table(spark, rows).repartition(3), 7, 40, 25), (table(spark, rows), 50, 10_000, 1 << 20)):
        got = lexical_search.search(docs, asked, k, shard_docs=size, group_terms=groups)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_search(rows, items, k)))
    assert lexical_search.search(table(spark, rows).limit(0), asked).count() == 0
    assert lexical_search.search(table(spark, rows), asked.limit(0)).count() == 0


def test_search_sql_states_the_same(tmp_path):
    rows = [r for r in awkward(6)]
    items = [(1, "the of Zug"), (2, "日本 x1"), (3, None), (4, "...")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    assert sorted(map(str, con.execute(lexical_search.ORACLE).fetchall())) == sorted(map(str, brute_search(rows, items, 50)))


def test_no_accumulators_are_opened_once_they_cannot_matter():
    terms = [(0, 9000), (1, 3000), (2, 10)]
    places = {0: np.arange(5), 1: np.arange(20), 2: np.arange(1000)}
    answers = lexical_search.Answers([terms], 5)
    answers.take(np.arange(1000), {t: (p, np.full(len(p), 10**6 // (t + 1))) for t, p in places.items()})
    assert answers.opened == 5 and answers.best[0][1].tolist() == [0, 1, 2, 3, 4]
    assert answers.best[0][0].tolist() == [9000 * 10**6 + 3000 * 500_000 + 10 * 333_333] * 5


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), st.integers(1, 9)), max_size=8).map(
    lambda parts: [w for root, n in parts for w in root * n]), st.lists(st.sampled_from([b"a", b"b"]), max_size=60))
def test_runs_of_words(one, two):
    got = periodic_runs.find_runs([one, [], two, one])
    for words, (start, length, q) in zip([one, [], two, one], got, strict=True):
        assert list(zip(start.tolist(), length.tolist(), q.tolist(), strict=True)) == brute_runs(words)


def test_periodic_runs_table_and_query(spark, tmp_path):
    rng = random.Random(8)
    rows = awkward(7) + [(2000 + i, " ".join(rng.choices(["x", "y"], k=80)), "en", "a") for i in range(60)]
    rows += [(3000 + i, " ".join(rng.choices("abcdefgh", k=rng.randint(1, 90))), "en", "a") for i in range(120)]
    rows += [(4000, "a b\xa0c \n" * 30_000 + "end", "en", "a"), (4001, " ".join(map(str, range(40))) + " q" * 9, "en", "a")]
    df = table(spark, rows).withColumn("runs", F.lit(1)).repartition(3)
    got = periodic_runs.periodic_runs(df).collect()
    want = Counter()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        runs = brute_runs(words) if len(words) < 3000 else [(0, 60_000, 2)] if r[0] == 4000 else [(0, 4000, 1)]
        want[str((r[0], len(words), runs, brute_collapsed(words, runs)))] += 1
    assert Counter(str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got) == want
    assert all(r.rank == "k" for r in got) and periodic_runs.periodic_runs(df.limit(0)).count() == 0
    # The query: planted texts, then the digests.
    small = [r for r in rows if len(r[1] or "") < 3000]
    table(spark, small).write.parquet(str(tmp_path / "documents.parquet"))
    want = Counter()
    for r in small:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        h = zlib.crc32(str(r[0]).encode()) if r[0] is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        s, length, q = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want[str((r[0], len(runs), s, length, q, length and 1000 * length // q, hashlib.sha256(lines.encode()).hexdigest(),
                  hashlib.sha256(brute_collapsed(words, runs).encode()).hexdigest()))] += 1
    got = Counter(str(tuple(r)) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect())
    assert got == want
