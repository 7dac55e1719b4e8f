import math
import re
import time
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listwarden.llm import bpe, language, pii
from listwarden.llm.queries import PIECES, RANKS, op1_language, op8_byte_bpe

from .helpers import awkward, table


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab 1\n", max_size=200))
def test_bpe_equals_library(encoder, reference, text):
    ids = encoder.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text) and encoder.decode(ids) == text.encode()


def test_bpe_long_pieces(encoder, reference):
    for text in ("a" * 3000, "abc" * 700 + "é" * 50, "<|endoftext|> x" * 20):
        ids = encoder.encode_long(text)
        assert ids == encoder.encode([text])[0] and np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)


def test_bpe_rows(spark, reference):
    df = table(spark, awkward()).withColumn("ids", F.lit("x"))
    rows = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == reference.encode_ordinary(r.text or "")
        assert bytes(r.decoded).decode() == (r.text or "") and r.rank == "k"
    both = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded_col="rank").collect()
    assert sorted(bytes(r.ids) for r in both) == sorted(bytes(r.ids) for r in rows)
    assert all(bytes(r.rank).decode() == (r.text or "") for r in both)
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_query_covers_all_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = op8_byte_bpe(spark, folder).join(docs.select("doc_id", F.sha2("text", 256).alias("own")), "doc_id")
    assert got.filter("decoded_sha256 = own").count() == docs.count()


def brute_chance(word, chances, k, pieces):
    ids = {p: i for i, p in enumerate(language.vocabulary(PIECES)) if p and language.MARK not in p[1:]}
    sums = [Fraction(1)] + [Fraction(0)] * len(word)
    for end in range(1, len(word) + 1):
        for n in range(1, end + 1):
            i = ids.get(word[end - n:end], pieces.unknown if n == 1 else None)
            if i is not None:
                sums[end] += sums[end - n] * Fraction(float(chances[i, k]))
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_forward_sums_all_segmentations():
    pieces, rng = language.pieces_of(PIECES), np.random.default_rng(0)
    chances = rng.random((pieces.size, 2))
    chances /= chances.sum(axis=0)
    words = ["▁the", "▁über", "x", "▁" + "ab" * 200, "日本"]
    found, sizes = pieces.found(words)
    logs = language.forward(found, sizes, chances)[2]
    for word, row in zip(words, logs, strict=True):
        assert np.allclose(row, [brute_chance(word, chances, k, pieces) for k in (0, 1)], rtol=1e-9)
    # Expected uses are the derivative of the log chance by the log of a piece's chance.
    for word in words[:4]:
        uses = language.expected_counts(pieces, [word], np.ones(1), chances[:, 0])
        found, sizes = pieces.found([word])
        for i in np.argsort(-uses)[:3]:
            moved = chances.copy()
            moved[i, 0] *= 1 + 1e-6
            slope = (language.forward(found, sizes, moved)[2][0, 0] - language.forward(found, sizes, chances)[2][0, 0]) / 1e-6
            assert abs(slope - uses[i]) < 1e-3 * max(1, uses[i])


def test_words_are_cut_where_no_piece_crosses():
    pieces, rng = language.pieces_of(PIECES), np.random.default_rng(1)
    chances = rng.random((pieces.size, 2))
    chances /= chances.sum(axis=0)
    words = ["▁" + "".join(rng.choice(list("日本語の文章は空白がない。、abc\U0001f600"), 300)), "▁" + "ab" * 100, "x"]
    for word in words:
        parts = pieces.cut(word)
        assert "".join(parts) == word and all(parts)
        found, sizes = pieces.found(parts)
        logs = language.forward(found, sizes, chances)[2].sum(axis=0)
        assert np.allclose(logs, [brute_chance(word, chances, k, pieces) for k in (0, 1)], rtol=1e-9)
    scorer = language.Scorer(language.Model(PIECES, ["a", "b"], chances))
    text = words[0][1:] + " the " + words[1][1:]
    want = [sum(brute_chance(w, chances, k, pieces) for w in (words[0], "▁the", words[1])) for k in (0, 1)]
    assert np.allclose(scorer.score([text, "", "the"])[0], want, rtol=1e-5)
    begin = time.process_time()
    scorer.score(["".join(rng.choice(list("日本語の文章は空白がない。、"), 20_000))])
    assert time.process_time() - begin < 1


def test_language_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = op1_language(spark, folder).join(docs, "doc_id").filter("held_out and lang is not null")
    right, total = got.filter("lang = lang_pred").count(), got.count()
    assert total > 100 and right >= 0.98 * total


def test_language_awkward_rows(spark):
    df = table(spark, awkward()).withColumn("score", F.lit("x"))
    model = language.fit(df.filter(~language.held_out()), PIECES)
    rows = language.predict(df, model, "awkward").collect()
    assert len(rows) == df.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    numbers = table(spark, [(1, "½ ²", "en", "a"), (2, "①② Ⅷ 12", None, "a"), (3, "_ ^ 5", "de", "b")])
    assert {(r.lang_pred, r.score) for r in language.predict(numbers, model, "numbers").collect()} == {("und", 0.0)}
    nothing = language.fit(df.limit(0), PIECES)
    assert {r.lang_pred for r in language.predict(df, nothing, "nothing").collect()} == {"und"}
    assert language.predict(df.limit(0), model, "awkward").count() == 0


def test_models_of_one_key_are_told_apart(spark):
    df = table(spark, awkward()).coalesce(1)
    nothing, model = language.fit(df.limit(0), PIECES), language.fit(df, PIECES)
    for m in (nothing, model, nothing):
        found = {r.lang_pred for r in language.predict(df, m, "one key").collect()}
        assert (found == {"und"}) == (m is nothing)


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        odd = sum(int(c) for c in d[::-1][::2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[::-1][1::2])
        if 12 <= len(d) <= 19 and odd % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a9@.-+ (0145", max_size=40) | st.text(alphabet="a1.@", max_size=25) | st.text(alphabet="01234567890 -", max_size=45))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_are_linear():
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000 + "-" * 100_000 + "@@" * 1000) == []


def test_tagger_gradients():
    model, rng = pii.Tagger(1, 3), np.random.default_rng(0)
    codes, tags = rng.integers(0, 5, (6, 4)), rng.integers(0, 3, (6, 4))
    for name in model.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64))
    grads = model.gradients(codes, tags)[1]
    for name in model.NAMES:
        weights = getattr(model, name)
        at = tuple(0 if n < 2 else 1 for n in weights.shape)
        old, losses = weights[at], []
        for step in (1e-2, -1e-2):
            weights[at] = old + step
            losses.append(model.gradients(codes, tags)[0])
        weights[at] = old
        assert abs((losses[0] - losses[1]) / 2e-2 - grads[name][at]) < 1e-3


def test_decode_is_the_best_path():
    model, rng = pii.Tagger(3, 2), np.random.default_rng(2)
    model.out *= 6
    model.moves = rng.normal(0, 1, model.moves.shape).astype(np.float32)
    codes = rng.integers(30, 90, (4, 40))
    tags, _ = model.decode(codes)
    scores = model.emissions(codes)
    for w in range(codes.shape[1]):
        paths = np.stack(np.meshgrid(*[range(pii.TAGS)] * 4, indexing="ij"), -1).reshape(-1, 4)
        total = scores[np.arange(4), w, paths].sum(axis=1) + model.moves[paths[:, :-1], paths[:, 1:]].sum(axis=1)
        best = total.max()
        mine = scores[np.arange(4), w, tags[:, w]].sum() + model.moves[tags[:-1, w], tags[1:, w]].sum()
        assert abs(best - mine) < 1e-4


def test_decoding_states_are_those_of_training():
    model, rng = pii.Tagger(5), np.random.default_rng(4)
    model.table *= 4
    model.table[0, 65, :8] = 200                # exp of it overflows
    codes = rng.integers(0, pii.CLASSES, (120, 37)).astype(np.uint8)
    states, quick = model.states(codes), model.quick_states(codes)
    assert quick.shape == states.shape and np.isfinite(quick).all() and np.abs(quick - states).max() < 1e-4
    tags, sure = model.decode(codes)
    scores = model.emissions(codes)
    mine = np.take_along_axis(scores, tags[..., None].astype(np.intp), 2)[..., 0] - scores[..., 0]
    assert tags.any() and np.abs(sure - mine).max() < 1e-3


def test_reconcile_prefers_whole_then_sure():
    found = [(False, 9.0, 0, 10, 0), (True, 5.0, 0, 20, 0), (True, 4.0, 15, 30, 1), (True, 1.0, 40, 60, 1), (True, 8.0, 70, 74, 2)]
    assert pii.reconcile(found, 100) == [(0, 0, 20)]


def test_pii_rows(spark):
    rows = awkward() + [(400, "x " * 600 + "a.b@c.de" + " y" * 600, "en", "a"), (401, "1.2.3.4, +1 (555) 555-1234", None, None)]
    df = table(spark, rows).withColumn("spans", F.lit("x"))
    model = pii.fit(df)
    got = pii.find(df, model).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        if r.doc_id is not None:
            base = pii.base_spans(text[r.doc_id])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
            assert set(pii.joined(base).split(",")) - {""} <= set(r.spans.split(","))
    assert pii.fit(df.limit(0)) is None and pii.find(df.limit(0), None).count() == 0


def test_tagger_finds_spans_of_documents_it_never_saw(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.fit(docs.filter("doc_id % 2 = 0"))
    texts = [r.text for r in docs.filter("doc_id % 2 = 1 and doc_id < 3000").select("text").distinct().collect()]
    base, found = [pii.base_spans(t) for t in texts], model.spans(texts)
    total = sum(map(len, base))
    hits = sum(any(k == kind and a < y and x < b for a, k, b in f) for f, own in zip(found, base, strict=True) for x, kind, y in own)
    extra = sum(all(b <= x or a >= y for x, _, y in own) for f, own in zip(found, base, strict=True) for a, _, b in f)
    assert total > 60 and hits >= 0.75 * total and extra <= 0.1 * total, (total, hits, extra)
