import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from listwarden.llm import common, embedding_dedup, jaccard, suffix_dedup
from listwarden.llm.common import possibly_in
from listwarden.llm.embedding_dedup import LEAST_FILTERS, near_vectors, product_code

from .helpers import awkward, table


def brute_vectors(rows, cosine=0.9):
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float32).astype(np.float64) if g else None for (_, v), g in zip(rows, good, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n = len(rows)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= cosine - 1e-12] for i in range(n)]
    label = [r[0] for r in rows]
    for _ in range(n):
        label = [min([label[i]] + [label[j] for j in link[i]]) for i in range(n)]
    return [(rows[i][0], len(link[i]), label[i]) for i in range(n)]


@pytest.mark.parametrize("tile", [8, 1024])
def test_near_vectors(spark, tile):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((25, 16))
    rows = [(i, (centres[i % 25] + rng.standard_normal(16) * 0.09 * (i % 4)).tolist()) for i in range(300)]
    rows += [(300 + i, centres[0].tolist()) for i in range(40)]
    rows += [(900, None), (901, [0.0] * 16), (902, [None] + [1.0] * 15), (903, [float("nan")] * 16), (904, [float("inf")] * 16),
             (905, []), (906, [1.0, 0.0]), (907, [2.0, 0.0]), (908, [3.0]), (909, [4.0]), (300, centres[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("x"))
    got = near_vectors(df, tile=tile).collect()
    want = brute_vectors(rows)
    have = Counter((r.vec_id, r.n_links, r.component_id) for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * sum(w[1] for w in want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got) and len(got) == len(rows)
    by_id = {w[0]: w for w in want}
    assert all(r.n_links <= by_id[r.vec_id][1] for r in got)
    assert sum((have & Counter(want)).values()) >= 0.95 * len(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_every_vector_has_filters():
    rng = np.random.default_rng(4)
    code = product_code(16, 20_000, 0.9)
    units = code.unit(rng.standard_normal((4000, 16)))
    near = code.unit(units + 1e-4 * rng.standard_normal(units.shape))
    (row, a), (other, b) = code.decode(units), code.decode(near)
    assert np.bincount(row, minlength=len(units)).min() >= LEAST_FILTERS and (np.diff(row) >= 0).all()
    met = set(zip(row.tolist(), a.tolist(), strict=True)) & set(zip(other.tolist(), b.tolist(), strict=True))
    assert len({r for r, _ in met}) == len(units)


def test_no_code_is_an_error(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MOST_FILTERS", 8)
    with pytest.raises(ValueError):
        product_code(64, 10**6, 0.71)


def test_thresholds_and_codes_of_any_size():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((5, 7)), rng.standard_normal((5, 9))
    sums = np.sort((a[:, :, None] + b[:, None, :]).ravel())[::-1]
    for k in (1, 2, 17, 315):
        low = embedding_dedup.kth_largest_sum(a, b, k)
        assert (sums >= low).sum() == k and abs(low - sums[k - 1]) < 1e-9
    everything = product_code(8, 100_000, 0.9)          # too few dimensions for a code: one filter
    assert np.array_equal(everything.decode(everything.unit(rng.standard_normal((50, 8))))[1], np.zeros(50, int))
    big = embedding_dedup.ProductCode(64, 4000, 100.0)
    row, _ = big.decode(big.unit(rng.standard_normal((300, 64))))
    assert 50 < len(row) / 300 < 200


def test_near_vectors_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((300, 64))
    x = np.repeat(centres, 10, axis=0) + rng.standard_normal((3000, 64)) * 0.3
    x = x.astype(np.float32).astype(np.float64)
    pdf = pd.DataFrame({"vec_id": np.arange(3000), "embedding": list(x)})
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum() - len(x)
    got = near_vectors(spark.createDataFrame(pdf)).agg(F.sum("n_links")).first()[0]
    assert want > 1000 and 0.97 * want <= got <= want


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    span = min(width, len(words))
    return {tuple(words[i:i + span]) for i in range(len(words) - span + 1)} if words else set()


def brute_jaccard(rows, percent, width):
    sets = [shingle_set(r[1], width) for r in rows]
    label = [r[0] for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in rows:
        before = list(label)
        for i, j in links:
            known = [x for x in (label[i], label[j]) if x is not None]
            label[i] = label[j] = min(known, default=None)
        if label == before:
            break
    return Counter((r[0], len(s), c) for r, s, c in zip(rows, sets, label, strict=True))


@pytest.mark.parametrize(("percent", "width", "seed"), [(85, 4, 0), (80, 5, 4)])
def test_jaccard_components(spark, monkeypatch, percent, width, seed):
    rows = awkward(seed)
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(120):        # a crowd around one text, some in a chain, some too far
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 8])):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((1000 + i, " ".join(own), "en", "a"))
    df = table(spark, rows).withColumn("seat", F.lit(1))
    for least in (32, 2) if percent == 85 else (2,):       # also with regions as small as they get
        monkeypatch.setattr(jaccard, "LEAST_REGION", least)
        got = jaccard.jaccard_components(df, percent, width).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_jaccard(rows, percent, width)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_region_links_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(50)]
    group = pd.DataFrame({"rep": range(50), "shingles": [s.tobytes() for s in sets]})
    got = {(r.a, r.b) for r in jaccard._region_links(group, 45).itertuples()}
    label = list(range(50))
    for _ in range(50):
        for i in range(50):
            for j in range(50):
                both = len(np.intersect1d(sets[i], sets[j]))
                if i != j and 100 * both >= 45 * (len(sets[i]) + len(sets[j]) - both):
                    label[i] = label[j] = min(label[i], label[j])
    assert got == {(i, x) for i, x in enumerate(label) if i != x}


def test_finer_counts_never_overstate_what_lies_apart():
    rng = np.random.default_rng(2)
    for n, m, both in ((0, 5, 0), (40, 3000, 30), (700, 900, 500), (5000, 5000, 4000), (9000, 1000, 10), (70_000, 20, 20)):
        common = rng.integers(0, 2 ** 63, both, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2 ** 63, k - both, dtype=np.uint64)])) for k in (n, m))
        least = jaccard.least_apart(*(jaccard.fine_counts(jaccard.mixed(x)) for x in (a, b)))
        assert abs(n - m) * (max(n, m) < 15_000) <= least <= n + m - 2 * both
    same = np.full(600, 7, np.uint64)           # a class that overflows, in sets of different sizes
    assert jaccard.least_apart(jaccard.fine_counts(same), jaccard.fine_counts(np.concatenate([same, same]))) == 0


def test_unlike_long_texts_do_not_compare_prefixes(spark, monkeypatch):
    """Long texts with a passage in common meet at many seats; 64 classes cannot tell them apart, finer ones do."""
    compared, close = [], jaccard._close_enough
    monkeypatch.setattr(jaccard, "_close_enough", lambda pairs, *a: compared.append(pairs.count()) or close(pairs, *a))
    rng = random.Random(4)
    words = lambda k: [f"w{rng.randrange(10 ** 6)}" for _ in range(k)]                  # noqa: E731
    passage = words(600)
    texts = [" ".join(words(2700) + passage + words(2700)) for _ in range(5)]
    texts += [texts[0].replace(" w1", " v1", 20)]
    got = jaccard.jaccard_components(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0}
    assert sum(compared) == 1


def test_a_join_leaves_little_behind(spark):
    """Prefixes, sets and seats are removed once they are not needed."""
    import os

    from listwarden.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(folder) for f in names)
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(2000)) for _ in range(30)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts + [t + " x" for t in texts])]
    before = size()
    assert len({r.component_id for r in jaccard.jaccard_components(table(spark, rows)).collect()}) == 30
    assert size() - before < 250_000            # the prefixes alone have 144 kB in rows and as much in the seats


def brute_suffix(rows):
    order = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for r in sorted(rows, key=order):
        raw = (r[1] or "").encode()
        for i in range(len(raw) - 49):
            first.setdefault(raw[i:i + 50], order(r))
    out = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if first[raw[i:i + 50]] < order(r):
                gone[i:i + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[r[0], len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("shard", [1, 20_000])
def test_suffix_dedup(spark, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    rng = random.Random(6)
    passage = "".join(rng.choice("abcde é日") for _ in range(130))
    rows = awkward(6) + [(2000 + i, f"{'xyz'[i % 3] * i}{passage[i % 7:120 - i % 11]}{i}", "en", "a") for i in range(30)]
    rows += [(2100, "ab" * 200, "en", "a"), (2101, "ab" * 30, "en", "a"), (2102, passage[:50], "en", "a"),
             (2103, passage[:49], "en", "a"), (2104, passage[:60] + passage[70:125], "en", "a")]
    df = table(spark, rows).withColumn("o", F.lit("x"))
    got = suffix_dedup.suffix_dedup(df).collect()
    have = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert have == brute_suffix(rows)
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [20, 1 << 15])
def test_suffix_sends_a_repeated_string_once_a_chunk(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    sent, marks = [], suffix_dedup.marks
    monkeypatch.setattr(suffix_dedup, "marks", lambda around: sent.append(around) or marks(around))
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    copy, passage = word(300), word(56)
    rows = [(i, copy if i % 3 else word(90) + passage + word(90), "en", "a") for i in range(300)]
    rows += [(400, "x" * 5000 + "y", "en", "a"), (401, "x" * 4000, "en", "a"), (401, word(40) + "x" * 70 + copy, "en", "a"), (402, "x" * 49, "en", "a")]
    got = suffix_dedup.suffix_dedup(table(spark, rows)).collect()
    have = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert have == brute_suffix(rows)
    load = sent[0].groupBy("bucket").agg(F.sum(F.octet_length("bytes") / suffix_dedup.WIDTH).alias("n"))
    assert load.agg(F.max("n")).first()[0] < 500


def test_suffix_chunks_of_repeated_rows(spark):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh") for _ in range(80))
    rows = [(i // 2, f"{i // 2}{passage if i // 2 % 3 == 1 else ''}" + "xyz"[i // 2 % 3] * 20, "en", "a") for i in range(48)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = suffix_dedup.suffix_dedup(table(spark, rows).coalesce(1)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    have = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert have == brute_suffix(rows)


def test_merged_intervals_equal_sorting():
    rng = np.random.default_rng(0)
    around = [rng.integers(97, 99, (n, suffix_dedup.WIDTH)).astype(np.uint8) for n in (7, 1, 12)]
    around[2][3:6] = around[0][0]
    whole = np.concatenate(around)
    sizes = np.array([len(a) for a in around])
    for t, members, starts in suffix_dedup.merged_intervals([suffix_dedup.Transform(a) for a in around], sizes):
        keys = [whole[m, t:t + suffix_dedup.WINDOW].tobytes() for m in members]
        assert keys == sorted(keys)
        assert starts.tolist() == [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]


def test_possibly_in_loses_nothing(spark):
    rows = spark.range(3000).selectExpr("if(id % 50 = 0, null, id) as k", "id as word")
    keys = spark.range(0, 3000, 3).selectExpr("id as key")
    inside = {r.k for r in possibly_in(rows, "k", keys, "key").collect()}
    outside = [r.k for r in possibly_in(rows, "k", keys, "key", inside=False).collect()]
    assert {k for k in range(0, 3000, 3) if k % 50} <= inside and len(inside) + len(outside) == 3000
    assert not set(outside) & {k for k in range(0, 3000, 3) if k % 50}


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder).persist()
        assert after.columns == columns, name
        if name == "near":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {i for i, _, c in brute_jaccard(rows, corpus_pipeline.NEAR_PERCENT, corpus_pipeline.NEAR_WORDS) if i == c}
            assert {r.doc_id for r in after.collect()} == want
        if name == "mix":
            known = {r.text for r in before.collect()}
            assert sum(r.text not in known for r in after.collect()) <= 1      # the copy in which the budget ends
            assert after.count() > before.count()
        else:
            assert after.count() <= before.count()
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, folder)
    assert last.filter("intact").count() == before.count()


def test_pipeline_takes_repeats_of_short_lines(spark):
    docs = table(spark, [(1, "top\nfirst text here", "en", "a"), (2, "top\n\nother words here", "en", "a")]).select(
        "doc_id", "text", "lang", "source", "n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup_stage(spark, docs, "short").collect()}
    assert got == {1: "top\nfirst text here", 2: "\nother words here"}


def test_pipeline_without_labels_keeps_documents(spark):
    docs = table(spark, [(1, "some words", None, "a"), (2, "été", None, "a"), (3, " 12 _", None, "a"), (4, None, None, "a")]).select(
        "doc_id", "text", "lang", "source", "n_chars")
    got = corpus_pipeline.language_id(spark, docs, "no labels").collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(1, None), (2, None)]


def test_pipeline_keeps_one_of_each_group(spark):
    one, two, three = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    docs = table(spark, [(None, one, "en", "a"), (None, one + " z", "en", "a"), (5, two, "en", "a"), (5, two, "en", "a"),
                         (5, two + " z", "en", "a"), (None, two, "en", "a"), (5, three, "en", "a"), (9, None, "en", "a")]).select(
        "doc_id", "text", "lang", "source", "n_chars")
    got = [(r.doc_id, (r.text or " ")[0]) for r in corpus_pipeline.near_dedup(spark, docs, "groups").collect()]
    assert Counter(got) == Counter([(None, "a"), (5, "b"), (5, "c"), (9, " ")])


def test_pipeline_awkward_rows(spark):
    docs = table(spark, awkward(8)).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "awkward").persist()
    assert docs.count() > 20 and docs.filter("not intact").count() == 0
    empty = table(spark, awkward(8)).select("doc_id", "text", "lang", "source", "n_chars").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "awkward")
    assert empty.count() == 0


def test_grouping_helper_keeps_groups_whole():
    from listwarden.llm.common import whole_groups

    parts = [pd.DataFrame({"k": [1, 1, 2]}), pd.DataFrame({"k": [2, 2]}), pd.DataFrame({"k": []}, dtype=int), pd.DataFrame({"k": [3]})]
    sizes = defaultdict(int)
    for g in whole_groups(iter(parts), ["k"]):
        assert g["k"].nunique() == 1 and g["k"].iloc[0] not in sizes
        sizes[g["k"].iloc[0]] = len(g)
    assert dict(sizes) == {1: 2, 2: 3, 3: 1}


def test_pipeline_hands_few_rows_to_python_at_once(spark):
    key, old = corpus_pipeline.BATCH_KEY, spark.conf.get(corpus_pipeline.BATCH_KEY)
    docs = table(spark, [(i, f"w{i} " * 8, "en", "a") for i in range(5000)]).coalesce(1)
    try:
        for before, rows in (("10000", 1000), ("0", 1000), ("300", 300)):
            spark.conf.set(key, before)
            sizes = corpus_pipeline.encode(spark, docs, "").mapInArrow(
                lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
            assert max(r.n for r in sizes.collect()) <= rows == int(spark.conf.get(key))
    finally:
        spark.conf.set(key, old)


def test_words_are_freed_at_the_end_of_a_task(spark):
    docs = table(spark, [(i, f"a{i} b c d e f", "en", "a") for i in range(20)]).withColumn("row", F.col("doc_id")).coalesce(1)
    wanted = docs.select(F.col("row").alias("rep"), "row")

    def held(batches):
        for _ in batches:
            yield pd.DataFrame({"n": [len(common._KEPT.get("words", ()))]})

    jaccard.sketches(docs, np.zeros(0, np.uint64), 4, 85).collect()
    jaccard.whole_sets(docs, wanted, 4).collect()
    assert {r.n for r in spark.range(0, 400, 1, 4).mapInPandas(held, "n long").collect()} == {0}
