import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.compare import connect, rows_of
from listwarden.llm import exact_dedup, line_dedup, mixing, sharding
from listwarden.llm.graph import components
from listwarden.llm.queries import ORACLES, QUERIES

from .helpers import awkward, table


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    df = QUERIES[name](spark, folder)
    cursor = connect(folder).execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cursor.fetchall())


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_dedup(spark):
    rows = awkward()
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    want = Counter((r[0], least[normal(r[1])] if len(groups[normal(r[1])]) > 1 else r[0], len(groups[normal(r[1])])) for r in rows)
    got = exact_dedup.exact_dedup(table(spark, rows)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(table(spark, rows).limit(0)).count() == 0


def within_one(a, b):
    if a == b:
        return True
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_lines(rows, min_words=3, near_words=10):
    """Kept text per (id, text), every line against every earlier one."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=key)
    lines = [(d, i, normal(x).strip(" ").split(" ")) for d in docs for i, x in enumerate(d[1].split("\n"))]
    gone = defaultdict(set)
    for k, (d, i, words) in enumerate(lines):
        if words != [""] and len(words) >= min_words and any(
                w == words or (len(words) >= near_words and len(w) >= near_words and within_one(w, words))
                for _, _, w in lines[:k]):
            gone[d].add(i)
    return {d: "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone[d]) for d in docs}


def test_line_dedup(spark):
    rows = awkward(1)
    # Word orders that sum to one hash: the candidate found first is not a neighbour, a later one is.
    loop = "a b a c a d e f g h i".split()
    other = "a c a b a d e f g h i".split()
    rows += [(200, " ".join(other)), (201, " ".join(loop)), (202, " ".join(loop[:-1]) + " z")]
    rows = [(*r, None, None)[:4] for r in rows]
    seen = set()
    rows = [r for r in rows if r[0] not in seen and not seen.add(r[0])]
    got = line_dedup.line_dedup(table(spark, rows).withColumn("_line_key", F.lit(1)).withColumn("n_removed", F.lit("x")))
    want = brute_lines(rows)
    out = got.collect()
    assert len(out) == len(rows)
    for r in out:
        old = next(x[1] for x in rows if x[0] == r.doc_id)
        assert r.text == (None if old is None else want[r.doc_id, old]), r.doc_id
        assert r.n_lines == (0 if old is None else old.count("\n") + 1) and r.rank == "k"
    assert line_dedup.line_dedup(table(spark, rows).limit(0)).count() == 0


def test_repeated_rows_come_out_alike(spark):
    out = line_dedup.line_dedup(table(spark, [(1, "a b c d\ne f g h", "en", "a")] * 2)).collect()
    assert [r.n_removed for r in out] == [0, 0]


def brute_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, out, budget = set(order), {}, 1.5 * sum(sizes.values())
    while left:
        level = (budget - sum(out.values())) / sum(weight[s] for s in left)
        over = {s for s in left if 2 * sizes[s] < level * weight[s]}
        if not over:
            return out | {s: level * weight[s] for s in left}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return out


def test_mixing_targets_and_taken(spark):
    rows = awkward(2) + [(1000 + i, "w " * (i % 40), "en", f"s{i % 9}") for i in range(400)]
    got = mixing.mix(mixing.sized(table(spark, rows)).withColumn("target", F.lit("x"))).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert sum(taken.values()) == int(sum(want.values()) + 1e-6)
    assert all(abs(taken[s] - want[s]) <= 1 + 1e-6 for s in want)
    # The queue as a loop: every source's rows in the order of their hash, twice, until the source's words are used up.
    hashed = mixing.sized(table(spark, rows)).select("*", F.xxhash64(F.lit(7), "doc_id", "source", "size").alias("h")).collect()
    for source in want:
        queue = sorted((r for r in hashed if r.source == source), key=lambda r: (r.h, r.doc_id is None, r.doc_id))
        left, brute = taken[source], Counter()
        for r in queue * 2:
            brute[r.doc_id, r.size, r.h] += min(left, r.size)
            left -= min(left, r.size)
        assert left == 0
        mine = Counter()
        for r in got:
            if r.source == source:
                [h] = {x.h for x in hashed if (x.doc_id, x.source, x.size) == (r.doc_id, source, r.size)}
                mine[r.doc_id, r.size, h] += r.taken
        assert mine == brute, source
    again = mixing.mix(mixing.sized(table(spark, rows[::-1])), cell_rows=5).collect()
    assert len(again) == len(got)


def test_the_mix_in_order(spark, tmp_path):
    rows = [(i, "w " * (1 + i % 7), None, "abc"[i % 3]) for i in range(300)]
    mixing.mix(mixing.sized(table(spark, rows))).write.parquet(str(tmp_path / "m"))
    mixed = spark.read.parquet(str(tmp_path / "m"))
    got = mixing.in_order(mixed, 5).collect()
    assert [r.finish for r in got] == sorted(r.finish for r in got)
    per = Counter()
    for r in got:
        per[r.doc_id] += r.words
        assert r.finish <= 1 or r.words < r.size or abs(r.finish - 1) < 1e-9
    assert per == Counter({r.doc_id: r.taken for r in mixed.collect() if r.taken})


def test_mixing_queue_is_ordered_by_finish_time(spark):
    rows = [(i, "w " * (1 + i % 7), None, "ab"[i % 3 == 0]) for i in range(300)]
    sized = mixing.sized(table(spark, rows))
    one, cells = (sorted(map(tuple, mixing.mix(sized, cell_rows=c).select("doc_id", "taken").collect())) for c in (10**6, 7))
    assert [i for i, _ in one] == [i for i, _ in cells]
    assert sum(t for _, t in one) == sum(t for _, t in cells)
    assert mixing.mix(sized.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(mixing.sized(table(spark, [(1, None, None, None), (2, "", None, "a")]))).collect()] == [0, 0]


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    draws = np.array([sharding.hypergeometric(rng, 30, 50, 20) for _ in range(4000)])
    assert abs(draws.mean() - 7.5) < 0.15 and abs(draws.var() - 20 * .375 * .625 * 60 / 79) < 0.4
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3
    big = sharding.hypergeometric(rng, 10**11, 23 * 10**11, 10**7)
    assert abs(big - 10**7 / 24) < 6 * (10**7 / 24) ** 0.5
    m = sharding.communication_matrix([5, 0, 17, 30], 7, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 30] and set(m.sum(axis=0).tolist()) <= {7, 8}


def test_shards_are_even_and_gapless(spark):
    rows = awkward(3) + [(500, "same", "en", "a")] * 90
    df = sharding.sized(table(spark, rows)).withColumn("_shard_h", F.lit(0))
    got = sharding.shard_rows(df, 8).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in got) == Counter((r.doc_id, r.text_crc32) for r in df.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter(map(tuple, got)) == Counter(map(tuple, sharding.shard_rows(df.repartition(7), 8).collect()))
    # The first permutation and the matrix once more, in plain Python.
    copies = Counter((r.doc_id, r.size, r.text_crc32) for r in df.collect())
    rows = spark.createDataFrame([(*r, i) for r, n in copies.items() for i in range(n)], "doc_id long, size long, text_crc32 long, i long")
    rows = rows.withColumn("h", F.xxhash64(F.lit(7), "doc_id", "size", "text_crc32")).withColumn(
        "h", F.expr("if(i = 0, h, xxhash64(h, i))"))
    rows = rows.select("*", F.pmod("h", F.lit(sharding.MIN_BUCKETS)).alias("b"), F.xxhash64(F.lit("local"), "h").alias("o")).collect()
    buckets = defaultdict(list)
    for r in rows:
        buckets[r.b].append(r)
    counts = [len(buckets[b]) for b in range(sharding.MIN_BUCKETS)]
    matrix, want = sharding.communication_matrix(counts, 8, 7), Counter()
    for b, n in enumerate(matrix.tolist()):
        own = iter(sorted(buckets[b], key=lambda r: (r.o, r.h)))
        for shard, k in enumerate(n):
            want.update((r.doc_id, r.size, r.text_crc32, shard) for r in (next(own) for _ in range(k)))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == want
    by_slot = defaultdict(list)
    for r in got:
        by_slot[r.shard].append((r.slot, r.doc_id, r.size, r.text_crc32))
    known = defaultdict(list)
    for r in rows:
        known[r.doc_id, r.size, r.text_crc32].append(r.h)
    known = {row: own[0] for row, own in known.items() if len(own) == 1}
    again = {h: o for h, o in spark.createDataFrame([(h,) for h in known.values()], "h long").select(
        "h", F.xxhash64(F.lit("again"), F.lit(7), "h")).collect()}
    n_cells = sharding.MIN_BUCKETS // 8
    for placed in by_slot.values():
        order = [(again[known[x[1:]]] % n_cells, again[known[x[1:]]]) for x in sorted(placed) if x[1:] in known]
        assert order == sorted(order)
    assert sharding.shard_rows(df.limit(0), 8).count() == 0


def test_equal_rows_are_spread_over_buckets(spark):
    df = spark.range(6000).select(F.expr("if(id < 4000, 1, id)").alias("doc_id"), F.lit(8).alias("size"))
    got = sharding.numbered(df, 7, block=50)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r.doc_id for r in df.collect())
    assert got.select("_shard_h").distinct().count() == 6000
    assert max(r["count"] for r in got.groupBy(F.pmod("_shard_h", F.lit(64))).count().collect()) < 160
    whole = sharding.numbered(df.repartition(3), 7)     # whatever the block and the partitions
    assert Counter(map(tuple, whole.collect())) == Counter(map(tuple, got.collect()))
    placed = sharding.shard_rows(df, 5).collect()
    assert Counter(r.shard for r in placed) == {s: 1200 for s in range(5)}
    assert len({(r.shard, r.slot) for r in placed}) == 6000


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    label = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
