import numpy as np
import pytest
from pyspark.sql import functions as F

from listwarden.operators import catalog, ordering, profile, sampling, scenarios, split


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(1)
    photos = [(f"p{i}", f"a{i % 40}" if i % 9 else None) for i in range(300)]
    items = [(f"p{i}", j, int(rng.choice([0, 1, 2, 3, 4, 5, 6, 107]))) for i in range(300)
             for j in range(int(rng.integers(1, 6)))]
    lists = [(f"a{i}", sorted(rng.choice(7, int(rng.integers(0, 5)), replace=False).tolist())) for i in range(40)]
    return (spark.createDataFrame(photos, "photo_id string, allowlist_id string"),
            spark.createDataFrame(items, "photo_id string, item_idx int, label int"),
            spark.createDataFrame(lists, "allowlist_id string, listed array<int>"),
            spark.createDataFrame([(6,)], "class_id int"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_split_is_disjoint_order_free_and_seeded(world):
    photos = world[0]
    one = split.make_split(photos)
    assert split.straddling_groups(one).count() == 0
    assert rows(one) == rows(split.make_split(photos.repartition(7).orderBy(F.desc("photo_id"))))
    assert rows(one) != rows(split.make_split(photos, seed=5))
    sizes = {r.subset: r.n_photos for r in split.split_summary(world[1], one).collect()}
    assert 45 <= sizes["test"] <= 60 and 45 <= sizes["val"] <= 60 and sum(sizes.values()) == 300


def test_untrained_and_unseen(spark):
    items = spark.createDataFrame([("t", 0, 0), ("t", 1, 1), ("t", 2, 107), ("v", 0, 1), ("v", 1, 2), ("x", 0, 3),
                                   ("x", 1, 4), ("x", 2, 107)], "photo_id string, item_idx int, label int")
    subsets = spark.createDataFrame([("t", "train"), ("v", "val"), ("x", "test")], "photo_id string, subset string")
    held = spark.createDataFrame([(4,)], "class_id int")
    assert rows(split.untrained_classes(items, subsets, held)) == [(2,), (3,)]
    unseen = split.unseen_classes(items, subsets, held)
    assert rows(unseen) == [(2,), (3,), (4,)]
    photos = spark.createDataFrame([("x", None)], "photo_id string, allowlist_id string")
    lists = spark.createDataFrame([], "allowlist_id string, listed array<int>")
    base = scenarios.photo_lists(photos, items, lists, unseen)
    made = scenarios.make_scenarios(base, seed=1)
    assert [(r.kind, r.listed) for r in made.collect()] == [("clean", [])]
    told = scenarios.scenario_items(made, items, unseen, ["item_idx", "label"])
    assert {r.reason for r in told.collect()} == {"unseen", "foreign"}


def test_scenario_rules(world):
    photos, items, lists, unseen = world
    base = scenarios.photo_lists(photos, items, lists, unseen)
    made = scenarios.make_scenarios(base)
    again = scenarios.make_scenarios(scenarios.photo_lists(photos.repartition(3), items.repartition(5), lists, unseen))
    assert rows(made) == rows(again) and rows(made) != rows(scenarios.make_scenarios(base, seed=3))
    by_photo = {r.photo_id: r for r in base.collect()}
    for r in made.collect():
        assert not set(r.listed) & set(r.removed) and 6 not in r.listed
        k = 0 if r.kind == "clean" else int(r.kind[-1])
        assert len(r.removed) == k and set(r.removed) <= set(by_photo[r.photo_id].present)
    told = scenarios.scenario_items(made, items, unseen, ["item_idx", "label"]).collect()
    for r in told:
        want = ("foreign" if r.label == 107 else "unseen" if r.label == 6 else "removed" if r.label in r.removed
                else "listed" if r.label in r.listed else "unlisted")
        assert r.reason == want and r.gt == ("in" if want == "listed" else "out")


def test_empty_list_is_not_a_missing_list(spark):
    photos = spark.createDataFrame([("a", "empty"), ("b", "gone")], "photo_id string, allowlist_id string")
    items = spark.createDataFrame([("a", 0, 1), ("b", 0, 1)], "photo_id string, item_idx int, label int")
    lists = spark.createDataFrame([("empty", [])], "allowlist_id string, listed array<int>")
    none = spark.createDataFrame([], "class_id int")
    base = {r.photo_id: r.base for r in scenarios.photo_lists(photos, items, lists, none).collect()}
    assert base == {"a": [], "b": [1]}
    strict = scenarios.photo_lists(photos, items, lists, none, fallback=False)
    assert [r.photo_id for r in strict.collect()] == ["a"]


def test_held_out_choice_falls_back_to_all(spark):
    items = spark.createDataFrame([(f"p{i}", 0, 1 if i else 2) for i in range(101)],
                                  "photo_id string, item_idx int, label int")
    assert split.choose_held_out(items, 5).count() == 2


def test_large_groups_are_indexed_like_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(0)
    data = [(("hot" if i % 3 else f"k{i % 17}"), float(rng.normal()), i) for i in range(600)]
    df = spark.createDataFrame(data, "k string, v double, i int").repartition(6)
    order = [F.col("v"), F.col("i")]
    plain = rows(ordering.index_within(df, ["k"], order, "at"))
    monkeypatch.setattr(ordering, "WINDOW_GROUP_ROWS", 50)
    assert rows(ordering.index_within(df, ["k"], order, "at")) == plain


def test_running_totals_and_samples(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v")).repartition(5)
    got = {r.v: r.s for r in ordering.running_totals(df, [F.desc("v")], {"s": F.col("v")}).collect()}
    assert got[999] == 999 and got[0] == sum(range(1000)) and got[500] == sum(range(500, 1000))
    assert sorted(r.v for r in ordering.every_kth(df, [F.col("v")], 30).collect()) == list(range(0, 990, 33))
    assert sorted(r.v for r in ordering.every_kth(df.limit(3), [F.col("v")], 30).collect()) is not None
    picked = sampling.hash_sample(df, "v", 20)
    assert picked.count() == 20 and rows(picked) == rows(sampling.hash_sample(df.repartition(2), "v", 20))


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.normal(size=501), 1)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = ordering.exact_quantiles(df, "v", {"a": 0.05, "b": 0.5, "c": 0.95, "d": 1.0}).first()
    assert np.allclose(list(got), np.percentile(values, [5, 50, 95, 100]))
    hist = profile.equal_histogram(df, "v", 40).orderBy("bin").collect()
    assert [r.n for r in hist] == np.histogram(values, 40)[0].tolist()


def test_weighted_draws_follow_the_class_weights(spark):
    items = spark.createDataFrame([(f"a{i}", 1) for i in range(400)] + [(f"b{i}", 2) for i in range(25)],
                                  "item_id string, label int")
    drawn = sampling.weighted_draws(items, "item_id", 4000)
    share = {r.label: r["count"] / 4000 for r in drawn.groupBy("label").count().collect()}
    assert drawn.count() == 4000 and share[1] == pytest.approx(20 / 25, abs=0.03)
    assert drawn.select("item_id").distinct().count() > 400
    assert rows(drawn) == rows(sampling.weighted_draws(items.repartition(3), "item_id", 4000))


def test_names_by_vote(spark):
    lines = spark.createDataFrame([
        ("f", 0, "1) Alpha", "drugname", 1), ("f", 1, "2. Beta", "drugname", 1), ("g", 2, "3- Beta", "drugname", 1),
        ("g", 3, "4: Gamma", "drugname", 1), ("g", 4, "Delta", "drugname", 2), ("h", 5, "Echo", "drugname", 2),
        ("h", 6, "x", "date", 1), ("h", 7, "x", "drugname", -1), ("h", 8, "x", "drugname", None), ("i", 9, "x", "date", 3),
    ], "allowlist_id string, line_no int, text string, line_kind string, class_id int")
    votes = catalog.name_votes(lines, ["line_no"])
    assert {(r.class_id, r.name) for r in catalog.class_names(votes).collect()} == {(1, "Beta"), (2, "Delta")}
    aliases = {(r.class_id, r.alias_no): r.alias for r in catalog.class_aliases(votes).collect()}
    assert aliases == {(1, 1): "Alpha", (1, 2): "Gamma", (2, 1): "Echo"}
    listed = {r.allowlist_id: r.listed for r in catalog.listed_classes(lines, lines).collect()}
    assert listed == {"f": [1], "g": [1, 2], "h": [2], "i": []}
    items = spark.createDataFrame([("p", 0, 1), ("p", 1, 1), ("q", 0, 7), ("q", 1, 107)],
                                  "photo_id string, item_idx int, label int")
    table = {r.class_id: (r.name, r.n_boxes, r.n_images) for r in
             catalog.class_table(catalog.class_names(votes), items).collect()}
    assert table == {1: ("Beta", 2, 1), 2: ("Delta", 0, 0), 7: ("class_7", 1, 1)}
    pairs = spark.createDataFrame([("p", "x", 0), ("p", "y", 1)], "photo_id string, allowlist_id string, ord int")
    assert catalog.photo_list(pairs).first().allowlist_id == "y"


def test_large_groups_are_split_off_null_keys_too(spark):
    from listwarden.session import split_by_group_size

    df = spark.createDataFrame([(None, i) for i in range(6)] + [("a", 1), ("b", 2), ("b", 3)], "g string, v int")
    small, large = split_by_group_size(df, ["g"], 3)
    assert sorted(r.g for r in small.collect()) == ["a", "b", "b"] and {r.g for r in large.collect()} == {None}
    assert large.count() == 6
