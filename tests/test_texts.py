import random
import unicodedata

from pyspark.sql import functions as F

from listwarden.functions import text as T
from listwarden.functions.names import jpg_name, strip_list_number
from listwarden.operators import agreement, fuzzy


def column(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


def test_fold_and_names(spark):
    assert column(spark, ["NOVOXIM-500", "HOẠT HUYẾT DƯỠNG NÃO 150mg+20mg", "Đạn KK İ", ""], T.fold) == [
        "novoxim 500", "hoat huyet duong nao 150 mg 20 mg", "dan kk i", ""]
    assert column(spark, ["3) HOẠT HUYẾT DƯỠNG NÃO 150mg+20mg", "12. PARACETAMOL 500MG", "no number"],
                  strip_list_number) == ["HOẠT HUYẾT DƯỠNG NÃO 150mg+20mg", "PARACETAMOL 500MG", "no number"]
    assert column(spark, ["a/b.c.png", ".x", ".x.png", "plain"], jpg_name) == ["b.c.jpg", ".x.jpg", ".x.jpg", "plain.jpg"]
    assert column(spark, ["Ab (forte) Cdef 12 xyz"], T.name_tokens) == [["cdef", "xyz"]]
    assert column(spark, ["Ab (forte) Cdef 12 xyz"], T.line_tokens) == [["forte", "cdef", "xyz"]]


def test_fold_table_covers_every_ascii_based_letter():
    source, target = T.fold_table()
    table = dict(zip(source, target))
    for code in range(0x80, 0x3000):
        parts = unicodedata.normalize("NFD", chr(code))
        left = "".join(c for c in parts if not 0x300 <= ord(c) <= 0x36F)
        if any(c.isascii() and c.isalnum() for c in left):
            assert table[chr(code)] == left


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(token):
    return 2 if len(token) >= 8 else 1 if len(token) >= 5 else 0


def mutate(rng, word):
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(word) + 1)
        word = rng.choice([word[:at] + rng.choice("abc") + word[at:], word[:at] + word[at + 1:],
                           word[:at] + rng.choice("abc") + word[at + 1:]])
    return word


def test_similar_tokens_equal_brute_force(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 12))) for _ in range(60)})
    words = sorted({w for w in (mutate(rng, rng.choice(names)) for _ in range(400)) if len(w) >= 3})
    left = spark.createDataFrame([(w,) for w in words], "line_token string")
    right = spark.createDataFrame([(n,) for n in names], "name_token string")
    got = {tuple(r) for r in fuzzy.similar_tokens(left, right).collect()}
    assert got == {(w, n) for w in words for n in names if distance(w, n) <= allowed(n)}


def test_line_matches_equal_the_sequential_reading(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 9))) for _ in range(15)]
    names = [(c, k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 3)))) for c in range(12) for k in range(2)]
    lines = [(d, n, " ".join(mutate(rng, rng.choice(vocabulary)) for _ in range(rng.randint(1, 6))))
             for d in range(4) for n in range(25)]
    lines += [(9, n, lines[0][2]) for n in range(200)]
    got = {(r.doc, r.class_id): (r.line_no, r.name_no) for r in fuzzy.match_lines(
        spark.createDataFrame(lines, "doc int, line_no int, text string"),
        spark.createDataFrame(names, "class_id int, name_no int, name string")).collect()}
    want = {}
    for doc, line_no, text in lines:
        tokens = [t for t in text.split() if len(t) >= 3]
        for class_id, name_no, name in names:
            wanted = name.split()
            hit = len("".join(wanted)) >= 6 and any(
                all(distance(a, b) <= allowed(b) for a, b in zip(tokens[i:i + len(wanted)], wanted))
                for i in range(len(tokens) - len(wanted) + 1))
            if hit:
                want[doc, class_id] = min(want.get((doc, class_id), (10**9, 0)), (line_no, name_no))
    assert got == want


def test_look_up_prefers_exact_then_first_prefix(spark):
    names = spark.createDataFrame([(0, "Alpha Forte"), (1, "Alpha"), (2, "Beta")], "class_id int, name string")
    asked = spark.createDataFrame([("alpha",), ("ALPH",), ("beta!",), ("zeta",), ("?",)], "text string")
    assert {r.text: r.class_id for r in fuzzy.look_up(asked, names).collect()} == {
        "alpha": 1, "ALPH": 0, "beta!": 2, "zeta": None, "?": None}


def test_gates(spark):
    def detector(a, b, i):
        return agreement.detector_gates(spark.createDataFrame([(a, b, i)], "boxes_a int, boxes_b int, mean_best_iou double"))

    assert all(r.passed for r in detector(160, 160, 0.966).collect())
    assert not all(r.passed for r in detector(160, 0, 0.0).collect())
    assert [r.passed for r in detector(160, 158, 0.31).collect()] == [True, False]

    def vectors(before, after, cosine):
        return agreement.vector_gates(spark.createDataFrame(
            [(before, after, cosine)], "accuracy_before double, accuracy_after double, cosine double"))

    agreement.enforce(vectors(0.8784, 0.8741, 0.989))
    agreement.enforce(vectors(None, None, None))
    failed = vectors(0.8784, 0.1794, 0.2293)
    assert [r.passed for r in failed.collect()] == [False, False]
    try:
        agreement.enforce(failed)
        raise AssertionError("must raise")
    except agreement.GateError as error:
        assert "cosine" in str(error) and "accuracy_drop" in str(error)


def test_equal_runs_agree(spark):
    rows = [("a", 0, "in", 0.9, 0.8, 1., 2., 3., 4.), ("a", 1, "out", 0.1, 0.7, 1., 2., 3., 4.)]
    run = spark.createDataFrame(rows, "case_id string, item_no int, verdict string, p_in double, score double, "
                                      "x1 double, y1 double, x2 double, y2 double")
    cases = spark.createDataFrame([("a",), ("empty",)], "case_id string")
    r = agreement.run_agreement(agreement.case_agreement(run, run, cases, cases)).first()
    assert (r.cases, r.same_box_count, r.verdict_agreement, r.items_compared, r.max_p_gap) == (2, 2, 1.0, 2, 0.0)


def test_lines_meet_their_hits_by_a_short_key(spark):
    lines = spark.createDataFrame([(d, n, text) for d in range(3) for n, text in enumerate(
        ("1) Paracetamol forte", "nothing here", "PARACETAMOLL forte", "1) Paracetamol forte"))], "doc int, line_no int, text string")
    names = spark.createDataFrame([(5, 0, "Paracetamol forte"), (6, 0, "Unnamed thing")], "class_id int, name_no int, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = fuzzy.match_lines(lines, names)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.doc, r.class_id, r.line_no, r.line) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(line#" in plan and "hashpartitioning(tokens#" not in plan
    assert rows == [(d, 5, 0, "1) Paracetamol forte") for d in range(3)]
