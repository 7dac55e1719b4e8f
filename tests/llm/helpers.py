"""Small tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, `row` string, rank string, slot string"
WORDS = "the of and zug und haus ist über la ne les été 日本 a.b x1".split()


def table(spark: SparkSession, rows: list[tuple], n_extra: int = 4) -> DataFrame:
    """Rows of (doc_id, text, lang, source); further columns have names that operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "r", "k", "s") for r in rows], SCHEMA)


def awkward(seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    base = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(20, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS) + str(rng.randint(0, 9))
        rows.append((i, "\n".join([" ".join(words[:30]), " ".join(words[30:])]), rng.choice(["en", "de", None]),
                     rng.choice(["a", "b", "é", None])))
    rows += [(100, None, "en", "a"), (101, "", "en", None), (102, " \t\r\n ", None, "b"), (103, "one", "de", "a"),
             (104, "one two", "de", "b"), (105, "x" * 5000, "en", "c"), (106, "wort " * 4000, "de", "c"),
             (107, base[0].replace(" ", "  \t"), "en", "a"), (108, base[0], "en", "a"), (108, base[0], "en", "a"),
             (None, base[1], "en", "a"), (None, None, None, None), (109, "😀 ünïcode text", "fr", "d")]
    rng.shuffle(rows)
    return rows
