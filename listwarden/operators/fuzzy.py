"""Fuzzy matching of text lines to catalogue names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rate
from ..functions.text import MIN_NAME_LETTERS, close_enough, fold, letters, line_tokens, name_tokens, tolerance
from ..session import stored


def catalogue_keys(names: DataFrame) -> DataFrame:
    """(class_id, name_no, name, tokens) of the names with enough letters to be told apart."""
    tokens = names.select("class_id", "name_no", "name", name_tokens(F.col("name")).alias("tokens"))
    return tokens.filter((F.size("tokens") > 0) & (letters(F.col("tokens")) >= MIN_NAME_LETTERS))


def _pieces(length: Column, edits: Column) -> Column:
    """Start and size of the edits + 1 pieces a token is cut into."""
    parts = edits + 1
    return F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct(
        i.alias("i"), F.floor(i * length / parts).cast("int").alias("at"),
        (F.floor((i + 1) * length / parts) - F.floor(i * length / parts)).cast("int").alias("size")))


def similar_tokens(line_vocabulary: DataFrame, name_vocabulary: DataFrame) -> DataFrame:
    """(line_token, name_token) within the tolerance of the name token.

    With k edits allowed one of k + 1 pieces of the name token survives unchanged, shifted by at most k.
    Both vocabularies meet on (name length, piece number, piece); the distance is checked afterwards.
    """
    length = F.length("name_token")
    cuts = F.transform(_pieces(length, tolerance(F.col("name_token"))), lambda p: F.struct(
        length.alias("n"), p["i"].alias("i"), F.substring(F.col("name_token"), p["at"] + 1, p["size"]).alias("piece")))
    right = name_vocabulary.select("name_token", F.explode(cuts).alias("key"))

    size = F.length("line_token")
    lengths = F.filter(F.sequence(F.greatest(F.lit(3), size - 2), size + 2), lambda n: F.abs(n - size) <= _edits(n))
    windows = F.flatten(F.transform(lengths, lambda n: F.flatten(F.transform(
        _pieces(n, _edits(n)), lambda p: F.transform(
            F.filter(F.sequence(p["at"] - _edits(n), p["at"] + _edits(n)),
                     lambda s: (s >= 0) & (s + p["size"] <= size)),
            lambda s: F.struct(n.alias("n"), p["i"].alias("i"),
                               F.substring(F.col("line_token"), s + 1, p["size"]).alias("piece")))))))
    left = line_vocabulary.select("line_token", F.explode(F.array_distinct(windows)).alias("key"))
    return left.join(right, "key").filter(close_enough(F.col("line_token"), F.col("name_token"))).select(
        "line_token", "name_token").distinct()


def _edits(length: Column) -> Column:
    return F.when(length >= 8, 2).when(length >= 5, 1).otherwise(0)


def sequence_hits(sequences: DataFrame, keys: DataFrame) -> DataFrame:
    """(tokens, class_id, name_no): token sequences of lines that contain a name's sequence.

    Every name is looked up by its rarest token only; the tokens around it are then compared in place. A token carries
    no more of its line than the longest name could cover, so long lines cost as much as their tokens in short ones.
    Sequences may come more than once: they are put together and written once. The pairs of words that start a comparison
    are written too, so that their size is known and the tokens need no shuffle to meet a short list.
    """
    longest = keys.agg(F.coalesce(F.max(F.size("tokens")), F.lit(1)).alias("m")).scalar()
    whole = stored(sequences.select(F.xxhash64("tokens").alias("line"), "tokens").dropDuplicates(["line"]))
    spread = whole.withColumn("m", longest).select("line", F.explode(F.transform("tokens", lambda t, i: F.struct(
        i.alias("at"), t.alias("line_token"), F.size("tokens").alias("size"),
        F.least(i, F.col("m") - 1).alias("before"),
        F.slice("tokens", F.greatest(i - F.col("m") + 2, F.lit(1)), 2 * F.col("m") - 1).alias("around")))).alias("p"))
    posted = spread.select("line", "p.*")
    frequency = stored(whole.select(F.explode("tokens").alias("line_token")).groupBy("line_token").agg(
        F.count(F.lit(1)).alias("n")))
    name_side = keys.select("class_id", "name_no", F.posexplode("tokens").alias("name_at", "name_token"))
    similar = stored(similar_tokens(frequency.select("line_token"), name_side.select("name_token").distinct()))
    weight = similar.join(frequency, "line_token").groupBy("name_token").agg(F.sum("n").alias("w"))
    # A name with a token no line carries matches nothing: its weight is missing and sorts first.
    anchors = name_side.join(weight, "name_token", "left").groupBy("class_id", "name_no").agg(
        F.min(F.struct(F.coalesce("w", F.lit(0)).alias("w"), "name_at", "name_token")).alias("a")
    ).filter("a.w > 0").select("class_id", "name_no", "a.name_at", "a.name_token")
    anchored = stored(anchors.join(keys.select("class_id", "name_no", F.col("tokens").alias("wanted")),
                                   ["class_id", "name_no"]))
    starts = stored(similar.join(anchored.select("name_token").distinct(), "name_token", "left_semi"))
    start = F.col("at") - F.col("name_at")
    fits = (start >= 0) & (start + F.size("wanted") <= F.col("size"))
    candidates = posted.join(starts, "line_token").join(anchored, "name_token").filter(fits)
    window = F.slice("around", F.col("before") - F.col("name_at") + 1, F.size("wanted"))
    same = F.forall(F.zip_with(window, F.col("wanted"), close_enough), lambda ok: ok)
    found = stored(candidates.filter(same).select("line", "class_id", "name_no").distinct())
    return found.join(whole, "line").select("tokens", "class_id", "name_no")


def match_lines(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(doc, class_id, line_no, line, name): the first line naming each class, by its first matching name.

    Equal token sequences are matched once, however many lines repeat them.
    """
    keys = catalogue_keys(names)
    # A line without tokens matches nothing; filtering it here would only fold every line twice.
    tokened = lines.select("doc", "line_no", "text", line_tokens(F.col("text")).alias("tokens"))
    hits = stored(sequence_hits(tokened.select("tokens"), keys).select(F.xxhash64("tokens").alias("line"), "class_id", "name_no"))
    named = tokened.select("doc", "line_no", "text", F.xxhash64("tokens").alias("line")).join(hits, "line")
    first = named.groupBy("doc", "class_id").agg(
        F.min(F.struct("line_no", "name_no", "text")).alias("f"))
    found = first.select("doc", "class_id", "f.line_no", F.trim("f.text").alias("line"), "f.name_no")
    return found.join(names.select("class_id", "name_no", "name"), ["class_id", "name_no"])


def look_up(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(text, class_id): the class whose folded name equals the text, else the first that starts with it."""
    asked = queries.select("text").distinct().withColumn("q", fold(F.col("text"))).filter(F.col("q") != "")
    folded = names.select("class_id", fold(F.col("name")).alias("n"))
    # Only prefixes as long as some question.
    asked_lengths = asked.agg(F.collect_set(F.length("q")).alias("l")).scalar()
    prefixes = folded.withColumn("l", asked_lengths).select("class_id", "n", F.explode(F.transform(
        F.filter("l", lambda i: i <= F.length("n")), lambda i: F.substring(F.col("n"), F.lit(1), i))).alias("q"))
    found = asked.join(prefixes, "q").groupBy("text").agg(
        F.min(F.struct((F.col("n") != F.col("q")).alias("inexact"), "class_id")).alias("b"))
    return queries.select("text").distinct().join(found, "text", "left").select("text", F.col("b.class_id").alias(
        "class_id"))


def match_scores(truth: DataFrame, found: DataFrame, names: DataFrame) -> DataFrame:
    """Micro precision and recall by class and by shared name; truth and found are (doc, class_id)."""
    truth, found = truth.select("doc", "class_id").distinct(), found.select("doc", "class_id").distinct()
    both = truth.withColumn("t", F.lit(1)).join(found.withColumn("f", F.lit(1)), ["doc", "class_id"], "full")
    called = names.select("class_id", "name").distinct()
    spoken = both.join(called, "class_id").groupBy("doc", "name").agg(
        F.max("t").alias("in_truth"), F.max("f").alias("in_found"))
    shared = both.join(called, "class_id").join(spoken, ["doc", "name"]).groupBy("doc", "class_id").agg(
        F.max("in_truth").alias("name_true"), F.max("in_found").alias("name_found"))
    flags = both.join(shared, ["doc", "class_id"], "left")

    def n(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    t, f = F.col("t").isNotNull(), F.col("f").isNotNull()
    named, answered = F.col("name_found").isNotNull(), F.col("name_true").isNotNull()
    sums = flags.agg(
        n(t & f).alias("tp"), n(~t).alias("fp"), n(~f).alias("fn"), n(t & named).alias("name_tp"),
        n(f & ~answered).alias("name_fp"), n(t & ~named).alias("name_fn"))
    c = F.col
    return sums.select(
        "tp", "fp", "fn", rate(c("tp"), c("tp") + c("fn")).alias("recall"),
        rate(c("tp"), c("tp") + c("fp")).alias("precision"), "name_tp", "name_fp", "name_fn",
        rate(c("name_tp"), c("name_tp") + c("name_fn")).alias("name_recall"),
        rate(c("name_tp"), c("name_tp") + c("name_fp")).alias("name_precision"))
