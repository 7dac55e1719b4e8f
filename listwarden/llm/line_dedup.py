"""Near-duplicate lines by a deletion-neighbourhood join: lines within one word edit share a line with one word left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, possibly_in, row_key, stored

MIN_WORDS = 3       # shorter lines are never removed
NEAR_WORDS = 10     # from here on one word may differ; below, lines must be equal
MASK = (1 << 40) - 1


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, at, line, n) of every line: ``line`` has one space between words, ``n`` words; ``at`` orders all lines by
    document id, row and place. Only texts with other than single spaces go through the pattern."""
    text = F.col(text_col)
    odd = text.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | text.contains(c)
    # A step of its own: next to the explode these would be worked out for every line.
    whole = docs.select(row_key(id_col, text_col).alias("row"), F.col(id_col).cast("long").alias("id"), odd.alias("odd"),
                        text.alias("text"))
    lines = whole.select("row", "id", "odd", F.posexplode(F.split("text", "\n")).alias("place", "raw"))
    line = F.trim(F.when(F.col("odd"), F.regexp_replace("raw", SPACE, " ")).otherwise(F.col("raw")))
    return lines.select("row", F.struct("id", "row", "place").alias("at"), line.alias("line")).withColumn(
        "n", F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1)


def half_keys(line: Column, n: Column) -> Column:
    """Keys of which two lines within one word edit share one: an edit leaves one half of the words untouched.

    A line of n words has its own halves and those it would share with a line of n - 1 words.
    """
    h, g = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")

    def words(count: Column) -> Column:
        return F.call_function("substring_index", line, F.lit(" "), count)

    return F.array(F.xxhash64(n, F.lit("first"), words(h)), F.xxhash64(n, F.lit("last"), words(h - n)),
                   F.xxhash64(n - 1, F.lit("first"), words(g)), F.xxhash64(n - 1, F.lit("last"), words(g - n + 1)))


def with_variants(rows: DataFrame) -> DataFrame:
    """(line, gone, key): the hashed line itself (gone = 0) and the line without each of its words in turn.

    The hash sums over neighbouring words, so leaving word i out costs three hashes, however long the line.
    """
    def pair(a: Column, b: Column) -> Column:
        return F.xxhash64(a, b).bitwiseAND(F.lit(MASK))

    n, edge = F.size("words"), F.array(F.lit(0).cast("long"))
    hashed = rows.withColumn("h", F.concat(edge, F.transform("words", lambda w: F.xxhash64(w)), edge))
    summed = hashed.withColumn("p", F.transform(
        F.sequence(F.lit(1), n + 1), lambda i: pair(F.element_at("h", i), F.element_at("h", i + 1)))).withColumn(
        "s", F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x))
    whole = F.struct(F.lit(0).alias("gone"), F.xxhash64("s", n).alias("key"))
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("gone"), F.xxhash64(
        F.col("s") - F.element_at("p", i) - F.element_at("p", i + 1)
        + pair(F.element_at("h", i), F.element_at("h", i + 2)), n - 1).alias("key")))
    return summed.select("line", F.explode(F.concat(F.array(whole), without)).alias("v")).select("line", "v.gone", "v.key")


def left_out(words: Column, gone: Column) -> Column:
    return F.when(gone == 0, words).otherwise(F.concat(
        F.slice(words, 1, F.greatest(gone - 1, F.lit(0))),
        F.slice(words, gone + 1, F.greatest(F.size(words) - gone, F.lit(0)))))


def _checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (line, gone, other, other_gone) with ``same``: whether the lines are equal without those words."""
    mine = texts.select("line", F.col("words").alias("a"))
    theirs = texts.select(F.col("line").alias("other"), F.col("words").alias("b"))
    return pairs.join(mine, "line").join(theirs, "other").withColumn(
        "same", left_out(F.col("a"), F.col("gone")) == left_out(F.col("b"), F.col("other_gone"))).drop("a", "b")


def near_lines(distinct: DataFrame, lines: DataFrame) -> DataFrame:
    """Numbers (num) of the lines that an earlier line is within one word edit of.

    ``distinct`` has (num, first, keys), one row per distinct line of NEAR_WORDS words or more, ``first`` its earliest
    place; ``lines`` has (at, text) of at least those places. Lines sharing no half key with another have no partner
    and emit nothing; all others are numbered in order (column line) and emit their whole deletion neighbourhood.
    Within equal variants nobody is paired: same word left out means one substitution apart, so the earliest of
    (variant, gone) answers for all of them, and a line that is itself the variant is one deletion apart from the rest.
    """
    halves = distinct.select("num", F.explode("keys").alias("half"))
    shared = stored(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half"))
    hits = stored(halves.join(shared, "half", "left_semi").select("num").distinct())
    crowd = stored(distinct.select("num", "first").join(hits, "num").orderBy("first").withColumn(
        "line", F.monotonically_increasing_id()))
    texts = stored(possibly_in(lines, "at", crowd, "first").join(crowd, F.col("at") == F.col("first")).select(
        "line", F.split("text", " ").alias("words")).dropDuplicates(["line"]))
    rows = stored(with_variants(texts))
    # A line with repeated words makes one variant several times; a key matters if two lines have it.
    several = stored(rows.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high")).filter(
        "low < high").select("key"))
    rows = stored(rows.join(several, "key", "left_semi").select("line", "gone", "key"))
    same = rows.filter("gone > 0").groupBy("key", "gone").agg(F.min("line").alias("twin"))
    keys = rows.groupBy("key").agg(F.min(F.when(F.col("gone") == 0, F.col("line"))).alias("whole"))
    lacking = same.groupBy("key").agg(F.min(F.struct("twin", "gone")).alias("lacking"))
    # For every row the earliest of: the line that is the variant, one without the same word, any that makes the variant.
    met = rows.join(stored(same), ["key", "gone"], "left").join(stored(keys), "key").join(stored(lacking), "key", "left")
    def rival(other: str, gone: str | Column, present: Column) -> Column:
        return F.when(present, F.struct(F.col(other).alias("other"), (F.col(gone) if isinstance(gone, str) else gone).alias(
            "other_gone")))

    best = F.least(rival("whole", F.lit(0), (F.col("gone") > 0) & F.col("whole").isNotNull()),
                   rival("twin", "gone", F.col("gone") > 0), rival("lacking.twin", "lacking.gone", F.col("gone") == 0))
    found = met.withColumn("rival", best).filter(F.col("rival.other") < F.col("line"))
    found = stored(found.groupBy("line").agg(F.min(F.struct("rival", "gone")).alias("b")).select(
        "line", F.col("b.gone").alias("gone"), "b.rival.other", "b.rival.other_gone"))
    checked = stored(_checked(found, texts))
    gone = checked.filter("same").select("line")
    # Different word orders can sum to one hash. Where the earliest rival fails, all rivals of that line are checked.
    again = rows.join(checked.filter("not same").select("line"), "line", "left_semi")
    others = rows.select("key", F.col("line").alias("other"), F.col("gone").alias("other_gone"))
    pairs = again.join(others, "key").filter(
        (F.col("other") < F.col("line")) & ((F.col("gone") == F.col("other_gone")) | (F.col("gone") == 0) |
                                            (F.col("other_gone") == 0)))
    more = _checked(pairs.select("line", "gone", "other", "other_gone").distinct(), texts).filter("same").select("line")
    return stored(gone.union(more).distinct().join(crowd, "line").select("num"))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  near_words: int = NEAR_WORDS) -> DataFrame:
    """(row, places): for each row key the sorted places of the lines that go."""
    lines = lines_of(docs, id_col, text_col)
    key = F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit("second"), "line").alias("b"))
    near = F.col("n") >= near_words
    narrow = stored(lines.filter((F.col("line") != "") & (F.col("n") >= min_words)).select(
        key.alias("line"), "at", F.when(near, half_keys(F.col("line"), F.col("n"))).alias("keys")))
    distinct = stored(narrow.groupBy("line").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.first("keys", ignorenulls=True).alias("keys")).withColumn(
        "num", F.monotonically_increasing_id()))
    near_gone = near_lines(distinct.filter("keys is not null").select("num", "first", "keys"),
                           lines.filter(near).select("at", F.col("line").alias("text")))
    verdict = stored(distinct.select("num", "line", "first", "n").join(
        near_gone.withColumn("near", F.lit(True)), "num", "left").filter((F.col("n") > 1) | F.col("near")).select(
        "line", "first", F.coalesce("near", F.lit(False)).alias("near")))
    gone = narrow.select("line", "at").join(verdict, "line").filter(F.col("near") | (F.col("at") != F.col("first")))
    out = stored(gone.groupBy(F.col("at.row").alias("row")).agg(
        F.sort_array(F.collect_set("at.place")).alias("places")))
    for table in (narrow, distinct):
        discard(table)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
               near_words: int = NEAR_WORDS) -> DataFrame:
    """Every row with its text reduced to the lines that no earlier line repeats, plus n_lines and n_removed.

    Lines end at line feeds. A line goes if an earlier one (by id, then place; a null id comes first) has the same
    words, or, from ``near_words`` words on, comes within one inserted, deleted or replaced word of it; an earlier line
    counts even if it goes itself. Lines of fewer than ``min_words`` words always stay. Rows stay, with an empty text if
    all their lines go; null texts stay null and count no lines; rows equal in id and text are one document and come
    out alike. Further columns stay; n_lines, n_removed and columns starting with ``_line_`` are replaced.
    """
    rest = docs.drop("n_lines", "n_removed", *[c for c in docs.columns if c.startswith("_line_")])
    gone = removed_lines(rest, id_col, text_col, min_words, near_words).select(
        F.col("row").alias("_line_row"), F.col("places").alias("_line_gone"))
    # Texts that keep all their lines stay where they are; the others meet their list of lines.
    keyed = rest.withColumn("_line_key", row_key(id_col, text_col))
    keyed = possibly_in(keyed, "_line_key", gone, "_line_row").join(
        gone, F.col("_line_key") == F.col("_line_row"), "left").unionByName(
        possibly_in(keyed, "_line_key", gone, "_line_row", inside=False).withColumns(
            {c: F.lit(None).cast(t) for c, t in gone.dtypes}))
    # Split once, in a step of its own.
    keyed = keyed.withColumn("_line_parts", F.split(text_col, "\n"))
    n = F.size("_line_parts")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_line_gone"))
    text = F.when(F.col("_line_gone").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at("_line_parts", i + 1)), "\n"))
    return keyed.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in rest.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        F.coalesce(F.size("_line_gone"), F.lit(0)).cast("long").alias("n_removed"))


ORACLE = r"""
with l as (select doc_id, i, raw, trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as line from (
  select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents)),
d as (select line, min({'id': doc_id, 'i': i}) as f, string_split(line, ' ') as w, len(string_split(line, ' ')) as n
  from l where line <> '' group by line having n >= 3),
v as (select line, f, 0 as gone, line as v from d where n >= 10
  union all select line, f, gone, array_to_string(list_concat(w[1:gone - 1], w[gone + 1:]), ' ')
  from (select *, unnest(range(1, n + 1)) as gone from d where n >= 10)),
g as (select v, gone, min(f) as f from v group by 1, 2),
k as (select v, min(f) filter (gone = 0) as whole, min(f) filter (gone > 0) as lacking from g group by 1),
near as (select distinct v.line from v join k using (v) join g using (v, gone)
  where case when v.gone = 0 then k.lacking < v.f else g.f < v.f or coalesce(k.whole < v.f, false) end),
j as (select l.doc_id, l.i, l.raw, coalesce(d.f <> {'id': l.doc_id, 'i': l.i} or near.line is not null, false) as gone
  from l left join d using (line) left join near using (line))
select t.doc_id, case when t.text is null then null else coalesce(s.text, '') end as text,
 coalesce(s.n_lines, 0) as n_lines, coalesce(s.n_removed, 0) as n_removed
from documents t left join (select doc_id, string_agg(raw, chr(10) order by i) filter (not gone) as text,
  count(*) as n_lines, count(*) filter (gone) as n_removed from j group by 1) s using (doc_id)"""
