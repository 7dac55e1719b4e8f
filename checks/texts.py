"""Folding, tokens and fuzzy matching of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwarden import bridge
from listwarden.functions import text as T
from listwarden.operators import fuzzy

from .base import VIEWS, query

FOLD = """trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents({0})), '([a-z])([0-9])', '\\1 \\2', 'g'),
 '([0-9])([a-z])', '\\1 \\2', 'g'), '[^a-z0-9]+', ' ', 'g'))"""
TOKENS = "list_filter(string_split({0}, ' '), lambda t: len(t) >= 3 and regexp_full_match(t, '[a-z]+'))"
NAME_TOKENS = TOKENS.format(FOLD.format("regexp_replace({0}, '\\([^)]*\\)', ' ', 'g')"))
LINE_TOKENS = TOKENS.format(FOLD)

VIEWS["docs"] = "select line_no % 97 as doc, line_no, text from text_lines"
VIEWS["keys"] = f"""
select class_id, 0 as name_no, name, toks from (select *, {NAME_TOKENS.format('name')} as toks from catalogue)
where len(array_to_string(toks, '')) >= 6"""
VIEWS["hits"] = f"""
select d.doc, d.line_no, d.text, k.class_id, k.name_no, k.name from (select *, {LINE_TOKENS.format('text')} as lt from docs) d
join keys k on len(list_filter(range(len(lt) - len(toks) + 1), lambda i: len(list_filter(range(len(toks)), lambda j:
 levenshtein(lt[i + j + 1], toks[j + 1]) > case when len(toks[j + 1]) >= 8 then 2 when len(toks[j + 1]) >= 5 then 1 else 0 end)) = 0)) > 0"""
VIEWS["found"] = """
select doc, class_id, line_no, trim(text) as line, name_no, name from (select *, row_number() over (partition by doc, class_id
 order by line_no, name_no) as r from hits) where r = 1"""


def lines(spark, folder):
    rows = bridge.text_lines(spark, folder)
    return rows.select((F.col("line_no") % 97).alias("doc"), "line_no", "text")


def names(spark, folder):
    return bridge.catalogue(spark, folder).withColumn("name_no", F.lit(0))


@query("t01_fold", f"select doc_id, {FOLD.format('text')} as folded from documents")
def _(spark, folder):
    return bridge.table(spark, folder, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("t02_name_tokens", f"select class_id, array_to_string({NAME_TOKENS.format('name')}, ' ') as tokens from catalogue")
def _(spark, folder):
    rows = bridge.catalogue(spark, folder)
    return rows.select("class_id", F.array_join(T.name_tokens(F.col("name")), " ").alias("tokens"))


@query("t03_line_tokens", f"select line_no, array_to_string({LINE_TOKENS.format('text')}, ' ') as tokens from text_lines")
def _(spark, folder):
    rows = bridge.text_lines(spark, folder)
    return rows.select("line_no", F.array_join(T.line_tokens(F.col("text")), " ").alias("tokens"))


VOCABULARY = f"""
with a as (select distinct unnest({LINE_TOKENS.format('text')}) as line_token from documents),
 b as (select distinct unnest({NAME_TOKENS.format('name')}) as name_token from catalogue
  union select distinct unnest({LINE_TOKENS.format('text')}) from benchmark)
select line_token, name_token from a join b on levenshtein(line_token, name_token)
 <= case when len(name_token) >= 8 then 2 when len(name_token) >= 5 then 1 else 0 end"""


@query("t04_similar_tokens", VOCABULARY)
def _(spark, folder):
    docs = bridge.table(spark, folder, "documents")
    left = docs.select(F.explode(T.line_tokens(F.col("text"))).alias("line_token")).distinct()
    right = bridge.catalogue(spark, folder).select(F.explode(T.name_tokens(F.col("name"))).alias("name_token")).union(
        bridge.table(spark, folder, "benchmark").select(F.explode(T.line_tokens(F.col("text"))))).distinct()
    return fuzzy.similar_tokens(left, right)


@query("t05_sequence_hits", "select distinct line_no, class_id from hits")
def _(spark, folder):
    tokened = lines(spark, folder).withColumn("tokens", T.line_tokens(F.col("text")))
    found = fuzzy.sequence_hits(tokened.select("tokens").distinct(), fuzzy.catalogue_keys(names(spark, folder)))
    return tokened.join(found, "tokens").select("line_no", "class_id").distinct()


@query("t06_line_matches", "select doc, class_id, line_no, line, name_no, name from found")
def _(spark, folder):
    return fuzzy.match_lines(lines(spark, folder), names(spark, folder))


@query("j17_fuzzy_join", "select doc, count(*) as n_classes, min(line_no) as first_line from found group by 1")
def _(spark, folder):
    rows = fuzzy.match_lines(lines(spark, folder), names(spark, folder))
    return rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n_classes"), F.min("line_no").alias("first_line"))


# Lines of documents against the catalogue and the first words of benchmark items; tokens are compared once per pair.
DOCUMENT_LINES = f"""
with lines as (select doc_id as doc, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no
  from documents),
called as (select class_id, name, {NAME_TOKENS.format('name')} as toks from (select class_id, name from catalogue union all
  select 1000000 + item_id, array_to_string(string_split(text, ' ')[1:4], ' ') from benchmark)),
wanted as (select class_id, name, len(toks) as n, unnest(toks) as name_token, generate_subscripts(toks, 1) as at from called
  where len(array_to_string(toks, '')) >= 6),
split_lines as (select doc, line_no, {LINE_TOKENS.format('text')} as toks from lines),
placed as (select doc, line_no, unnest(toks) as line_token, generate_subscripts(toks, 1) as at from split_lines),
alike as (select line_token, name_token from (select distinct line_token from placed) a join (select distinct name_token from wanted) b
  on levenshtein(line_token, name_token) <= case when len(name_token) >= 8 then 2 when len(name_token) >= 5 then 1 else 0 end),
met as (select p.doc, p.line_no, w.class_id, w.name, p.at - w.at as start from placed p join alike using (line_token) join wanted w using (name_token)
  group by p.doc, p.line_no, w.class_id, w.name, w.n, p.at - w.at having count(distinct w.at) = w.n)
select doc, class_id, min(line_no) as line_no, any_value(name) as name from met group by 1, 2"""


def document_matches(spark, folder):
    docs = bridge.table(spark, folder, "documents")
    found = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    items = bridge.table(spark, folder, "benchmark").select(
        (F.col("item_id") + 1000000).cast("int").alias("class_id"), F.substring_index("text", " ", 4).alias("name"))
    every = bridge.catalogue(spark, folder).select("class_id", "name").union(items).withColumn("name_no", F.lit(0))
    return fuzzy.match_lines(found, every)


@query("t06_document_lines", DOCUMENT_LINES)
def _(spark, folder):
    return document_matches(spark, folder).select("doc", "class_id", "line_no", "name")


@query("j17_document_matches", f"select class_id, count(*) as n_docs, min(doc) as first_doc from ({DOCUMENT_LINES}) group by 1")
def _(spark, folder):
    rows = document_matches(spark, folder)
    return rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc").alias("first_doc"))


ASKED = "select distinct case p_partkey % 3 when 0 then upper(p_name) when 1 then substr(p_name, 1, 4) else ' ' || p_name || '!' end " \
        "as text from part union select '??' as text"


@query("t07_look_up", f"""
select text, (select class_id from (select class_id, {FOLD.format('name')} as n from catalogue) c
 where {FOLD.format('text')} <> '' and starts_with(n, {FOLD.format('text')}) order by n <> {FOLD.format('text')}, class_id limit 1)
 as class_id from ({ASKED})""")
def _(spark, folder):
    key, name = F.col("p_partkey"), F.col("p_name")
    asked = bridge.table(spark, folder, "part").select(
        F.when(key % 3 == 0, F.upper(name)).when(key % 3 == 1, F.substring(name, 1, 4))
        .otherwise(F.concat(F.lit(" "), name, F.lit("!"))).alias("text"))
    odd = bridge.table(spark, folder, "part").select(F.lit("??").alias("text")).limit(1)
    return fuzzy.look_up(asked.union(odd), bridge.catalogue(spark, folder))


@query("a39_match_scores", """
with truth as (select distinct p_partkey % 97 as doc, class_id from part join catalogue on name = p_name where p_partkey % 5 <> 0),
 f as (select distinct doc, class_id from found),
 called as (select class_id, split_part(name, ' ', 1) as name from catalogue),
 tn as (select distinct doc, name from truth join called using (class_id)), fn_ as (select distinct doc, name from f join called using (class_id)),
 t2 as (select t.*, exists (select 1 from f where f.doc = t.doc and f.class_id = t.class_id) as hit,
  exists (select 1 from called c join fn_ on fn_.name = c.name where c.class_id = t.class_id and fn_.doc = t.doc) as named from truth t),
 f2 as (select f.*, exists (select 1 from truth t where f.doc = t.doc and f.class_id = t.class_id) as hit,
  exists (select 1 from called c join tn on tn.name = c.name where c.class_id = f.class_id and tn.doc = f.doc) as named from f),
 s as (select (select count(*) from t2 where hit) as tp, (select count(*) from f2 where not hit) as fp, (select count(*) from t2 where not hit) as fn,
  (select count(*) from t2 where named) as name_tp, (select count(*) from f2 where not named) as name_fp,
  (select count(*) from t2 where not named) as name_fn)
select *, round(tp / greatest(1, tp + fn)::double, 6) as recall, round(tp / greatest(1, tp + fp)::double, 6) as precision,
 round(name_tp / greatest(1, name_tp + name_fn)::double, 6) as name_recall,
 round(name_tp / greatest(1, name_tp + name_fp)::double, 6) as name_precision from s""")
def _(spark, folder):
    catalogue = names(spark, folder)
    part = bridge.table(spark, folder, "part").filter(F.col("p_partkey") % 5 != 0)
    truth = part.join(catalogue, part["p_name"] == catalogue["name"]).select(
        (F.col("p_partkey") % 97).alias("doc"), "class_id")
    found = fuzzy.match_lines(lines(spark, folder), catalogue)
    called = catalogue.select("class_id", F.substring_index("name", " ", 1).alias("name"))
    rows = fuzzy.match_scores(truth, found, called)
    rates = ("recall", "precision", "name_recall", "name_precision")
    return rows.select(*[c for c in rows.columns if c not in rates], *[F.round(c, 6).alias(c) for c in rates])
