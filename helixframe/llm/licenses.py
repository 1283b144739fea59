"""License scan by diagonal voting; DataFrame functions only.

Every rolling K-gram of words of every text is hashed and joined to the positions at which license templates hold that
K-gram (a fixed list, so the broadcast is bounded). A match, whose words are compared as well, votes for its
diagonal, the word position minus the template position. Votes are summed by document, template and diagonal; a diagonal
takes in those within the template's slack, which bridges inserted or missing words, and stands as a candidate when it has
the K-grams that must be left after EDITS of the template's words have changed. Of neighbouring candidates the one with
most votes stands, so a long run of votes is cut to its best window. The words of that span are verified by
alignment: their edit distance to the template, over the template's length, must not exceed EDITS. Base phrases vote with
pairs and must be there whole, on one diagonal.

Texts of documents without a candidate are not moved: a bitmap of bounded size keeps them out of the verifying join.

Defined cases: null text is empty; documents without words have n_words 0, empty labels, score 0; every row is scanned on
its own, also rows that share a doc_id or have none (equal rows have equal results); other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .license_texts import BASE, TEMPLATES

K = 4
EDITS = 0.1
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _clean(text: str) -> str:
    return " ".join(x for x in re.split(SEPARATOR, text.lower()) if x)


def _slack(size: int) -> int:
    return max(2, size // 20)


def _values() -> str:
    """(template, label, base, k, size, slack, need, whole) of every template, as SQL values."""
    rows = []
    for t, (text, label, base) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in TEMPLATES]):
        whole = _clean(text)
        size, k = len(whole.split(" ")), 2 if base else K
        need = size - k + 1 if base else max(1, size - k + 1 - k * int(size * EDITS))
        rows.append(f"({t}, '{label}', {str(base).lower()}, {k}, {size}, {_slack(size)}, {need}, '{whole}')")
    return ", ".join(rows)


SLACK = max(_slack(len(_clean(text).split(" "))) for text, _ in TEMPLATES)


def words(text: str) -> Column:
    """Words with A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), SEPARATOR), "")


def templates(spark: SparkSession) -> DataFrame:
    """h, template, tpos, gram and what belongs to the template, for each of its K-grams."""
    rows = spark.sql(f"select * from values {_values()} as t(template, label, base, k, size, slack, need, whole)").withColumn("ws", F.split("whole", " "))
    at = rows.withColumn("tpos", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))))
    gram = F.slice("ws", F.col("tpos") + 1, F.col("k"))
    return at.select(F.xxhash64(gram).alias("h"), "template", "label", "base", "k", "size", "slack", "need", "whole", "tpos", gram.alias("gram"))


def votes(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """id, row (a hash of the text), template and what belongs to it, diagonal, pos, tpos: a row for each matching K-gram."""
    rows = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("row"), words(text).alias("words"))
    hashes = lambda k: F.transform("words", lambda _, i: F.xxhash64(F.slice("words", i + 1, k)))
    hashed = rows.withColumn("hashes", F.concat(hashes(2), hashes(K)))
    # The outer form: for the plain one the optimizer infers a filter that would split the text once a word.
    grams = hashed.select("id", "row", "words", F.posexplode_outer("hashes").alias("at", "h"))
    found = grams.join(F.broadcast(templates(docs.sparkSession)), "h").withColumn("pos", F.col("at") % F.size("words"))
    return found.filter(F.slice("words", F.col("pos") + 1, F.col("k")) == F.col("gram")).select(
        "id", "row", "template", "label", "base", "size", "slack", "need", "whole", (F.col("pos") - F.col("tpos")).alias("diagonal"), "pos", "tpos"
    )


def spans(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """id, row, label, base, first, last (word positions), score of every span that is verified."""
    of = ["id", "row", "template"]
    keys = [*of, "label", "base", "size", "slack", "need", "whole"]
    diagonals = shared.cut(
        votes(docs, ident, text).groupBy(*keys, "diagonal").agg(F.collect_set("tpos").alias("tposes"), F.min("pos").alias("first"), F.max("pos").alias("last")), "diagonals"
    )
    base = diagonals.filter("base and size(tposes) = need").select("id", "row", "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("score"))
    near = Window.partitionBy(*of).orderBy("diagonal").rangeBetween(-SLACK, SLACK)
    around = F.filter(F.collect_list(F.struct("first", "last", "diagonal", "tposes")).over(near), lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= F.col("slack"))
    wide = (
        diagonals.filter("not base").withColumn("around", around)
        .withColumn("seen", F.size(F.array_distinct(F.flatten(F.transform("around", lambda x: x["tposes"])))))
        .withColumn("from", F.array_min("around")["diagonal"])
        .withColumn("to", F.array_max(F.transform("around", lambda x: F.struct(x["last"].alias("last"), x["diagonal"].alias("diagonal"))))["diagonal"] + F.col("size"))
        .filter("seen >= need")
    )
    order = Window.partitionBy(*of).orderBy("diagonal")
    jump = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack")).cast("int"), F.lit(0))
    best = (
        wide.withColumn("jump", jump).withColumn("run", F.sum("jump").over(order))
        .groupBy(*keys, "run").agg(F.max_by(F.struct("from", "to"), F.struct("seen", -F.col("diagonal"))).alias("b"))
        .select(*keys, F.greatest("b.from", F.lit(0)).alias("from"), "b.to")
    )
    best = shared.cut(best, "candidates")
    rows = docs.select(F.col(ident).alias("id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    texts = shared.sifted(rows, "row", shared.sieve(best, "row")).dropDuplicates(["id", "row"]).select("id", "row", words("text").alias("words"))
    met = best.join(texts.withColumnRenamed("id", "id2").withColumnRenamed("row", "row2"), F.col("id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")))
    met = met.withColumn("to", F.least("to", F.size("words")))

    def distance(start: Column, stop: Column) -> Column:
        span = F.regexp_replace(F.array_join(F.slice("words", start + 1, stop - start), " "), r"[^\x00-\x7F]+", "?")
        return F.levenshtein(span, F.col("whole"))

    # Words before the first vote, or after the last one, may have moved by the slack: the nearest start, then the nearest end.
    starts = F.sequence(F.greatest(F.col("from") - F.col("slack"), F.lit(0)), F.col("from"))
    met = met.withColumn("from", F.array_min(F.transform(starts, lambda x: F.struct(distance(x, F.col("to")).alias("d"), x.alias("at"))))["at"])
    ends = F.sequence(F.col("to"), F.least(F.col("to") + F.col("slack"), F.size("words")))
    met = met.withColumn("end", F.array_min(F.transform(ends, lambda x: F.struct(distance(F.col("from"), x).alias("d"), x.alias("at"))))).withColumn("to", F.col("end.at"))
    most = F.floor(F.length("whole") * F.lit(EDITS)).cast("int")
    scored = met.withColumn("d", F.col("end.d")).filter(F.col("d") <= most)
    own = scored.select("id", "row", "label", "base", F.col("from").alias("first"), (F.col("to") - 1).alias("last"), (F.lit(1.0) - F.col("d") / F.length("whole")).alias("score"))
    return base.unionByName(own)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    in_base = lambda c: F.when(F.col("base"), F.col(c))
    found = spans(docs).groupBy("id", "row").agg(
        F.count(in_base("first")).alias("n_base"), F.min(in_base("first")).cast("long").alias("first_word"), F.max(in_base("first")).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(in_base("label"))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    sizes = docs.select("doc_id", F.xxhash64("text").alias("row2"), F.size(words("text")).cast("long").alias("n_words"))
    both = sizes.join(found, sizes["doc_id"].eqNullSafe(found["id"]) & (sizes["row2"] == found["row"]), "left")
    return both.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _distance(start: str, stop: str) -> str:
    return rf"levenshtein(regexp_replace(array_to_string(ws[{start} + 1:{stop}], ' '), '[^\x00-\x7F]+', '?', 'g'), whole)"


ORACLE = rf"""
with t as (select *, string_split(whole, ' ') as ws from (values {_values()}) as v(template, label, base, k, size, slack, need, whole)),
g as (select t.*, tpos, ws[tpos + 1:tpos + k] as gram from (select *, unnest(range(size - k + 1)) as tpos from t) t),
d as (select row_number() over () as rid, doc_id,
  list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SEPARATOR}'), lambda x: x <> '') as ws from documents),
w as (select rid, ws, unnest(range(len(ws))) as pos from d),
v as (
  select rid, g.*, pos, pos - tpos as diagonal from (select rid, pos, ws[pos + 1:pos + 2] as gram from w) join g using (gram) where k = 2
  union all by name select rid, g.*, pos, pos - tpos as diagonal from (select rid, pos, ws[pos + 1:pos + {K}] as gram from w) join g using (gram) where k = {K}),
x as (
  select rid, template, label, base, size, slack, need, whole, diagonal, list(distinct tpos) as tposes, min(pos) as first, max(pos) as last from v
  group by 1, 2, 3, 4, 5, 6, 7, 8, 9),
a0 as (
  select *, list({{'first': first, 'last': last, 'diagonal': diagonal, 'tposes': tposes}}) over (partition by rid, template order by diagonal range between {SLACK} preceding and {SLACK} following) as ar
  from x where not base),
a1 as (select *, list_filter(ar, lambda y: abs(y.diagonal - diagonal) <= slack) as around from a0),
a2 as (
  select *, len(list_distinct(flatten(list_transform(around, lambda y: y.tposes)))) as seen, list_sort(list_transform(around, lambda y: [y.first, y.diagonal]))[1][2] as lo,
    list_sort(list_transform(around, lambda y: [y.last, y.diagonal]))[-1][2] + size as hi from a1),
a3 as (select * from a2 where seen >= need),
a4 as (select *, coalesce((diagonal - lag(diagonal) over (partition by rid, template order by diagonal) > slack)::int, 0) as jump from a3),
a5 as (select *, sum(jump) over (partition by rid, template order by diagonal) as run from a4),
a6 as (select * from (select *, row_number() over (partition by rid, template, run order by seen desc, diagonal) as rn from a5) where rn = 1),
a7 as (select rid, label, base, slack, whole, ws, greatest(lo, 0) as lo, least(hi, len(ws)) as hi from (select a6.* exclude (ar, around, tposes), d.ws from a6 join d using (rid))),
a8 as (select *, list_sort(list_transform(range(greatest(lo - slack, 0), lo + 1), lambda i: [{_distance('i', 'hi')}, i]))[1][2] as f from a7),
a9 as (select *, list_sort(list_transform(range(hi, least(hi + slack, len(ws)) + 1), lambda i: [{_distance('f', 'i')}, i]))[1][1] as dist from a8),
s as (
  select rid, label, base, diagonal as first, 1.0::double as score from x where base and len(tposes) = need
  union all select rid, label, base, f as first, 1.0::double - dist / length(whole)::double from a9 where dist <= floor(length(whole) * {EDITS})),
r as (
  select rid, count(*) filter (base) as n_base, min(first) filter (base) as first_word, max(first) filter (base) as last_word,
    coalesce(string_agg(distinct label, ',' order by label) filter (base), '') as base_labels, string_agg(distinct label, ',' order by label) as labels, max(score) as score from s group by rid)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0::double) as score
from d left join r using (rid)
"""
