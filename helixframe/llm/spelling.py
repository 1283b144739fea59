"""Spelling variants of one edit, found with bidirectional FM-indexes over the delimited vocabulary.

The vocabulary are the words of at least MIN_CHARS code points that occur MIN_COUNT times. The index of a part of it
holds the cyclic text $word$word...$word, its suffix ranks and those of the reversed text, and the counts of
signs before marked places, so a pattern is a pair of intervals of suffix ranks, one in each direction. A word is searched in two
ways, once for each half: the half is matched exactly from its inner end outwards to the delimiter, by narrowing the
forward interval and keeping the other in step; from the other interval the pattern is then extended across the second half,
allowing one inserted, deleted or replaced sign, to the closing delimiter. All words of a part take a step together.

A word that keeps its first half keeps its first three signs, and one that keeps its second half its last three (words
have six at least). So the vocabulary is dealt out by its first three signs for one search and by its last three for the
other, and each part is searched by its own words only. A part that grew over OVERFULL times PART words, such as one frequent
ending, is cut by the words' lengths and kept halves, and its words are searched in three pieces at most. What the second search finds that keeps
the first half too is dropped, so each near word is found once.

A task returns, for each word, how many near words it found and the best; sums and the best of all follow. Roots come by
pointer doubling: forms lead to words of larger counts, so there are no circles, and each round halves the way.

Defined cases: a null or empty text holds no words; a null id counts as an empty one in the hash; repeated rows count
each; an empty table gives no rows; very long runs are words like others. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MIN_CHARS = 6
MIN_COUNT = 5
TIMES = 5
PART = 1024
OVERFULL = 4
#: Every so many hashes a sign is lost.
EVERY = 199
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = 3
#: Counts of signs that an index keeps for each direction; a longer text has marks at every second place, or fourth, ...
MARKS = 4_000_000
#: Words whose steps are taken together.
TOGETHER = 8192


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Starts of the rotations of a text in sorted order, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    length = 1
    while True:
        order = np.argsort(rank * (int(rank.max()) + 1) + np.roll(rank, -length), kind="stable") if length < n else np.argsort(rank, kind="stable")
        pair = np.stack([rank, np.roll(rank, -length)])[:, order] if length < n else rank[order][None]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum((pair[:, 1:] != pair[:, :-1]).any(0))])
        length *= 2
        if length >= n or int(rank.max()) == n - 1:
            return order


class Half:
    """Suffix ranks of one direction: intervals of patterns that grow at the front."""

    def __init__(self, text: np.ndarray, signs: int):
        n = len(text)
        self.order = suffix_ranks(text)
        last = text[self.order - 1]
        self.step = 1  # places between marks
        while n // self.step * signs > MARKS:
            self.step *= 2
        counts = np.zeros((n // self.step + 2, signs), np.int32)
        np.add.at(counts, (np.arange(n) // self.step + 1, last), 1)
        self.marks = np.cumsum(counts, 0, dtype=np.int32)
        self.padded = np.concatenate([last, np.zeros(self.step, last.dtype)])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=signs))[:-1]])

    def before(self, place: np.ndarray) -> np.ndarray:
        """How often each sign stands before a place of the last column: a row for each place."""
        block, rest = place // self.step, place % self.step
        out = self.marks[block].astype(np.int64)
        rows = np.arange(len(place))
        for i in range(int(rest.max(initial=0))):
            some = rows[rest > i]
            out[some, self.padded[block[some] * self.step + i]] += 1
        return out

    def extended(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals (low, size) with each sign put in front: a row for each interval, a column for each sign."""
        a = self.before(low)
        return self.first + a, self.before(low + size) - a

    def with_sign(self, low: np.ndarray, size: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals with one given sign put in front of each."""

        def before(place):
            block, rest = place // self.step, place % self.step
            out = self.marks[block, sign].astype(np.int64)
            for i in range(int(rest.max(initial=0))):
                out += (self.padded[block * self.step + i] == sign) & (rest > i)
            return out

        a = before(low)
        return self.first[sign] + a, before(low + size) - a


class Index:
    """Both directions over the words of one part. Words are rows of small numbers, 0 is the delimiter."""

    def __init__(self, words: list[np.ndarray], signs: int):
        text = np.concatenate([np.concatenate([[0], w]) for w in words]).astype(np.uint8)
        self.signs = signs
        self.forward = Half(text, signs)
        self.backward = Half(text[::-1].copy(), signs)
        lengths = np.array([len(w) + 1 for w in words])
        # By place in the reversed text: the word that a delimiter closes is the one before it.
        self.owner = np.roll(np.repeat(np.arange(len(words)), lengths), 1)[::-1]

    def exact(self, flat: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals in the backward direction of $ and the first `ends` signs of each word; words begin at `begin` in flat."""
        n = len(begin)
        low, other, size = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.forward.order), np.int64)
        for step in range(int(ends.max(initial=-1)) + 1):
            some = np.flatnonzero((ends >= step) & (size > 0))
            if not len(some):
                break
            sign = np.where(ends[some] > step, flat[np.maximum(begin[some] + ends[some] - 1 - step, 0)], 0)
            lows, sizes = self.forward.extended(low[some], size[some])
            rows = np.arange(len(some))
            smaller = np.cumsum(sizes, 1) - sizes
            low[some], other[some], size[some] = lows[rows, sign], other[some] + smaller[rows, sign], sizes[rows, sign]
        return other, size

    def near(self, words: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, indexed word) of all pairs of one edit that lies beyond the first `ends` signs."""
        lengths = np.array([len(w) for w in words])
        flat = np.concatenate([*words, [0]]).astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])

        def sign(word, at):
            return np.where(at < lengths[word], flat[np.minimum(begin[word] + at, len(flat) - 1)], 0)

        low, size = self.exact(flat, begin, ends)
        word = np.flatnonzero(size > 0)
        low, size, at = low[word], size[word], ends[word].astype(np.int64)
        edited = []
        while len(word):
            lows, sizes = self.backward.extended(low, size)
            own, inner = sign(word, at), at < lengths[word]
            rows, put = np.nonzero(sizes[:, 1:])
            put = put + 1
            to = (word[rows], lows[rows, put], sizes[rows, put])
            edited.append((*to, at[rows]))  # a sign more
            other = inner[rows] & (put != own[rows])
            edited.append((*(x[other] for x in to), at[rows][other] + 1))  # another sign
            edited.append((word[inner], low[inner], size[inner], at[inner] + 1))  # a sign less
            row = np.arange(len(word))
            on = inner & (sizes[row, own] > 0)
            word, low, size, at = word[on], lows[row, own][on], sizes[row, own][on], at[on] + 1
        if not edited:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        word, low, size, at = (np.concatenate(x) for x in zip(*edited, strict=True))
        found = []
        while len(word):
            low, size = self.backward.with_sign(low, size, sign(word, at))
            done = (at >= lengths[word]) & (size > 0)
            found.append(np.stack([word[done], self.owner[self.backward.order[low[done]]]]))
            on = (at < lengths[word]) & (size > 0)
            word, low, size, at = word[on], low[on], size[on], at[on] + 1
        pairs = np.unique(np.concatenate(found, 1), axis=1)
        return pairs[0], pairs[1]


def near_in_part(turned: bool):
    """Rows (word, n, indexed) of a part to (word, n_near, best_n, best) of the words that have near ones in it."""

    def run(rows: pa.Table) -> pa.Table:
        texts, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
        alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(texts))))}
        coded = [np.array([alphabet[c] for c in (t[::-1] if turned else t)], np.uint8) for t in texts]
        ends = np.array([len(t) - len(t) // 2 if turned else len(t) // 2 for t in texts])
        held = np.flatnonzero(rows.column("indexed").to_numpy())
        many: dict[int, int] = {}
        best: dict[int, tuple] = {}
        if len(held):
            index = Index([coded[i] for i in held], len(alphabet) + 1)
            for a in range(0, len(texts), TOGETHER):
                word, other = index.near(coded[a : a + TOGETHER], ends[a : a + TOGETHER])
                for w, o in zip((word + a).tolist(), held[other].tolist(), strict=True):
                    one, two = texts[w], texts[o]
                    if w == o or turned and two.startswith(one[: len(one) // 2]):
                        continue
                    many[w] = many.get(w, 0) + 1
                    mine = (-counts[o], two)
                    best[w] = min(best.get(w, mine), mine)
        columns = [texts[w] for w in many], list(many.values()), [-best[w][0] for w in many], [best[w][1] for w in many]
        kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["word", "n_near", "best_n", "best"])

    return shared.lean(run)


def words_of(docs: DataFrame, text: str = "text", order: str = "doc_id", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the vocabulary, with the signs that the hash of a run takes out."""
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(RUN), F.lit(0))
    each = docs.select(F.coalesce(F.col(order).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % EVERY == 0, lost).otherwise(F.col("run"))
    kept = each.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= min_chars)
    return kept.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _search(vocab: DataFrame, turned: bool, parts: int, part: int) -> DataFrame:
    """Near words of one search: dealt by the first or last three signs, large parts in pieces by length and the half that stays.

    A near word of length n is found by words of n - 1 to n + 1 signs, whose kept halves have (n - 1) // 2 signs at least
    from the front and n // 2 from the end. So a word is indexed in one piece and searched in three at most.
    """
    text = F.reverse("word") if turned else F.col("word")
    dealt = vocab.withColumn("part", F.pmod(F.xxhash64(F.substring(text, 1, KEY)), F.lit(parts)))
    sizes = dealt.groupBy("part").agg(F.when(F.count("*") > OVERFULL * part, F.ceil(F.count("*") / part)).otherwise(1).cast("int").alias("pieces"))
    placed = dealt.join(F.broadcast(sizes), "part")

    def piece(n: Column) -> Column:
        kept = F.floor((n if turned else n - 1) / 2).cast("int")
        return F.pmod(F.xxhash64(n, F.substring(text, F.lit(1), kept)), F.col("pieces")).cast("int")

    n = F.length("word")
    every = placed.withColumn("own", piece(n)).withColumn("piece", F.explode(F.array_distinct(F.array(piece(n - 1), piece(n), piece(n + 1)))))
    rows = every.select("part", "piece", "word", "n", (F.col("piece") == F.col("own")).alias("indexed"))
    return rows.groupBy("part", "piece").applyInArrow(near_in_part(turned), "word string, n_near long, best_n long, best string")


def near_words(vocab: DataFrame, part: int = PART) -> DataFrame:
    """(word, n_near, best_n, best) for words of (word, n) that have near ones; the best has the largest n, then is smallest."""
    parts = max(1, -(-vocab.count() // part))
    found = _search(vocab, False, parts, part).union(_search(vocab, True, parts, part))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of the way along forms, by pointer doubling."""
    state, changed = forms.select("word", F.col("form").alias("root")), True
    while changed:
        ahead = state.select(F.col("word").alias("at"), F.col("root").alias("next"))
        new = state.join(ahead, state["root"] == ahead["at"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        state = shared.cut(new, "roots")
        changed = bool(state.filter("moved").limit(1).count())
        state = state.select("word", "root")
    return state


def variants(vocab: DataFrame, times: int = TIMES, part: int = PART) -> DataFrame:
    """word, form, root, n, n_near, form_n for a vocabulary (word, n) of distinct words."""
    near = vocab.join(near_words(vocab, part), "word", "left")
    good = F.col("best_n") >= times * F.col("n")
    held = shared.cut(near.select("word", F.when(good, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best_n")).alias("form_n")), "variants")
    ways = roots(held.filter("form is not null"))
    return held.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word of the vocabulary: form, root, n, n_near, form_n."""
    return variants(shared.cut(words_of(shared.read(spark, sf_dir, "documents")), "words"))


def _oracle() -> str:
    from .sharding import CRC_SQL

    return rf"""
with recursive d as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{RUN}')) as run from documents),
r as (select id, run, count(*) as k, {CRC_SQL.format(text="id || ':' || run")} as h from d group by id, run),
w as (select case when h % {EVERY} = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, k from r),
v as (select word, sum(k)::bigint as n from w where length(word) >= {MIN_CHARS} group by word having sum(k) >= {MIN_COUNT}),
p as (select word, n, unnest(range(1, length(word) + 1)) as i from v),
g as (select distinct word, n, substr(word, 1, i - 1) || substr(word, i + 1) as shorter from p),
s as (select word, n, i, substr(word, 1, i - 1) || '_' || substr(word, i + 1) as gap from p),
near as (
  select a.word, b.word as other, b.n as m from s a join s b on a.gap = b.gap and a.i = b.i and a.word <> b.word
  union select g.word, v.word, v.n from g join v on g.shorter = v.word
  union select v.word, g.word, g.n from g join v on g.shorter = v.word),
b as (select word, count(*) as n_near, max(m) as best_n from near group by word),
c as (select b.word, n_near, best_n, min(other) as best from b join near on near.word = b.word and m = best_n group by all),
f as (
  select v.word, case when best_n >= {TIMES} * n then best end as form, n, coalesce(n_near, 0)::bigint as n_near, case when best_n >= {TIMES} * n then best_n end as form_n
  from v left join c using (word)),
way as (select word, word as at, form from f union all select way.word, f.word, f.form from way join f on f.word = way.form)
select f.word, f.form, way.at as root, f.n, f.n_near, f.form_n from f join way on way.word = f.word and way.form is null
"""


ORACLE = _oracle()
