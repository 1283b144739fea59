"""Source divergence audit with a minimal acyclic transducer as vocabulary.

Terms are runs of ASCII letters and characters beyond ASCII, with A-Z lower-cased. A language keeps the terms that at
least MIN_DOCS of its documents hold; null text, lang and source are ''. The kept terms are sorted over the cluster and
each stretch of them becomes a minimal acyclic transducer, built in one pass over the sorted terms (states with the same
continuations are shared as soon as they are closed). Outputs on its edges sum up to a term's place among the
sorted terms, its ordinal. Texts are then streamed through the transducers, all words of a slice one byte at a time, and what
is counted, shuffled and compared from there on are ordinals; ties of values are broken by them.

A source's smoothed share of a term, in billionths, is p = 1 + floor(10**9 * (count + 5) / (N + 5 V)), computed exactly.
`pair` rows hold a source's summed distance to each other source of its language, `term` rows its terms with the largest
surplus over the language as a whole.

Bounds: a stretch has BLOCK terms, and ends only between terms that differ in their first 8 bytes, so that these tell a
word's stretch. Tasks get at most SHELF_BYTES of transducers at a time through the driver, which checks their sizes; a larger vocabulary
takes several passes over the documents of its languages. Distances are computed in blocks of CELL ordinals by two
tiles of TILE sources, so neither a common term nor a language with many sources meets in one task.

Defined cases: languages and (lang, source) groups without kept terms give `pair` rows of value 0; a language with one
source gives none; repeated rows are documents of their own; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

MIN_DOCS = 30
SMOOTH = 5
TOP = 50
BLOCK = 50_000
SHELF_BYTES = 64 << 20
CELL = 128
TILE = 64
#: For SQL; here terms are runs of these bytes, which is the same, as bytes beyond ASCII never stand alone.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that a task counts before it sends the sums on, distinct terms it holds, and bytes of a text that it cuts at once.
HELD = 2_000_000
TERMS_HELD = 400_000
PIECE = 1 << 20

_FOLD = bytes(c | 32 if 65 <= c <= 90 else c for c in range(256))
_TERMS = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Transducer:
    """Sorted distinct terms as a minimal acyclic automaton whose outputs sum to ordinals."""

    def __init__(self, keys: np.ndarray, target: np.ndarray, out: np.ndarray, final: np.ndarray, root: int):
        self.keys, self.target, self.out, self.final, self.root = keys, target, out, final, root

    @classmethod
    def build(cls, terms: list[bytes]) -> Transducer:
        """terms: sorted, distinct, none empty."""
        register: dict[tuple, int] = {}
        final, size, keys, target, out = [], [], [], [], []
        path: list[list] = [[False, []]]  # open states along the last term: [final, edges (byte, closed state)]
        last = b""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                ends, edges = path.pop()
                path[-1][1].append((last[len(path) - 1], state(ends, edges)))

        def state(ends: bool, edges: list) -> int:
            name = (ends, tuple(edges))
            if name not in register:
                register[name] = number = len(final)
                passed = int(ends)
                for byte, to in edges:
                    keys.append(number << 8 | byte)
                    target.append(to)
                    out.append(passed)
                    passed += size[to]
                final.append(ends)
                size.append(passed)
            return register[name]

        for term in terms:
            shared_part = 0
            for a, b in zip(last, term, strict=False):
                if a != b:
                    break
                shared_part += 1
            close(shared_part)
            path.extend([False, []] for _ in term[shared_part:])
            path[-1][0] = True
            last = term
        close(0)
        root = state(*path[0])
        return cls(np.array(keys, np.int64), np.array(target, np.int32), np.array(out, np.int64), np.array(final, bool), root)

    def ordinals(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The ordinal of each word of data (bytes), -1 for others; all words take a step together."""
        state = np.full(len(starts), self.root, np.int64)
        total = np.zeros(len(starts), np.int64)
        alive = np.arange(len(starts))
        step, most = 0, int(lengths.max(initial=0))
        while step < most and len(alive) and len(self.keys):
            alive = alive[lengths[alive] > step]
            wanted = state[alive] << 8 | data[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[at] == wanted
            state[alive[~there]] = -1
            alive, at = alive[there], at[there]
            state[alive] = self.target[at]
            total[alive] += self.out[at]
            step += 1
        return np.where((state >= 0) & self.final[state], total, -1)

    def pack(self) -> list[bytes]:
        return [x.tobytes() for x in (self.keys, self.target, self.out, self.final)]

    @classmethod
    def unpack(cls, keys: bytes, target: bytes, out: bytes, final: bytes, root: int) -> Transducer:
        return cls(np.frombuffer(keys, np.int64), np.frombuffer(target, np.int32), np.frombuffer(out, np.int64), np.frombuffer(final, bool), root)


def terms_of(text: bytes, most: int = PIECE):
    """Lists of the terms of a text, in pieces of about `most` bytes that end between terms."""
    text, at = text.translate(_FOLD), 0
    while at < len(text):
        end = _GAP.search(text, at + most)
        end = end.start() if end else len(text)
        yield _TERMS.findall(text, at, end)
        at = end


def _document_counts(batches):
    """Batches of (lang, text) to (lang, term, n): documents that hold a term, added up as far as memory allows."""
    held: dict[str, Counter] = {}

    def sums():
        for lang, counts in held.items():
            terms = list(counts)
            for a in range(0, len(terms), 100_000):
                part = terms[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([t.decode() for t in part], pa.string()), pa.array([counts[t] for t in part], pa.int64())], ["lang", "term", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            distinct: set[bytes] = set()
            for terms in terms_of(text.as_buffer().to_pybytes()):
                distinct.update(terms)
            held.setdefault(lang, Counter()).update(distinct)
            if sum(map(len, held.values())) >= TERMS_HELD:
                yield from sums()
    yield from sums()


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term): terms in at least min_docs documents of the language. docs: text and lang without nulls."""
    held = docs.select("lang", "text").mapInArrow(shared.tidy(_document_counts), "lang string, term string, n long")
    return held.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).select("lang", "term")


BLOCKS = "lang string, first binary, n long, bytes long, keys binary, target binary, out binary, final binary, root int, terms array<string>"


def _blocks(block: int):
    """Sorted (lang, term) rows to transducers of about block terms."""

    def row(lang: str, terms: list[str]):
        data = [t.encode() for t in terms]
        machine = Transducer.build(data)
        packed = machine.pack()
        one = [lang, data[0][:8], len(terms), sum(map(len, packed)), *packed, machine.root, terms]
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int32(), pa.list_(pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one, kinds, strict=True)], names)

    def run(batches):
        lang, terms = None, []
        for batch in batches:
            for new, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                full = len(terms) >= block and term.encode()[:8] != terms[-1].encode()[:8]
                if terms and (new != lang or full):
                    yield row(lang, terms)
                    terms = []
                lang = new
                terms.append(term)
        if terms:
            yield row(lang, terms)

    return run


def vocabulary(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """Transducers over stretches of each language's sorted terms, and `before`, the ordinal at which one begins."""
    head = F.substring(F.encode("term", "UTF-8"), 1, 8)
    ordered = kept.select("lang", "term", head.alias("head")).repartitionByRange("lang", "head").sortWithinPartitions("lang", "term").select("lang", "term")
    built = shared.cut(ordered.mapInArrow(_blocks(block), BLOCKS), "transducers")
    ahead = Window.partitionBy("lang").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    begins = built.select("lang", "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    return built.join(begins, ["lang", "first"])


def _route(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first 8 bytes of words as numbers that sort like them."""
    value = np.zeros(len(starts), np.uint64)
    for i in range(8):
        there = lengths > i
        byte = np.zeros(len(starts), np.uint64)
        byte[there] = data[starts[there] + i]
        value = value << np.uint64(8) | byte
    return value


def _recount(sent):
    """Batches of (lang, source, text) to (lang, source, ordinal, n)."""

    def run(batches):
        machines: dict[str, list] = {}
        for r in sent.value:
            machines.setdefault(r["lang"], []).append((int.from_bytes(bytes(r["first"]).ljust(8, b"\0"), "big"), r["before"], Transducer.unpack(*(bytes(r[c]) for c in ("keys", "target", "out", "final")), r["root"])))
        for held in machines.values():
            held.sort(key=lambda x: x[0])
        span = max((r["before"] + r["n"] for r in sent.value), default=1)
        groups: dict[tuple, int] = {}
        codes, counts, fresh, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged():
            every = np.concatenate([codes, *fresh])
            weights = np.concatenate([counts, np.ones(len(every) - len(counts), np.int64)])
            distinct, where = np.unique(every, return_inverse=True)
            return distinct, np.bincount(where, weights, len(distinct)).astype(np.int64)

        def sums():
            names = list(groups)
            for a in range(0, len(codes), 100_000):
                part = codes[a : a + 100_000]
                own = [names[g] for g in (part // span).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.string()), pa.array([x[1] for x in own], pa.string()), pa.array(part % span), pa.array(counts[a : a + 100_000])], ["lang", "source", "ordinal", "n"])

        for batch in batches:
            for piece in shared.slices(batch, 2):
                langs, sources = piece.column(0).to_pylist(), piece.column(1).to_pylist()
                group = np.array([groups.setdefault(x, len(groups)) for x in zip(langs, sources, strict=True)], np.int64)
                data, offsets = shared.joined(shared.utf8(piece.column(2)))
                data = shared.lower_ascii(data)
                edge = np.flatnonzero(np.diff(_LETTER[data], prepend=False, append=False))
                starts, lengths = edge[0::2], edge[1::2] - edge[0::2]
                doc = np.searchsorted(offsets, starts, "right") - 1
                number = {x: i for i, x in enumerate(dict.fromkeys(langs))}
                spoken = np.array([number[x] for x in langs])[doc]
                for lang, held in machines.items():
                    mine = np.flatnonzero(spoken == number.get(lang, -1))
                    where = np.zeros(len(mine), np.int64) if len(held) == 1 else np.searchsorted(np.array([x[0] for x in held], np.uint64), _route(data, starts[mine], lengths[mine]), "right") - 1
                    for i, (_, before, machine) in enumerate(held):
                        some = mine[where == i]
                        found = machine.ordinals(data, starts[some], lengths[some])
                        hit = found >= 0
                        fresh.append(group[doc[some[hit]]] * span + before + found[hit])
                        size += int(hit.sum())
                if size >= HELD:
                    codes, counts = merged()
                    fresh, size = [], 0
                    if len(codes) >= HELD // 2:
                        yield from sums()
                        groups = {}
                        codes, counts = codes[:0], counts[:0]
        codes, counts = merged() if fresh else (codes, counts)
        yield from sums()

    return run


def recount(docs: DataFrame, vocab: DataFrame, shelf_bytes: int = SHELF_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of kept terms, by streaming every text through the transducers."""
    spark = docs.sparkSession
    index = vocab.select("lang", "first", "bytes").orderBy("lang", "first").toPandas()
    out = None
    for a, b in shared.ranges(index["bytes"].tolist(), shelf_bytes):
        part = spark.createDataFrame(index.iloc[a:b][["lang", "first"]], "lang string, first binary")
        rows = vocab.drop("terms", "bytes").join(F.broadcast(part), ["lang", "first"]).collect()
        sent = spark.sparkContext.broadcast([r.asDict() for r in rows])
        texts = docs.filter(F.col("lang").isin(sorted({r["lang"] for r in rows}))).select("lang", "source", "text")
        counted = texts.mapInArrow(shared.tidy(_recount(sent)), "lang string, source string, ordinal long, n long")
        done = shared.cut(counted.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "recount")
        sent.destroy()
        out = done if out is None else out.union(done)
    return out if out is not None else spark.createDataFrame([], "lang string, source string, ordinal long, n long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / total), exactly: three digits at a time."""
    rest, value = count + SMOOTH, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        value = value * 1000 + F.call_function("div", rest, total)
        rest = rest % total
    return value + 1


def _distances(cell: int):
    """Rows of a block of ordinals and two tiles of sources to summed distances of sources."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, _, low, high = key
        plain = rows["ordinal"] < 0
        width = int(rows.loc[plain, "width"].iloc[0])

        def matrix(tile: int):
            base = rows[plain & (rows["tile"] == tile)].sort_values("place")
            numbers = base["place"].to_numpy(np.int64)
            out = np.repeat(base["p"].to_numpy(np.int64)[:, None], width, 1)
            real = rows[~plain & (rows["tile"] == tile)]
            out[np.searchsorted(numbers, real["place"].to_numpy(np.int64)), real["ordinal"].to_numpy(np.int64) % cell] = real["p"].to_numpy(np.int64)
            return numbers, out

        a, left = matrix(low)
        b, right = (a, left) if low == high else matrix(high)
        sums = np.stack([np.abs(right - row).sum(1) for row in left])
        one, two = np.repeat(a, len(b)), np.tile(b, len(a))
        once = one < two
        return pd.DataFrame({"lang": lang, "a": one[once], "b": two[once], "value": sums.ravel()[once]})

    return run


def pair_values(counts: DataFrame, groups: DataFrame, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language.

    groups: lang, source, total (N + 5 V), v, place (from 0 within lang), last (its largest); counts: lang, source, ordinal, n.
    """
    group = groups.select("lang", "source", "total", "v", "place", F.expr(f"place div {tile}").alias("tile"), F.expr(f"last div {tile}").alias("tiles"))
    real = counts.join(group, ["lang", "source"]).select("lang", F.expr(f"ordinal div {cell}").alias("cell"), "tile", "tiles", "place", "ordinal", share(F.col("n"), F.col("total")).alias("p"), F.lit(0).cast("long").alias("width"))
    cells = group.filter("v > 0").withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(v - 1) div {cell}"))))
    plain = cells.select("lang", "cell", "tile", "tiles", "place", F.lit(-1).cast("long").alias("ordinal"), share(F.lit(0), F.col("total")).alias("p"), F.least(F.lit(cell), F.col("v") - F.col("cell") * cell).cast("long").alias("width"))
    dealt = real.union(plain).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "tiles")))
    dealt = dealt.select("lang", "cell", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "place", "ordinal", "p", "width")
    parts = dealt.groupBy("lang", "cell", "low", "high").applyInPandas(_distances(cell), "lang string, a long, b long, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    mine, theirs = groups.select("lang", "source", F.col("place").alias("p1")), groups.select("lang", F.col("source").alias("item"), F.col("place").alias("p2"))
    pairs = mine.join(theirs, "lang").filter("p1 <> p2").withColumns({"a": F.least("p1", "p2"), "b": F.greatest("p1", "p2")})
    return pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, shelf_bytes: int = SHELF_BYTES, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text, "text"), (lang, "lang"), (source, "source"))])
    vocab = shared.cut(vocabulary(kept_terms(docs, min_docs), block), "vocabulary")
    counts = shared.cut(recount(docs, vocab, shelf_bytes), "counts")
    sizes = vocab.groupBy("lang").agg(F.sum("n").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = Window.partitionBy("lang")
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "v"])
    groups = shared.cut(groups.select("lang", "source", (F.col("total") + SMOOTH * F.col("v")).alias("total"), "v", (F.row_number().over(whole.orderBy("source")) - 1).cast("long").alias("place"), (F.count("*").over(whole) - 1).alias("last")), "groups")
    pairs = pair_values(counts, groups, cell, tile)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    common = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("all"))
    spoken = groups.groupBy("lang").agg((F.sum(F.col("total") - SMOOTH * F.col("v")) + SMOOTH * F.max("v")).alias("every"))
    q = common.join(spoken, "lang").select("lang", "ordinal", share(F.col("all"), F.col("every")).alias("q"))
    surplus = counts.join(groups.select("lang", "source", "total"), ["lang", "source"]).join(q, ["lang", "ordinal"]).withColumn("value", share(F.col("n"), F.col("total")) - F.col("q")).filter("value > 0")
    ranked = surplus.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))).filter(F.col("rank") <= top)
    names = vocab.select("lang", "before", F.posexplode("terms").alias("at", "item")).select("lang", (F.col("before") + F.col("at")).alias("ordinal"), "item")
    terms = ranked.join(names.hint("merge"), ["lang", "ordinal"])
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").union(columns(terms, "term"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (lang, source): distances to the other sources of the language, and the terms with the largest surplus."""
    return audit(shared.read(spark, sf_dir, "documents"))


ORACLE = rf"""
with d as (
  select row_number() over () as id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
o as (select id, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from d),
k as (select lang, term from o group by lang, term having count(distinct id) >= {MIN_DOCS}),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from o join k using (lang, term) group by all),
t as (select g.lang, g.source, coalesce(v, 0) as v, coalesce((select sum(n) from c where c.lang = g.lang and c.source = g.source), 0) as total from g left join v using (lang)),
p as (
  select t.lang, t.source, k.term, coalesce(c.n, 0) as n, (1 + (1000000000::hugeint * (coalesce(c.n, 0) + {SMOOTH})) // (t.total + {SMOOTH} * t.v)::hugeint)::bigint as p
  from t join k using (lang) left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
s as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
w as (
  select c.lang, c.term, (1 + (1000000000::hugeint * (sum(n) + {SMOOTH})) // (max(a.total) + {SMOOTH} * max(v.v))::hugeint)::bigint as q
  from c join (select lang, sum(total) as total from t group by lang) a using (lang) join v using (lang) group by c.lang, c.term),
terms as (select p.lang, p.source, p.term as item, p.p - w.q as value from p join w using (lang, term) where p.n > 0 and p.p > w.q),
r as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) from terms)
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= {TOP}
"""
