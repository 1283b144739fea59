"""Sharding, spelling variants and the divergence audit against plain versions, and on nulls, repeats, hot groups and clashes."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import divergence, sharding, spelling
from tests.llm.conftest import DOCS

# Sharding


def placed(df, **settings):
    return sharding.shard(df, **settings).collect()


def check_shards(rows, docs, shards, slack=sharding.SLACK):
    """Near equal bytes, gapless slots, few texts in two shards."""
    sizes, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        text = (r.text or "").encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[r.text or ""].add(r.shard)
    assert sorted((r.doc_id is None, r.doc_id, r.text or "") for r in rows) == sorted((d[0] is None, d[0], d[1] or "") for d in docs)
    total, largest = sum(sizes.values()), max(r.size for r in rows)
    for s in range(shards):
        assert abs(sizes[s] - total / shards) <= 2 * slack * total / shards + 2 * largest
        assert sorted(slots[s]) == list(range(len(slots[s])))
    assert sum(len(x) > 1 for x in where.values()) < shards
    return where


def test_shards_are_even_and_keep_copies_together(spark, docs, rows):
    check_shards(placed(docs, shards=5), rows, 5)
    r = random.Random(2)
    many = [(i, "word " * r.randint(0, 60) + str(i % 700), None, None) for i in range(3000)]
    where = check_shards(placed(spark.createDataFrame(many, DOCS), shards=7), many, 7)
    small = [t for t, x in where.items() if len(x) > 1]
    assert all(sum(len(m[1]) + 8 for m in many if m[1] == t) > 0.01 * sum(len(m[1]) + 8 for m in many) / 7 for t in small)


def test_a_hot_text_is_cut_and_ranges_are_drawn_again(spark, monkeypatch):
    many = [(i % 900 if i % 50 else None, "the same text everywhere" if i % 3 else f"other {i}", None, None) for i in range(6000)]
    df = spark.createDataFrame(many, DOCS)
    rows = placed(df, shards=6)
    check_shards(rows, many, 6)
    expected = [tuple(x) for x in sorted(map(tuple, sharding.shard(df, shards=6).select("shard", "slot", "text").collect()))]
    monkeypatch.setattr(sharding, "DRAWS", 1)  # poor splitters change the work, not the result
    monkeypatch.setattr(sharding, "RANGES", 3)
    monkeypatch.setattr(sharding, "OVERFULL", 2)
    assert [tuple(x) for x in sorted(map(tuple, sharding.shard(df, shards=6).select("shard", "slot", "text").collect()))] == expected


def test_shards_of_little_and_of_clashing_names(spark, empty, put):
    assert placed(empty) == [] and sharding.op11_sharding(spark, put(documents=empty)).collect() == []
    one = placed(spark.createDataFrame([(1, "x", None, None)], DOCS))
    assert [r.slot for r in one] == [0]
    odd = spark.createDataFrame([(1, "a", 7, "k", 5), (1, "a", 7, "k", 5), (None, None, 8, "l", 6)], "doc_id long, text string, shard int, key string, `row.x` int")
    out = sharding.shard(odd, shards=2)
    assert out.columns == ["doc_id", "text", "key", "row.x", "size", "text_crc32", "shard", "slot"] and out.count() == 3


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/out", rows_per_file=7, shards=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.shard, r.slot) for r in back.collect()) == sorted((r.shard, r.slot) for r in placed(docs, shards=4))


# Spelling variants


def plain_variants(counts, times=spelling.TIMES):
    """By comparing all pairs."""

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= times * n else None
        out[w] = [form, None, n, len(others), None if form is None else counts[form]]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(v) for w, v in out.items()}


def made_words(r, n):
    base = ["".join(r.choice("abcé") for _ in range(r.randint(6, 11))) for _ in range(n)]
    words = set(base)
    for w in base:
        for _ in range(r.randint(0, 5)):
            i, kind = r.randrange(len(w) + 1), r.randrange(3)
            w2 = w[:i] + (r.choice("abÿ") if kind != 1 else "") + w[i + (kind > 0) :]
            words.add(w2)
            if r.random() < 0.3:
                w = w2
    return {w: r.choice([5, 7, 30, 160, 900]) for w in words if len(w) >= 6}


@pytest.mark.parametrize("part", [4, 60, 10_000])
def test_variants_equal_all_pairs(spark, part):
    counts = made_words(random.Random(part), 120)
    counts |= {"aaaaaa": 100, "aaaaaaa": 10, "aaaaaaaa": 2000, "aaaaaab": 100, "baaaaaa": 100, "x" * 300: 5, "x" * 301: 50}
    got = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), part=part).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(counts) and len(got) == len(counts)


def test_sparse_marks_change_nothing(monkeypatch):
    words = list(made_words(random.Random(9), 40))
    signs = {c: i + 1 for i, c in enumerate(sorted(set("".join(words))))}
    coded, ends = [np.array([signs[c] for c in w], np.uint8) for w in words], np.array([len(w) // 2 for w in words])
    found = []
    for marks in (4_000_000, 200):
        monkeypatch.setattr(spelling, "MARKS", marks)
        found.append(np.stack(spelling.Index(coded, len(signs) + 1).near(coded, ends)).tolist())
    assert found[0] == found[1] and found[0][0]


def test_words_lose_a_sign_by_hash(spark, docs, rows, empty, put):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    expected = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert {r.word: r.n for r in spelling.words_of(docs).collect()} == expected
    got = spelling.op12_spelling(spark, put(documents=docs)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == plain_variants(expected)
    assert spelling.op12_spelling(spark, put(documents=empty)).collect() == []
    odd = spark.createDataFrame([(None, "straße straße straße STRAßE straße a", 1, 2)] * 2, "doc_id long, text string, word int, n int")
    assert {(r.word, r.n) for r in spelling.words_of(odd).collect()} == {("straße", 10)}


def test_suffix_ranks_sort_rotations():
    r = random.Random(5)
    for n in (1, 2, 3, 17, 200):
        text = np.array([0] + [r.randint(1, 3) for _ in range(n - 1)])
        rotations = [tuple(np.roll(text, -i)) for i in range(n)]
        assert [rotations[i] for i in spelling.suffix_ranks(text)] == sorted(rotations)


# Divergence


def plain_audit(rows, min_docs, top):
    docs = [((t or ""), (g or ""), (s or "")) for _, t, g, s in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in docs]
    out = []
    for lang in {g for _, g, _ in docs}:
        mine = [(s, w) for (_, g, s), w in zip(docs, words) if g == lang]
        seen = Counter(x for _, w in mine for x in set(w))
        kept = sorted((x for x, n in seen.items() if n >= min_docs), key=lambda x: x.encode())
        counts = {s: Counter() for s, _ in mine}
        for s, w in mine:
            counts[s].update(x for x in w if x in set(kept))
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))
        p = {s: [share(c[x], c.total()) for x in kept] for s, c in counts.items()}
        every = sum(counts.values(), Counter())
        q = [share(every[x], every.total()) for x in kept]
        for s in counts:
            pairs = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in counts if o != s), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)]
            terms = sorted((b - a, i) for i, (a, b) in enumerate(zip(p[s], q)) if counts[s][kept[i]] and a > b)[:top]
            out += [(lang, s, "term", kept[i], -v, n) for n, (v, i) in enumerate(terms, 1)]
    return sorted(out)


@pytest.mark.parametrize("settings", [{}, {"block": 3, "shelf_bytes": 600, "cell": 4, "tile": 1}, {"cell": 2, "tile": 2, "block": 1}])
def test_audit_equals_plain_counts(spark, docs, rows, settings):
    got = sorted(tuple(r) for r in divergence.audit(docs, min_docs=3, top=6, **settings).collect())
    assert got == plain_audit(rows, 3, 6) and {r[2] for r in got} == {"pair", "term"}


def test_audit_of_many_sources_and_little(spark, empty, put):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["Été", "été", "ab", "abc", "日本", "b", "zz9zz"]) for _ in range(r.randint(0, 9))), r.choice(["x", None, ""]), f"s{r.randrange(9)}") for i in range(150)]
    rows += [(1, None, "only", None), (2, "ab", "two", "a"), (2, "ab", "two", "b"), (2, "ab", "two", "b")]
    df = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit(1)).withColumn("rank", F.lit(2))
    got = sorted(tuple(x) for x in divergence.audit(df, min_docs=4, top=3, tile=2, cell=2).collect())
    assert got == plain_audit(rows, 4, 3)
    assert ("two", "a", "pair", "b", 0, 1) in got and not [x for x in got if x[0] == "only"]
    assert divergence.op13_divergence(spark, put(documents=empty)).collect() == []


def test_counts_are_sent_on_when_many(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    got = sorted(tuple(r) for r in divergence.audit(docs, min_docs=3, top=6).collect())
    assert got == plain_audit(rows, 3, 6)


def test_transducer_is_minimal_and_ordinal():
    r = random.Random(1)
    terms = sorted({bytes(r.choice(b"abc\xc3") for _ in range(r.randint(1, 7))) for _ in range(400)})
    machine = divergence.Transducer.build(terms)
    suffixes = {frozenset(t[i:] for t in terms if t.startswith(x)) for i in range(8) for x in {t[:i] for t in terms if len(t) >= i}}
    assert len(machine.final) == len(suffixes)  # a state for each set of continuations, no more
    words = terms + [t + b"a" for t in terms[:50]] + [t[:-1] + b"z" for t in terms[:50]] + [b"zz"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths + 1) - lengths - 1
    place = {t: i for i, t in enumerate(terms)}
    assert machine.ordinals(data, starts, lengths).tolist() == [place.get(w, -1) for w in words]
    again = divergence.Transducer.unpack(*machine.pack(), machine.root)
    assert again.ordinals(data, starts, lengths).tolist() == machine.ordinals(data, starts, lengths).tolist()


def test_shares_are_exact(spark):
    rows = [(0, 7), (10**15, 3 * 10**15 + 1), (8 * 10**14, 8 * 10**14 + 5), (3, 11)]
    got = spark.createDataFrame(rows, "n long, total long").select(divergence.share(F.col("n"), F.col("total"))).collect()
    assert [r[0] for r in got] == [1 + 10**9 * (n + 5) // t for n, t in rows]
