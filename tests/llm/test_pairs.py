"""Line dedup, n-gram join, decontamination, top-k search."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, graph, linededup, ngram_join, shared, topk


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_linededup_equals_brute_force(put, docs, rows):
    r = random.Random(8)
    base = ["".join(r.choice("abcd é") for _ in range(r.randint(16, 40))).strip() or "x" for _ in range(8)]

    def changed(s):
        s = list(s)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(s))
            s[i : i + r.randint(0, 1)] = r.choice(["", "z", "y"])
        return "".join(s)

    given = [(i, "\n".join(changed(r.choice(base)) for _ in range(r.randint(0, 5)))) for i in range(40)] + [(i + 100, t) for i, t, *_ in rows] + [(300 + i, "".join(r.choice("ab") for _ in range(r.randint(5, 10)))) for i in range(25)]
    df = docs.sparkSession.createDataFrame(given, "doc_id long, text string")
    assert tuples(linededup.op1_linededup(docs.sparkSession, put(documents=df))) == sorted(linededup.brute(given), key=repr)


def test_linededup_texts(spark, empty):
    line = "a line of more than sixteen signs"
    df = spark.createDataFrame([(1, f"{line}\n\nshort\nshort", "k"), (2, f"{line}x\nown line that is long enough", "k"), (None, line, "n"), (3, None, "n")], "doc_id long, text string, __id string")
    out = {r.doc_id: r.text for r in linededup.dedup(df).collect()}
    assert out == {1: f"{line}\n\nshort", 2: "own line that is long enough", None: line, 3: None}
    assert linededup.dedup(empty).count() == 0


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_distance(spark, edits):
    r = random.Random(edits)
    pairs = [("".join(r.choice("ab") for _ in range(r.randint(1, 12))), "".join(r.choice("ab") for _ in range(r.randint(1, 12)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.levenshtein("a", "b").alias("want"), linededup.bit_distance(F.col("a"), F.col("b"), edits).alias("got"))
    assert all(min(x.want, edits + 1) == x.got for x in df.collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 40), (40, 45), (7, 7)]
    got = dict(tuples(graph.components(spark.createDataFrame(edges, "a long, b long"), "t")))
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 45: 40, 50: 40}


@pytest.mark.parametrize("reach", [1, 3])
def test_components_of_long_chains(spark, reach):
    """Chains of shuffled ids, each node linked to the next ones, are one component each."""
    ids = random.Random(reach).sample(range(10_000), 4000)
    chains = [ids[:3000], ids[3000:]]
    edges = [(c[i], c[i + d]) for c in chains for d in range(1, reach + 1) for i in range(len(c) - d)]
    got = dict(tuples(graph.components(spark.createDataFrame(edges, "a long, b long"), "t")))
    assert got == {i: min(c) for c in chains for i in c}


def test_ngram_join_equals_brute_force(put, docs, rows):
    got = tuples(ngram_join.op10_ngram_join(docs.sparkSession, put(documents=docs)))
    assert got == sorted(ngram_join.brute([(i, t) for i, t, *_ in rows]), key=repr)


@pytest.mark.parametrize("tile", [300, 2_000_000])
def test_ngram_join_of_a_large_group(spark, tile):
    """Copies with edits of their own: one group, cut into many tiles where a tile is small."""
    r = random.Random(1)
    base = [f"w{r.randrange(500)}" for _ in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(r.randint(0, 3)):
            words[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(ngram_join.join(df, tile=tile)) == sorted(ngram_join.brute(rows), key=repr)


def test_line_keys_are_compiled(spark):
    """The JVM interprets methods of more than 8000 bytes, which made keys several times as slow."""
    sized = linededup.lines(spark.range(1).selectExpr("id as doc_id", "repeat('x', 99) as text")).withColumn("len", F.length("line"))
    keys = linededup.keyed(sized, linededup.EDITS, linededup.PER)
    found = keys._jdf.queryExecution().debug().codegenToSeq()
    assert max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.size())) < 8000
    assert keys.count() == 12 and keys.filter("key % 2 <> 0").count() == 3


def test_ngram_join_entries_are_small(spark):
    """The shuffle's bulk are entries: 12 bytes each make more disk than the budget."""
    import numpy as np

    rows = [(i, " ".join(str(i * 1000 + k) for k in range(500))) for i in range(200)]
    found = ngram_join.entries(spark.createDataFrame(rows, "id long, text string").coalesce(1), 8).filter("slot >= 0").collect()
    assert sum(len(r["keys"]) + len(r["who"]) for r in found) < 10 * 200 * 496
    r = np.random.default_rng(3)
    for keys in ([], [7], [0, 2**64 - 1], [5, 5, 6], sorted(r.integers(0, 2**64, 999, np.uint64).tolist())):
        keys = np.array(keys, np.uint64)
        assert ngram_join.unpacked_keys(ngram_join.packed_keys(keys)).tolist() == keys.tolist()
    for who in ([], [0, 1 << 14, 5 | 1 << 31], [1 << 15, 3 | 1 << 31]):
        assert ngram_join.unpacked_places(ngram_join.packed_places(np.array(who, np.uint32))).tolist() == who


@pytest.mark.parametrize("bits", [12, 26])
def test_ngram_join_leaves_out_just_copies(spark, monkeypatch, bits):
    """A small sieve takes rows for copies by mistake; they stay, as do rows of other texts of a copy's id, and rows without sums."""
    monkeypatch.setattr(shared, "SIEVE_BITS", bits)
    rows = [(i, 5, i * 7 if i % 3 else None, i * 11 if i % 3 else None, b"x") for i in range(3000)] + [(1, 5, 99, 99, b"y")]
    kept = spark.createDataFrame(rows, "id long, n long, set1 long, set2 long, columns binary")
    gone = kept.filter("set1 is not null and id % 2 = 1 and set1 <> 99").select("id", "n", "set1", "set2")
    left = ngram_join._without(kept, gone, ["n", "set1", "set2"])
    assert sorted(map(repr, map(tuple, left.select("id", "n", "set1", "set2").collect()))) == sorted(repr(r[:4]) for r in rows if not (r[2] is not None and r[0] % 2 == 1 and r[2] != 99))


def test_ngram_join_edges(spark, empty):
    assert ngram_join.join(empty).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "q r s t u v w"), (2, "Q r s t u v w"), (None, "a b c d e f")], "doc_id long, text string")
    assert tuples(ngram_join.join(df)) == [(1, 3, 1), (2, 3, 1)]
    kept = spark.createDataFrame([(1, "a b c d e f", 5), (2, "A b c d e f", 6), (None, "a b", 7)], "doc_id long, text string, id int")
    assert tuples(ngram_join.keep_first(kept)) == [(1, "a b c d e f", 5), (None, "a b", 7)]


def bench_items():
    r = random.Random(6)
    return [(i, " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(30))) for i in range(6)] + [(90, None), (91, "too short"), (92, "")]


def leak_docs():
    r = random.Random(7)
    items = bench_items()
    own = lambda: " ".join("".join(r.choice("ijklmnop") for _ in range(r.randint(2, 9))) for _ in range(40))
    out = [(i, own()) for i in range(8)] + [(100, None), (101, "")]
    for i in range(10, 30):
        passage = list(items[i % 6][1])
        for _ in range(r.randint(0, 14)):
            passage[r.randrange(len(passage))] = r.choice(["", "q", "zz", " "])
        out.append((i, own() + " " + "".join(passage).upper() + "! " + own()))
    return out + [(40, items[0][1] + "\n" + items[1][1]), (41, items[2][1][40:150])]


def test_decontamination_equals_brute_force(spark, put):
    items, given = bench_items(), leak_docs()
    path = put(documents=spark.createDataFrame(given, "doc_id long, text string"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.op7_decontaminate(spark, path).collect()}
    assert got == decontaminate.brute(given, items)
    assert {40, 10} <= {d for d, _ in got} and not {d for d, _ in got} & set(range(8))


CASED = [
    "L'été dernier, à la même époque, l'élève préféré du collège était déjà très fâché, car sa mère âgée avait égaré où là-bas la clé dorée.",
    "Съешь же ещё этих мягких французских булок, да выпей чаю, пока на улице идёт холодный осенний дождь и шумит старый лес.",
    "Ο άνθρωπος πήγε στο δάσος και βρήκε τους παλιούς φίλους του, όμως κανένας δεν ήξερε πώς να γυρίσει στις πόλεις τους.",
    "Die große Straße außerhalb der Stadt heißt draußen Süßholzgasse, und die Füße der müden Gäste grüßen fröhlich die weißen Mäuse.",
    "Irmağın kıyısındaki ışıklı kasabanın kızları yazın sıcağında balıkçının kırmızı kayığına bakıp şarkı mırıldanırdı, çocuklar ağlardı.",
]


def passages_by_alignment(docs, items):
    """(doc_id, item_id) by aligning segments with whole texts, sharing nothing with the operator."""
    plain = lambda t: re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", t.upper().casefold()).encode()
    found = set()
    for item, passage in items:
        body = plain(passage).strip(b" ")
        last = max(0, len(body) - 100)
        for part in {body[s : s + 100] for s in [*range(0, last, 50), last]}:
            for ident, t in docs:
                row = list(range(len(part) + 1))
                for byte in plain(t):
                    new = [0]
                    for i, p in enumerate(part):
                        new.append(min(row[i] + (p != byte), row[i + 1] + 1, new[i] + 1))
                    row = new
                    if row[-1] <= len(part) * 8 // 100:
                        found.add((ident, item))
                        break
    return found


def test_decontamination_of_capitals_in_all_scripts(spark):
    r = random.Random(9)
    items = list(enumerate(CASED))
    other = " Other words that no item has at all. "
    given = [(i, other + t.upper() + other) for i, t in items] + [(10 + i, t.lower() + other) for i, t in items]
    for i, t in items:  # capitals with a few letters changed, and with too many
        for base, n in ((20, 3), (30, 60)):
            s = list(t.upper())
            for at in r.sample(range(len(s)), n):
                s[at] = "x"
            given.append((base + i, "".join(s)))
    given.append((40, other * 4))
    df, bench = spark.createDataFrame(given, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(d.doc_id, d.item_id) for d in decontaminate.matches(df, bench).collect()}
    assert got == passages_by_alignment(given, items)
    assert {(i, i) for i in range(5)} | {(10 + i, i) for i in range(5)} <= got
    assert not {d.doc_id for d in decontaminate.clean(df, bench).collect()} & {d for d, _ in got}


def test_decontamination_folds_case_of_every_letter():
    fold = lambda c: decontaminate.fold_case(c.encode())
    letters = [c for c in map(chr, range(128, 0x110000)) if not 0xD800 <= ord(c) < 0xE000]
    assert not [c for c in letters if not (c.upper().isascii() or c.lower().isascii()) and len({fold(c), fold(c.upper()), fold(c.lower())}) > 1]
    assert decontaminate.fold_case(b"\xff\xc3\x89") == b"\xff\xc3\xa9"


def test_decontamination_keeps_clean_rows_and_columns(spark):
    items = spark.createDataFrame(bench_items(), "item_id long, text string")
    given = leak_docs()
    df = spark.createDataFrame([(i, t, i * 2) for i, t in given], "doc_id long, text string, item_id long")
    bad = {d for d, _ in decontaminate.brute(given, bench_items())}
    kept = decontaminate.clean(df, items)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in given} - bad
    assert decontaminate.clean(df, items.limit(0)).count() == len(given)
    assert decontaminate.matches(df.limit(0), items).count() == 0
    assert decontaminate.matches(df, items.limit(0)).count() == 0


def test_decontamination_in_blocks(spark):
    items = spark.createDataFrame(bench_items(), "item_id long, text string")
    assert [len(b) for b in decontaminate.blocks(items.coalesce(1), most=300)][0] < 6


def brute_top(vectors, k=5):
    ok = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % 50 == 0:
            width = max(len(v) for v in ok.values())
            pad = lambda v, w=width: np.pad(v, (0, w - len(v)))
            best = sorted((-int(pad(ok[q]) @ pad(v)), i) for i, v in ok.items() if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_topk_equals_brute_force(spark, put):
    r = np.random.default_rng(1)
    vectors = [(i, [float(np.float32(x)) for x in r.standard_normal(8) * 0.3]) for i in range(150)]
    vectors += [(200, vectors[3][1]), (201, vectors[3][1]), (202, None), (203, [1.0, None]), (204, [float("nan")] * 8), (205, [float("inf")] * 8), (250, [0.5]), (251, [])]
    path = put(embeddings=spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score int".rsplit(",", 1)[0]))
    assert sorted(map(tuple, topk.op9_topk(spark, path).collect())) == brute_top(vectors)


def test_topk_small_blocks_and_empty(spark):
    r = np.random.default_rng(2)
    rows = [(i, [int(x) for x in r.integers(-200, 200, 16)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<bigint>")
    got = topk.search(topk.build_index(df, 32), df.filter("id % 50 = 0"), 3, query_rows=2)
    want = [(q, n, i, s) for q, v in rows if q % 50 == 0 for n, (s, i) in enumerate(sorted(((-int(np.dot(v, w)), i) for i, w in rows if i != q))[:3], 1) for s in [-s]]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.search(topk.build_index(df.limit(0)), df.limit(0)).count() == 0
    assert topk.search(topk.build_index(df.limit(1)), df.limit(1)).count() == 0


def test_linededup_of_repeated_ids(spark):
    df = spark.createDataFrame([(1, "hello world line", "x"), (1, "hello world line", "y"), (2, "aaaaaaaaaa\nbbbbbbbbbb", "z"), (2, "bbbbbbbbbb\ncccccccccc", "w"), (None, "hello world line", "v")], "doc_id long, text string, row string")
    out = [tuple(r) for r in linededup.dedup(df).collect()]
    assert sorted(len(t) for d, t, _ in out if d == 1) == [0, 16] and {r for *_, r in out} == set("xyzwv")
    assert sorted(line for d, t, _ in out if d == 2 for line in t.split("\n")) == ["aaaaaaaaaa", "bbbbbbbbbb", "cccccccccc"]
    assert [t for d, t, _ in out if d is None] == ["hello world line"]


def test_linededup_texts_are_those_of_the_counts(put, docs, rows):
    path = put(documents=docs)
    counts = {r.doc_id: r.n_kept for r in linededup.op1_linededup(docs.sparkSession, path).collect()}
    texts = {r.doc_id: r.text for r in linededup.dedup_lines(docs.sparkSession, path).collect()}
    assert {d: sum(bool(x.strip(" ")) for x in (t or "").split("\n")) for d, t in texts.items()} == counts


def test_verbatim_passages_are_found_wherever_they_start(spark):
    """100 folded bytes of an item, in other words, from every start; what is found is known without segments."""
    r = random.Random(12)
    item = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(60))
    filler = lambda: " ".join("".join(r.choice("klmnopqrst") for _ in range(6)) for _ in range(12))
    starts = range(len(item) - 100 + 1)
    docs = [(s, f"{filler()} {item[s : s + 100]} {filler()}") for s in starts] + [(10_000 + s, f"{filler()} {item[s : s + 60]} {filler()}") for s in starts[:40]]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert {x.doc_id for x in found.collect()} == set(starts)


def test_lines_that_share_a_segment_are_told_apart_before_pairs_are_made(spark, monkeypatch):
    """Characters in another order have their parities in common, but not those of neighbours; edits change few of either."""
    from pyspark.sql import functions as F

    from helixframe.llm import linededup

    r = random.Random(11)
    head = "all of these lines begin with the same words and go on in another order of them "
    tail = "stone river lantern winter candle orchard meadow thunder garden copper"
    base = [head + "".join(r.sample(tail, len(tail))).replace(" ", "_") for _ in range(60)]
    texts = [*base]
    for line in base[:30]:
        for _ in range(2):
            i = r.randrange(len(line))
            line = r.choice([line[:i] + line[i + 1 :], line[:i] + "é" + line[i:], line[:i] + "q" + line[i + 1 :]])
        texts.append(line)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    both = docs.select(linededup.pair_parities("text").alias("s")).collect()
    assert all(((both[i].s ^ both[60 + i].s) & (1 << 64) - 1).bit_count() <= 8 for i in range(30))
    seen, verified = [], linededup._verified
    monkeypatch.setattr(linededup, "_verified", lambda pairs, *more: seen.append(pairs.distinct().count()) or verified(pairs, *more))
    found = {tuple(x) for x in linededup.links(docs).select("a", "b").collect()}
    hashes = [x.h for x in docs.orderBy("doc_id").select(F.xxhash64(F.trim("text")).alias("h")).collect()]
    assert {frozenset(x) for x in found} == {frozenset((hashes[i], hashes[60 + i])) for i in range(30)}
    assert sum(seen) < 200
