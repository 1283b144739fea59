"""Plain versions of the models, and nulls, repeats, clashing names, long texts and bounds of every operator."""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, langid, licenses, linededup, mixing, ngram_join, shared, tokenids, topk, toxicity, warc

BIG = 9007199254740993
MASK = (1 << 64) - 1


def mix(x):
    for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * k) & MASK
    return x ^ (x >> 31)


def plain_score(net, text):
    """The network's score of one text: a loop over windows, words and signs."""
    data = bytes(ord(chr(c).lower()) if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in text.encode())
    sig = lambda z: 1 / (1 + np.exp(-z))
    vectors = []
    for word in data.split():
        h = mix((sum((c + 1) * pow(0x100000001B3, i, 1 << 64) for i, c in enumerate(word)) + len(word) * 0x9E3779B97F4A7C15) & MASK)
        bucket = h % toxicity.WORDS
        around = [1, *word, 2]
        grams = [(((around[i] << 16 | around[i + 1] << 8 | around[i + 2]) * 2654435761) & 0xFFFFFFFF) >> 19 for i in range(len(word))]
        vectors.append(np.concatenate([net.p["word"][bucket], [net.word_odds[bucket]], np.mean([net.p["gram"][g] for g in grams], 0), [np.mean([net.gram_odds[g] for g in grams])]]))
    logits, at = [], 0
    while True:
        window, states = vectors[at : at + toxicity.WINDOW], {}
        for d, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            h, n = np.zeros(toxicity.HIDDEN), toxicity.HIDDEN
            for t in order:
                a, b = window[t] @ net.p[f"w{d}"] + net.p[f"c{d}"], h @ net.p[f"u{d}"]
                z, r = sig(a[:n] + b[:n]), sig(a[n : 2 * n] + b[n : 2 * n])
                h = h + (1 - z) * (np.tanh(a[2 * n :] + r * b[2 * n :]) - h)
                states[d, t] = h
        both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(window))] or [np.zeros(2 * toxicity.HIDDEN)]
        weight = np.exp([s @ net.p["att"] for s in both])
        logits.append(float(sum(w * s for w, s in zip(weight, both, strict=True)) / weight.sum() @ net.p["out"] + net.p["bias"][0]))
        at += toxicity.STEP
        if at + toxicity.WINDOW - toxicity.STEP >= len(vectors):
            break
    top = sorted(logits, reverse=True)
    return sig(np.array([top[0], np.mean([sig(x) for x in logits]), np.mean(top[:4])]) @ net.head[:3] + net.head[3])


def test_toxicity_equals_a_plain_loop():
    r = random.Random(3)
    words = "stone river idiot moon été clown Cloud x".split()
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 5, 31, 32, 33, 48, 49, 64, 65, 200, 500)] + ["", "!!!"]
    train = [" ".join(r.choice(words[:2] + words[3:]) for _ in range(40)) + (" idiot" if i % 2 else "") for i in range(60)]
    net = toxicity.train([t.encode() for t in train], np.arange(60) % 2)
    assert net.scores([t.encode() for t in texts]) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


def test_toxicity_ids_names_and_long_training_texts(spark):
    r = random.Random(1)
    rows = [(BIG + i, " ".join(r.choice(["stone", "river", "moon"]) for _ in range(20)) + (" scum" * 3 if i % 2 else ""), "s", "p", None) for i in range(80)]
    rows += [(BIG, None, None, None, 1), (BIG, "scum scum scum", "x", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string, held int")
    labels = spark.createDataFrame([(BIG + i, i % 2) for i in range(80)], "doc_id long, toxic int")
    net = toxicity.learn(docs, labels)
    out = toxicity.score(docs, net)
    assert out.columns == ["doc_id", "text", "held", "score", "predicted"] and {r.doc_id for r in out.collect()} == {BIG + i for i in range(80)}
    import corpus_pipeline

    kept = toxicity.score(docs, net, names=tuple(shared.fresh(docs.columns, "score", "predicted")))
    assert kept.columns == [*docs.columns, "score_", "predicted_"]
    assert corpus_pipeline.STAGES[0][0] == "toxicity"
    # Where one class is only in texts longer than the former limit of 8000 characters, it is learned all the same.
    long = spark.createDataFrame([(i, ("stone river " * 700 if i % 2 else "moon cloud ") + ("scum " * 60 if i % 2 else "")) for i in range(60)], "doc_id long, text string")
    found = toxicity.score(long, toxicity.learn(long, labels.limit(0).union(spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))))
    assert all(x.predicted == x.doc_id % 2 for x in found.collect())


def language_rows(n=150):
    r = random.Random(2)
    stems = {"en": "th wh ing tion ould ea".split(), "fr": "eau oi é que ment aux".split(), "xx": ["zq"]}
    return [(i, " ".join("".join(r.choice(stems[lang]) for _ in range(3)) for _ in range(r.choice([5, 60, 2000]))), lang) for i in range(n) for lang in [r.choice(["en", "fr"])]]


def plain_dictionaries(rows):
    """What sample() must give: slices in the order of the id's hash."""
    out = {}
    learn = [(i, t, lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    size = min(langid.DICT_BYTES, langid.ALL_BYTES // len({x[2] for x in learn}))
    for lang in sorted({x[2] for x in learn}):
        mine = [(xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest() % (1 << 30) / (1 << 30), t) for i, t, g in learn if g == lang]
        mine = [(u, t.lower()[len(t) // 3 if len(t) > 3 * langid.SLICE_BYTES else 0 :][: langid.SLICE_BYTES]) for u, t in mine if u * len(mine) < 2 * (size // langid.SLICE_BYTES) + 16]
        out[lang] = b"".join(t.encode()[: langid.SLICE_BYTES] for _, t in sorted(mine))[:size]
    return out


def test_language_equals_a_plain_loop(spark, put):
    rows = [*language_rows(), (1000, "zqzqzq", "xx")]
    got = {r.doc_id: r for r in langid.op5_langid(spark, put(documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect()}
    given = plain_dictionaries(rows)
    assert set(given) == {"en", "fr", "xx"}  # six bytes of sample are enough to be predicted
    for ident, text, _ in rows:
        data, sums = text.lower().encode(), []
        for lang in sorted(given):
            whole = given[lang] * (2 if len(given[lang]) < 8 else 1)
            tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(whole, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            sums.append((sum(len(tool.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)), lang))
        (first, lang), (second, _) = sorted(sums)[:2]
        gap = (second - first) / second
        assert got[ident].lang_pred == lang and got[ident].score == pytest.approx(min(1.0, gap / (gap + langid.MARGIN)), abs=0.02)


def test_language_ids_names_letters(spark):
    df = spark.createDataFrame([(BIG, "½ 12", "s", "l"), (BIG, "ª the", None, None), (None, "thing", "a", "b"), (3, "日本", "a", "b")], "doc_id long, text string, score string, lang_pred string")
    out = langid.predict(df, "text", {"en": b"the thing that", "fr": b"eau que oi mais"})
    assert out.columns == ["doc_id", "lang_pred", "score", "accepted"]
    found = [(r.doc_id, r.lang_pred == "und") for r in out.collect()]
    assert sorted(found, key=repr) == sorted([(BIG, True), (BIG, False), (None, False), (3, False)], key=repr)


def test_mixing_names_ties_and_reruns(spark):
    names = "doc_id long, text string, source string, __key string, __words int, __target int, row string, copies string, source_size int"
    rows = [(i % 5 or None, f"w{i} x y", None if i % 7 == 0 else f"s{i % 2}", f"k{i}", i, -i, "r", "c", 1) for i in range(200)]
    df = spark.createDataFrame(rows, names)
    once = sorted(map(tuple, mixing.emit(df, slice_rows=16).collect()), key=repr)
    again = sorted(map(tuple, mixing.emit(df.repartition(7), slice_rows=16).collect()), key=repr)
    assert once == again and set(once) <= set(rows) and mixing.emit(df).columns == df.columns
    assert {x[3] for x in once} != {x[3] for x in map(tuple, mixing.emit(df, seed=8, slice_rows=16).collect())}


def test_mixing_slices_of_ids_with_a_common_step(spark):
    df = spark.createDataFrame([(i * 64, "a b", "s") for i in range(4000)], "doc_id long, text string, source string")
    spread = df.select((mixing.digits(F.col("doc_id").cast("string")) % 40).alias("s")).groupBy("s").count().collect()
    assert len(spread) == 40 and max(r["count"] for r in spread) < 200


def test_warc_repeats_nulls_and_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART_RECORDS", 4)
    rows = [(7, "u", "same"), (7, "u", "same"), (None, "n", "same"), (None, "n", "alone"), (None, "m", "alone")] + [(100 + i, f"u{i}", "hot") for i in range(30)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, address string, part int")
    where = shared.shared_path(spark, "t")
    warc.write(df, where)
    assert spark.read.parquet(f"{where}/payloads").count() == 3
    out = warc.records(spark, where).collect()
    assert len(out) == len(rows)
    kinds = [(r.page_id, bytes(r.payload).decode(), r.record_type, r.refers_to) for r in out]
    assert kinds.count((7, "same", "response", None)) == 2 and (None, "same", "revisit", 7) in kinds and kinds.count((None, "alone", "response", None)) == 2
    assert sum(k[2] == "response" for k in kinds if k[1] == "hot") == 1 and (129, "hot", "response", None) in kinds


def test_token_blocks_and_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(tokenids, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(tokenids, "SLICE_BYTES", 100)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["stone", "été", "日本", "<|endoftext|>", "x"]) for _ in range(r.choice([0, 1, 20, 49, 50, 300])))) for i in range(120)]
    got = sorted(map(tuple, tokenids.encode_and_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == tokenids.brute(rows, tokenids.tokenizer_path())
    same = spark.createDataFrame([(5, f"text {i}", i) for i in range(60)] + [(None, None, -1)] * 3, "doc_id long, text string, part int")
    out = tokenids.encode_and_digest(same).orderBy("start").collect()
    assert [x.doc_id for x in out] == [None] * 3 + [5] * 60 and [x.start for x in out] == list(np.cumsum([0] + [x.n_tokens for x in out])[:-1])


@pytest.mark.parametrize("n", [65_536, 65_537, 140_000])
def test_codes_of_many_ids(n):
    lengths = tokenids.code_lengths(np.ones(n, np.int64))
    code = tokenids.Code(lengths)
    ids = np.arange(n)[:: n // 999]
    bits, offsets = code.pack(ids)
    assert (code.unpack(bits, offsets, len(ids)) == ids).all() and sum(2.0 ** -lengths.astype(float)) <= 1


def test_table_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenids, "TABLE_BYTES", 2000)
    table = tokenids._Table(lambda k: k.encode())
    for i in range(1000):
        assert table[str(i)] == str(i).encode() and table["often"] == b"often" and len(table) + len(table.old) < 40


class _Counted:
    """A library object that notes what it is asked to encode."""

    def __init__(self, held):
        self.held, self.asked = held, []

    def tokenize(self, text):
        self.asked.append(text)
        return self.held.tokenize(text)

    def encode(self, text, **more):
        self.asked.append(text)
        return self.held.encode(text, **more)


def test_token_pieces_share_calls_of_the_library():
    e = tokenids.Encoder(tokenids.tokenizer_path())
    words = " ".join(f"w{i:x}é don't" for i in range(4000))
    want = e.whole(words)
    e.model = _Counted(e.model)
    assert e.text(words) == want and len(e.model.asked) < 100
    foreign = "stone " * 2000 + "日本語 – x\u3000 y" + " stone's" * 2000
    want = e.whole(foreign)
    e.tool = _Counted(e.tool)
    assert e.text(foreign) == want and sum(map(len, e.tool.asked)) < 100


def test_token_texts_of_a_column_and_arrays_are_bounded(monkeypatch):
    monkeypatch.setattr(tokenids, "TABLE_BYTES", 3000)
    monkeypatch.setattr(tokenids, "SLICE_BYTES", 60)
    e, r = tokenids.Encoder(tokenids.tokenizer_path()), random.Random(5)
    signs = [*"  \n\t'stremdlv 12,.\x85\xa0éɏɐ’日", "'s", "'re", " often", "<|endoftext|>"]
    for _ in range(300):
        texts = [r.choice([None, "", "".join(r.choice(signs) for _ in range(r.choice([1, 9, 200])))]) for _ in range(r.randint(1, 9))]
        assert e.texts(pa.array(texts, pa.string())[1:]) == [e.whole(t or "") for t in texts[1:]]
        assert sum(map(len, e.pieces.keys.to_pylist())) + 4 * len(e.pieces.ids) <= 3000
    assert e.pieces.find(pa.array([b" often"], pa.large_binary()))[1].tolist() == [1]
    with pytest.raises(pa.ArrowInvalid):
        e.texts(pa.array([b"a \xc3"]).view(pa.string()))


def test_decontamination_of_short_null_and_long_items(spark, monkeypatch):
    r = random.Random(4)
    long = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(500))
    items = [(None, "exactly this short item"), (1, "yes"), (2, "a bcdef g"), (3, "12345678"), (4, long), (5, "!?"), (6, "Thirty-one letters in all here.")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "oh, EXACTLY this-short item"), (2, "exactly this short items"), (3, "no yesterday"), (4, "(Yes)"), (5, "a bcdef g"), (6, "xa bcdef g"), (7, long[900:1100]), (8, "x" + long[2400:2526] + "x"), (9, "012345678 9"), (10, None), (11, "thirty one letters in all here"), (12, "thirty one letters in all her"), (None, "yes 12345678")]
    df = spark.createDataFrame([(*d, "n") for d in docs], "doc_id long, text string, at string")
    want = {(1, None), (4, 1), (5, 2), (7, 4), (8, 4), (11, 6), (None, 1), (None, 3)}
    for most in (decontaminate.BLOCK_BYTES, 600):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", most)
        found = []
        for block in decontaminate.blocks(bench, most=most):
            assert sum(len(t) for _, t in block) < most + 2 * decontaminate.SEGMENT + most
            m = decontaminate._matcher(block)
            at, item, _, _ = m.find([(t or "").encode() for _, t in docs])
            found += [(docs[a][0], block[i][0]) for a, i in zip(at, item, strict=True)]
        assert set(found) == want
    assert {(x.doc_id, x.item_id) for x in decontaminate.matches(df, bench).collect()} == want
    assert sorted(x.doc_id for x in decontaminate.clean(df, bench).collect()) == [2, 3, 6, 9, 10, 12]


def test_decontamination_in_windows_and_slices_of_hits(monkeypatch):
    r = random.Random(5)
    items = [(i, " ".join("".join(r.choice("abcd") for _ in range(r.randint(2, 6))) for _ in range(60)).encode()) for i in range(4)]
    items += [(9, items[0][1])] * 3
    text = b" ".join(x for _ in range(6) for _, x in r.sample(items, 3))
    one = decontaminate.Matcher(items)
    want = {x[:3] for x in zip(*(a.tolist() for a in one.find([b"q", text, text[40:]])), strict=True)}
    monkeypatch.setattr(decontaminate, "WINDOW", 500)
    monkeypatch.setattr(decontaminate, "HITS", 100)
    got = {x[:3] for x in zip(*(a.tolist() for a in one.find([b"q", text, text[40:]])), strict=True)}
    assert {x[:2] for x in got} == {x[:2] for x in want} and len(want) > 4


def test_shingles_of_long_texts_in_parts(monkeypatch):
    r = random.Random(6)
    texts = [b" ".join(f"w{r.randrange(40)}".encode() for _ in range(n)) for n in (0, 1, 4, 5, 6, 60, 700)] + [b"x" * 300, b" a " + b"y" * 400 + b"  b c\n"]
    want = [x.tolist() for x in ngram_join.shingles(texts)]
    for size in (10, 37, 64):
        monkeypatch.setattr(ngram_join, "PART_BYTES", size)
        assert [x.tolist() for x in ngram_join.shingles(texts)] == want


def test_ngram_join_of_repeated_ids_and_chains(spark):
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[i * 4 : i * 4 + 120]) for i in range(60)]
    rows = [(1000 - 7 * i, t) for i, t in enumerate(chain)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join(df).collect())) == sorted(ngram_join.brute(rows))
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    twice = spark.createDataFrame([(1, x), (5, x), (5, y), (9, y + " z")], "doc_id long, text string")
    assert {r.id: r.component_id for r in ngram_join.join(twice).collect()} == {1: 1, 5: 1, 9: 1}


def test_topk_repeats_nulls_and_large_numbers(spark, put):
    rows = [(i, [float(i % 7), 1.0]) for i in range(60)] + [(3, [3.0, 1.0])] * 2 + [(None, [9.0, 9.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string")
    got = sorted(map(tuple, topk.op9_topk(spark, put(embeddings=df)).collect()))
    want = []
    for q in (0, 50):
        vec = rows[q][1]
        best = sorted((-int(65536 * (vec[0] * v[0] + vec[1] * v[1])), i) for i, v in rows if i is not None and i != q)[:5]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == want
    big = spark.createDataFrame([(0, [2**29 + 1, 1]), (1, [2**30 + 1, 3]), (2, [2**30 + 1, 2])], "id long, v array<bigint>")
    out = topk.search(topk.build_index(big), big.filter("id = 0"), 2)
    assert sorted((r["rank"], r.vec_id, r.score) for r in out.collect()) == [(1, 1, (2**29 + 1) * (2**30 + 1) + 3), (2, 2, (2**29 + 1) * (2**30 + 1) + 2)]
    with pytest.raises(Exception, match="fit a long"):
        topk.search(topk.build_index(spark.createDataFrame([(0, [2**61]), (1, [2**61])], "id long, v array<bigint>")), spark.createDataFrame([(0, [2**61])], "id long, v array<bigint>")).collect()


def test_topk_index_is_not_shuffled(spark):
    df = spark.createDataFrame([(i, [i]) for i in range(200)], "id long, v array<bigint>")
    plan = topk.search(shared.cut(topk.build_index(df, 16), "t"), df.filter("id % 50 = 0"), 3)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("MapInArrow", 1)[1]
    assert "Exchange" not in below


def test_lines_near_the_limit_hot_groups_and_names(spark):
    df = spark.createDataFrame([(1, "seven77\nseven78\neight888\neight889\nsixteen characte\nsixteen charXXte\nnine99999\nnine9XX99", "n")], "doc_id long, text string, stay string")
    assert linededup.dedup(df).first() == (1, "seven77\nseven78\neight888\nsixteen characte\nnine99999\nnine9XX99", "n")
    base = "a line that many documents hold with a change of one sign"
    r, seen = random.Random(3), {base}
    while len(seen) < 60:
        at = r.randrange(len(base))
        seen.add(base[:at] + r.choice("abcdefgh") + base[at + 1 :])
    rows = [(i, t) for i, t in enumerate(sorted(seen))]
    found = linededup.links(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() <= 4 * len(rows)  # not one for each pair
    split = linededup.links(spark.createDataFrame(rows, "doc_id long, text string"), pairs=10)
    assert split.distinct().count() >= 59
    chain = ["".join("ab"[(i >> b) & 1] * 4 for b in range(8)) for i in range(3)] + ["".join("z" if j < i else "y" for j in range(40)) for i in range(40)]
    given = [(i, t) for i, t in enumerate(chain)]
    got = sorted((r.doc_id, r.n_lines, r.n_new, r.n_kept, r.copies_of) for r in linededup_query(spark, given))
    assert got == linededup.brute(given)


def linededup_query(spark, rows):
    import tempfile

    path = tempfile.mkdtemp()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return linededup.op1_linededup(spark, path).collect()


def test_sieve_keeps_what_it_must(spark):
    df = spark.createDataFrame([(i, i * 3) for i in range(2000)], "bucket long, bit long")
    some = df.filter("bit % 100 = 0")
    kept = shared.sifted(df, "bit", shared.sieve(some, "bit"))
    assert kept.columns == df.columns and some.exceptAll(kept).count() == 0 and kept.count() < 60


def test_shared_folder_must_be_shared(spark):
    class Conf:
        def get(self, key, other=None):
            return {"spark.master": "spark://far:7077"}.get(key, other)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session())


def test_licenses_edges(spark, put):
    rows = [(None, "MIT License", 1), (None, None, 2), (4, "ΜΙΤ license", 3), (4, "mitKicense mit license", 4), (4, "", 5)]
    path = put(documents=spark.createDataFrame(rows, "doc_id long, text string, label int"))
    out = [(r.doc_id, r.n_words, r.n_base, r.labels) for r in licenses.op8_licenses(spark, path).collect()]
    assert sorted(out, key=repr) == sorted([(None, 2, 1, "mit"), (None, 0, 0, ""), (4, 2, 0, ""), (4, 3, 1, "mit"), (4, 0, 0, "")], key=repr)


def test_pipeline_of_empty_tables_and_odd_columns(spark, put, empty):
    import corpus_pipeline

    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert corpus_pipeline.run(spark, put(documents=empty, labels=labels, benchmark=bench)).count() == 0
    rows = [(BIG + i, f"text number {i} with words of its own {i * i} and {i * 31}", "en", "s", 0.5, "p", "k", i) for i in range(12)] + [(None, None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, predicted string, __key string, id long")
    docs_out = docs
    path = put(documents=docs, labels=spark.createDataFrame([(BIG, 0)], "doc_id long, toxic int"), benchmark=spark.createDataFrame([(None, None), (None, "nothing that any document has")], "item_id long, text string"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs_out, path)
        assert docs_out.columns == docs.columns
    assert {r.doc_id for r in docs_out.collect()} >= {BIG + 1, BIG + 2}
