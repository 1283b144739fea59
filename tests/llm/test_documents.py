"""Toxicity, mixing, archive, language, token files, licenses, pipeline."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import langid, license_texts, licenses, mixing, registry, shared, tokenids, toxicity, warc


def sql(query, path, *tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return c.sql(query)


def same(df, query, path, *tables):
    rel = sql(query, path, *tables)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in rel.columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=repr)


def test_mixing(spark, put, docs, empty):
    path = put(documents=docs)
    same(mixing.op3_mixing(spark, path), mixing.ORACLE, path, "documents")
    out = mixing.op3_mixing(spark, path).toPandas()
    assert (out["taken"] <= 3 * out["size"]).all()
    by = out.groupby(out["source"].fillna("~"))
    assert by["target"].first().sum() == pytest.approx(out["size"].sum())
    assert (by["target"].first() <= 3 * by["source_size"].first() + 1e-9).all()
    assert mixing.op3_mixing(spark, path).exceptAll(mixing.op3_mixing(spark, path)).count() == 0
    assert mixing.emit(empty).count() == 0
    emitted = mixing.emit(docs.withColumn("copies", F.lit("clash")).withColumn("source_size", F.lit(1)))
    assert emitted.count() == out["copies"].sum() and emitted.columns[-2:] == ["copies", "source_size"]


def test_mixing_comes_near_its_targets(spark):
    r = random.Random(1)
    rows = [(i, "w " * r.randint(1, 300), f"s{i % 3}") for i in range(3000)]
    df = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", mixing.n_words()), "n", slice_rows=100)
    taken = df.groupBy("source").agg(F.sum(F.col("copies") * F.col("n")).alias("t"), F.first("target").alias("g")).collect()
    assert all(abs(x.t / x.g - 1) < 0.02 for x in taken)


def test_warc(spark, put):
    rows = [(1, "http://a/1", "<p>x</p>"), (5, "http://a/5", "<p>x</p>"), (3, None, "<p>x</p>"), (7, "u\r\nEvil: 1", None), (8, "u8", ""), (9, "u9", "é"), (10, "u10", "é" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = put(pages=df)
    same(warc.op4_warc(spark, path), warc.ORACLE, path, "pages")
    found = {r.page_id: r for r in warc.op4_warc(spark, path).collect()}
    assert found[9].payload_digest == base64.b32encode(hashlib.sha1("é".encode()).digest()).decode()
    assert found[1].refers_to == 5 and found[5].record_type == "response" and found[7].refers_to == 8
    where = shared.shared_path(spark, "t")
    warc.write(df, where)
    records = {r.page_id: r for r in warc.records(spark, where).collect()}
    for page, url, html in rows:
        rec = records[page]
        head, _, body = bytes(rec.record).partition(b"\r\n\r\n")
        want = (html or "").encode()
        assert bytes(rec.payload) == want and head.startswith(b"WARC/1.1\r\n") and b"\r\nEvil" not in head
        assert body == (want if rec.record_type == "response" else b"") + b"\r\n\r\n"
        assert int(head.decode().split("Content-Length: ")[1].split("\r\n")[0]) == len(body) - 4
    assert spark.read.parquet(f"{where}/payloads").count() == 4
    small = shared.shared_path(spark, "t")
    warc.write(df, small, min_bytes=100)
    assert {r.record_type for r in warc.headers(spark, small).collect()} == {"response"}
    assert warc.op4_warc(spark, put(pages=df.limit(0))).count() == 0


def test_warc_refuses_altered_payloads(spark):
    where = shared.shared_path(spark, "t")
    warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), where)
    spark.createDataFrame([(hashlib.sha256(b"y").hexdigest(), bytearray(b"z"))], "address string, payload binary").write.mode("append").parquet(f"{where}/payloads")
    with pytest.raises(Exception, match="match its address"):
        warc.verified(spark, where).collect()


def test_language(spark, put, empty):
    r = random.Random(2)
    stems = {"en": "th wh ing tion ould ea".split(), "fr": "eau oi é que ment aux".split()}
    rows = [(i, " ".join("".join(r.choice(stems[lang]) for _ in range(3)) for _ in range(40)), lang) for i in range(120) for lang in [r.choice(["en", "fr"])]]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "12 !! 34", "en"), (903, rows[0][1] * 300, rows[0][2]), (None, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.op5_langid(spark, put(documents=df)).collect()}
    assert len(out) == len(rows)
    held = [(out[i].lang_pred, lang) for i, _, lang in rows[:120] if out[i].held_out]
    assert sum(a == b for a, b in held) >= 0.9 * len(held) > 0
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[None].held_out is False
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert all(0 <= x.score <= 1 for x in out.values())
    none = langid.op5_langid(spark, put(documents=df.withColumn("lang", F.lit(None).cast("string"))))
    assert {x.lang_pred for x in none.collect()} == {"und"}
    assert langid.op5_langid(spark, put(documents=empty.select("doc_id", "text", "lang"))).count() == 0


def test_token_files(spark, put, docs, rows, empty):
    path = tokenids.tokenizer_path()
    got = sorted(map(tuple, tokenids.op6_tokens(spark, put(documents=docs)).collect()))
    assert got == tokenids.brute([(i, t) for i, t, *_ in rows], path)
    assert tokenids.op6_tokens(spark, put(documents=empty)).count() == 0
    twice = spark.createDataFrame([(2, "b"), (1, "a"), (2, "b"), (None, "n"), (-5, None)], "doc_id long, text string")
    out = tokenids.encode_and_digest(twice).orderBy("start").collect()
    assert [x.doc_id for x in out] == [None, -5, 1, 2, 2] and [x.start for x in out] == [0, 2, 3, 5, 7]


def test_token_pieces_equal_the_library():
    e, r = tokenids.Encoder(tokenids.tokenizer_path()), random.Random(1)
    signs = [chr(i) for i in range(0x250)] + list("  \n\t'stremdl日²ⅷ 　é<| ")
    for _ in range(1500):
        t = "".join(r.choice(signs) for _ in range(r.randint(0, 30)))
        assert e.text(t) == e.whole(t)


def test_huffman():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 3000):
        ids = np.minimum(r.geometric(0.02, 5000) - 1, n - 1)
        lengths = tokenids.code_lengths(np.bincount(ids, minlength=n))
        used = lengths[lengths > 0].astype(float)
        assert lengths.max() <= 16 and (2.0**-used).sum() <= 1
        code = tokenids.Code(lengths)
        bits, offsets = code.pack(ids)
        assert (code.unpack(bits, offsets, len(ids)) == ids).all()
    skew = np.array([2**min(i, 60) for i in range(40)])
    assert tokenids.code_lengths(skew, 8).max() == 8
    fib = [1, 1, 2, 3, 5, 8, 13]
    assert sorted(tokenids.code_lengths(np.array(fib), 16)) == [1, 2, 3, 4, 5, 6, 6]


def test_licenses(spark, put, docs, empty):
    mit = next(text for text, label in license_texts.TEMPLATES if label == "mit-text")
    more = docs.sparkSession.createDataFrame(
        [(200, "MIT License mit  license. (MIT)-License", "", ""), (201, "Licensed under the Apache License, Version 2.0.", "", ""), (202, "This work is licensed under the GNU General Public License, version 3. Permission is hereby very much granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "", ""),
         (203, "mit\x00license Kelvin", "", ""), (204, "general public licence", "", ""), (205, "x Released under the MIT License" + " mit license" * 10, "", ""), (206, "É " + mit.replace("sublicense", "resell freely"), "", ""), (207, " ".join(mit.split()[::-1]), "", ""), (208, mit + " " + mit, "", ""), (None, mit, "", ""), (208, "mit license", "", "")], docs.schema)
    path = put(documents=docs.unionByName(more))
    same(licenses.op8_licenses(spark, path), licenses.ORACLE, path, "documents")
    out = {r.doc_id: r for r in licenses.op8_licenses(spark, path).collect()}
    assert (out[200].n_base, out[200].first_word, out[200].last_word, out[200].base_labels) == (3, 0, 4, "mit")
    assert out[201].labels == "apache,apache-2.0" and out[202].base_labels == "gpl" and out[202].labels == "gpl,gpl-3.0,mit-grant"
    assert out[205].labels == "mit,mit-notice" and out[206].labels == "mit-grant,mit-text" and out[207].labels == ""
    assert out[203].n_base == 1 and out[204].labels == "" and out[60].n_words == 0
    assert licenses.op8_licenses(spark, put(documents=empty)).count() == 0


def toxic_rows(n=160):
    r = random.Random(5)
    plain = "the of stone river moon cloud tree bird walks under over green slow".split()
    out = []
    for i in range(n):
        bad = i % 3 == 0
        words = [r.choice(plain) for _ in range(r.randint(5, 150))]
        for _ in range(2 * bad + len(words) // 40 * bad):
            words[r.randrange(len(words))] = r.choice(["idiot", "moron!", "scum"])
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity(spark, put, empty):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (501, ""), (502, "!!!"), (None, "idiot"), (503, rows[0][1] * 200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (3, 1), (999, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.op2_toxicity(spark, put(documents=docs, labels=labels)).collect()}
    assert len(out) == len(rows) + 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    held = [(out[i].predicted, y) for i, _, y in rows if out[i].held_out]
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert sum(a == b for a, b in held) >= 0.9 * len(held) > 0
    for only in (0, 1):
        one = toxicity.op2_toxicity(spark, put(documents=docs, labels=labels.filter(f"toxic = {only}")))
        assert {r.score for r in one.collect()} == {float(only)}
    assert toxicity.op2_toxicity(spark, put(documents=empty.select("doc_id", "text"), labels=labels.limit(0))).count() == 0


def test_network_gradients():
    """Backpropagation against differences of the loss."""
    net = toxicity.Net(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    word, grams, begin, index, of = toxicity.tokens([b"a moon of stone", b"the river walks on"])
    at, _ = toxicity.windows(of, index, len(word))
    y = np.array([1.0, 0.0])

    def loss():
        z = net.run(net.inputs(word, grams, begin).astype(np.float64), at)
        return float(np.mean(np.log1p(np.exp(-(2 * y - 1) * z))))

    x = net.inputs(word, grams, begin)
    logit, saved = net.run(x, at, True)
    g, _ = net.backward(x, at, saved, ((toxicity._sigmoid(logit) - y) / 2).astype(np.float32))
    r = np.random.default_rng(0)
    for k in ("uf", "ub", "wf", "wb", "cf", "cb", "att", "out", "bias"):
        flat = net.p[k].reshape(-1)
        for i in r.integers(0, len(flat), 4):
            keep = flat[i]
            flat[i] = keep + 1e-3
            up = loss()
            flat[i] = keep - 1e-3
            down = loss()
            flat[i] = keep
            assert (up - down) / 2e-3 == pytest.approx(float(g[k].reshape(-1)[i]), abs=2e-3)


def test_windows_overlap_and_cover():
    of, index = np.array([0, 0, 5, 75]), np.arange(75)
    at, text = toxicity.windows(of, index, 75)
    assert list(np.bincount(text)) == [1, 1, 4] and (at[0] == 75).all()
    assert set(at[text == 2].reshape(-1)) - {75} == set(range(5, 75))


def test_registry_names():
    assert sorted(int(x[2:].split("_")[0]) for x in registry.QUERIES) == list(range(1, 11))


def test_pipeline_equals_its_stages_by_brute_force(spark, put, docs, rows):
    import corpus_pipeline as pipeline
    from helixframe.llm import decontaminate, ngram_join

    items = [(1, rows[5][1]), (2, "no document holds anything of this item at all, whatever it is")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60)], "doc_id long, toxic int")
    full = docs.withColumn("n_chars", F.length("text").cast("long"))
    path = put(documents=full, benchmark=spark.createDataFrame(items, "item_id long, text string"), labels=labels)
    got = sorted(map(tuple, pipeline.run(spark, path).collect()))
    net = toxicity.learn(full, labels)
    state = [(i, t) for i, t, *_ in rows]
    scores = net.scores([(t or "").encode() for _, t in state])
    state = [x for x, s in zip(state, scores, strict=True) if s < 0.5]
    keep = {i for i, _, c in ngram_join.brute(state) if i == c}
    state = [x for x in state if x[0] in keep]
    bad = {d for d, _ in decontaminate.brute([x for x in state if len(x[1] or "") < 3000], items)}
    state = [x for x in state if x[0] not in bad]
    sources = {r[0]: r[3] for r in rows}
    left = spark.createDataFrame([(i, t, sources[i]) for i, t in state], "doc_id long, text string, source string")
    taken = {r.doc_id: r.copies for r in mixing.op3_mixing(spark, put(documents=left)).collect()}
    start, want = 0, []
    for i, _, n, crc in tokenids.brute(state, tokenids.tokenizer_path()):
        for _ in range(taken[i]):
            want.append((i, start, n, crc))
            start += n
    assert got == sorted(want)
