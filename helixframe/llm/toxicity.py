"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input of a word: a learned vector and a log-odds statistic from hashed word tables, and the same from hashed
tables of its character trigrams (with word ends), so that unseen spellings still say something. A window of
WINDOW words goes through a recurrent layer in each direction; attention pools its states; a linear unit
gives the window's logit. All windows of the whole text are scored, each overlapping the next by half; a
logistic unit over their maximum, mean and upper mean gives the document's score.

Training: labels are of documents, so all windows of the sample are scored and each epoch learns from the
window that scores highest in each document; windows are scored anew every second epoch. The sample is bounded by two
parameters: about TRAIN_ROWS labelled rows, chosen and ordered by a hash of their id, whole texts of any length, until
TRAIN_BYTES of text are read. One executor task trains; only the network comes to the driver. Runs with the same rows
give the same model.

Defined cases: null, empty and wordless texts are one empty window; with labels of one class only every score is that
label, without labels 0; rows with equal ids are scored each on their own, labels of equal ids count as toxic if one
does; rows without an id are never learned from; tables without rows give none; ids and other columns are carried as they
are, columns named like those that score() adds are replaced by them.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .langid import fold

TRAIN_ROWS = 4000
TRAIN_BYTES = 16_000_000
WINDOW, STEP = 32, 16
WORDS, GRAMS = 1 << 14, 1 << 13
SIZE, HIDDEN = 6, 8
EPOCHS, RATE = 12, 0.01

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[[c for c in range(128) if not chr(c).isalnum()]] = 32


def tokens(texts: list[bytes]):
    """Distinct words and where they stand: (word bucket, gram buckets, gram starts, index of each word, words of each text)."""
    data, offsets = shared.joined(texts)
    data = _CLASS[data]
    found = []
    for a, b in shared.pieces(texts):  # bounds what hashing takes meanwhile
        h, s, e = shared.word_hashes(data[offsets[a] : offsets[b]])
        found.append((h, s + offsets[a], e + offsets[a]))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    of = np.searchsorted(starts, offsets)
    _, first, index = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = ends[first] - starts[first]
    begin = np.cumsum(lengths) - lengths
    at = np.repeat(starts[first] - begin, lengths) + np.arange(int(lengths.sum()))
    here = data[at].astype(np.uint32)
    before = np.where(np.isin(np.arange(len(at)), begin), 1, data[at - 1]).astype(np.uint32)
    last = np.zeros(len(at), bool)
    last[begin + lengths - 1] = True
    after = np.where(last, 2, data[np.minimum(at + 1, len(data) - 1)]).astype(np.uint32)
    grams = (((before << 16) | (here << 8) | after) * np.uint32(2654435761)) >> np.uint32(19)
    return (hashes[first] & np.uint64(WORDS - 1)).astype(np.int64), grams.astype(np.int64), begin, index, of


def windows(of: np.ndarray, index: np.ndarray, pad: int):
    """(indices of the words of each window, pad where there is none; text of each window)."""
    n = np.diff(of)
    count = np.maximum(1, -(-(n - (WINDOW - STEP)) // STEP))
    text = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = of[text][:, None] + (nth * STEP)[:, None] + np.arange(WINDOW)
    inside = at < of[text + 1][:, None]
    padded = np.append(index, pad).astype(index.dtype)
    return padded[np.where(inside, at, len(index))], text


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Net:
    """Parameters in a dict of float32 arrays; forward passes, and gradients for training."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        width = 2 * SIZE + 2
        n = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        self.p = {"word": n(WORDS, SIZE, k=0.1), "gram": n(GRAMS, SIZE, k=0.1)}
        for d in "fb":
            self.p |= {f"w{d}": n(width, 3 * HIDDEN, k=width**-0.5), f"u{d}": n(HIDDEN, 3 * HIDDEN, k=HIDDEN**-0.5), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"att": n(2 * HIDDEN, k=0.3), "out": n(2 * HIDDEN, k=0.3), "bias": np.zeros(1, np.float32)}
        self.word_odds, self.gram_odds = np.zeros(WORDS, np.float32), np.zeros(GRAMS, np.float32)
        self.head = np.zeros(4)

    def inputs(self, word, grams, begin):
        """Vectors of distinct words; the last row, for no word, is 0."""
        n = np.diff(np.append(begin, len(grams)))[:, None].astype(np.float32)
        x = np.zeros((len(word) + 1, 2 * SIZE + 2), np.float32)
        if len(word):
            x[:-1, :SIZE] = self.p["word"][word]
            x[:-1, SIZE] = self.word_odds[word]
            x[:-1, SIZE + 1 : -1] = np.add.reduceat(self.p["gram"][grams], begin) / n
            x[:-1, -1] = np.add.reduceat(self.gram_odds[grams], begin) / n[:, 0]
        return x

    def run(self, x, at, keep=False):
        """Logits of windows; with keep, what backward() needs as well."""
        rows, mask = len(at), (at != len(x) - 1).astype(np.float32)
        states, kept = np.empty((WINDOW, rows, 2 * HIDDEN), np.float32), {}
        for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            u, given = self.p[f"u{d}"], x @ self.p[f"w{d}"] + self.p[f"c{d}"]
            h, part = np.zeros((rows, HIDDEN), np.float32), slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            for t in order:
                a, m = given[at[:, t]], mask[:, t : t + 1]
                b = h @ u
                zr = _sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(a[:, 2 * HIDDEN :] + r * b[:, 2 * HIDDEN :])
                if keep:
                    kept[d, t] = (h, z, r, c, b[:, 2 * HIDDEN :])
                h = h + m * (1 - z) * (c - h)
                states[t, :, part] = h
        score = states @ self.p["att"] + (mask.T - 1) * 1e4
        e = np.exp(score - score.max(0))
        share = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", share, states)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return (logit, (states, share, pooled, mask, kept)) if keep else logit

    def backward(self, x, at, saved, error):
        """Gradients of the mean loss; error: d loss / d logit."""
        states, share, pooled, mask, kept = saved
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bias"][0], g["out"] = error.sum(), pooled.T @ error
        down = error[:, None] * self.p["out"]
        along = states @ self.p["out"] * error
        attention = share * (along - (share * along).sum(0))
        g["att"] = np.einsum("tn,tnh->h", attention, states)
        d_states = share[:, :, None] * down + attention[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        for d, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            u, part = self.p[f"u{d}"], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            d_given, dh = np.zeros((len(x), 3 * HIDDEN), np.float32), np.zeros((len(at), HIDDEN), np.float32)
            for t in order:
                h, z, r, c, b = kept[d, t]
                dh = dh + d_states[t, :, part]
                m = mask[:, t : t + 1] * dh
                dc = m * (1 - z) * (1 - c * c)
                dz = m * (h - c) * z * (1 - z)
                dr = dc * b * r * (1 - r)
                da = np.concatenate([dz, dr, dc], 1)
                db = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(d_given, at[:, t], da)
                g[f"u{d}"] += h.T @ db
                dh = dh - m * (1 - z) + db @ u.T
            g[f"w{d}"] = x.T @ d_given
            g[f"c{d}"] = d_given.sum(0)
            dx += d_given @ self.p[f"w{d}"].T
        return g, dx

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: largest window logit, mean window probability, mean of the four largest logits."""
        out = np.empty((len(texts), 3))
        for a, b in shared.pieces(texts, 1_500_000):
            word, grams, begin, index, of = tokens(texts[a:b])
            at, text = windows(of, index, len(word))
            x = self.inputs(word, grams, begin)
            logit = np.concatenate([self.run(x, at[i : i + 8192]) for i in range(0, len(at), 8192)])
            out[a:b] = pooled(logit, text, b - a)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return _sigmoid(self.features(texts) @ self.head[:3] + self.head[3]) if len(texts) else np.empty(0)


def pooled(logit: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((-logit, text))
    first = np.searchsorted(text, np.arange(n))
    rank = np.arange(len(text)) - first[text]
    ordered = logit[order]
    upper = np.bincount(text, np.where(rank < 4, ordered, 0), n) / np.bincount(text, rank < 4, n)
    return np.stack([ordered[first], np.bincount(text, _sigmoid(logit), n) / np.bincount(text, minlength=n), upper], 1)


def _odds(buckets_of, y: np.ndarray, size: int) -> np.ndarray:
    """Log-odds of the documents that hold a bucket over their standard error, towards 0 by 1.5; a document at a time."""
    count = np.zeros((2, size))
    for i, label in enumerate(y):
        count[int(label), np.unique(buckets_of(i))] += 1
    neg, pos = count + 0.5
    z = (np.log(pos / (y.sum() + 1)) - np.log(neg / ((1 - y).sum() + 1))) / np.sqrt(1 / pos + 1 / neg)
    return (np.sign(z) * np.maximum(np.abs(z) - 1.5, 0)).astype(np.float32)


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Net | float:
    """A fitted network; where labels are of one class, that label, which is then every score (0 without labels)."""
    if len(texts) == 0 or y.min() == y.max():
        return float(y.max(initial=0))
    net, y = Net(seed), y.astype(np.float64)
    word, grams, begin, index, of = tokens(texts)
    length = np.diff(np.append(begin, len(grams)))

    def grams_of(i: int) -> np.ndarray:
        used = np.unique(index[of[i] : of[i + 1]])
        n = length[used]
        return grams[np.repeat(begin[used] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    net.word_odds = _odds(lambda i: word[index[of[i] : of[i + 1]]], y, WORDS)
    net.gram_odds = _odds(grams_of, y, GRAMS)
    at, text = windows(of, index.astype(np.int32), len(word))
    heads = np.searchsorted(text, np.arange(len(texts)))
    odds = np.append(np.maximum(net.word_odds[word], 0), 0)[at].sum(1)  # which window to begin with
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    random, step = np.random.default_rng(seed), 0
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for epoch in range(epochs):
        if epoch % 2:
            x = net.inputs(word, grams, begin)
            odds = np.concatenate([net.run(x, at[i : i + 8192]) for i in range(0, len(at), 8192)])
        chosen = np.lexsort((-odds, text))[heads]
        for some in np.array_split(random.permutation(len(texts)), max(4, len(texts) // 96)):
            used, where = np.unique(at[chosen[some]], return_inverse=True)
            used = used[used < len(word)]
            where = np.minimum(where.reshape(len(some), WINDOW), len(used))
            spans = length[used]
            first = np.cumsum(spans) - spans
            mine = grams[np.repeat(begin[used] - first, spans) + np.arange(int(spans.sum()))]
            x = net.inputs(word[used], mine, first)
            logit, saved = net.run(x, where, True)
            error = ((_sigmoid(logit) - y[some]) * weight[some] / len(some)).astype(np.float32)
            g, dx = net.backward(x, where, saved, error)
            np.add.at(g["word"], word[used], dx[:-1, :SIZE])
            np.add.at(g["gram"], mine, np.repeat(dx[:-1, SIZE + 1 : -1] / np.maximum(spans, 1)[:, None], spans, 0))
            step += 1
            for k, v in net.p.items():
                one, two = moments[k]
                one += 0.1 * (g[k] - one)
                two += 0.01 * (g[k] * g[k] - two)
                v -= rate * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.99**step)) + 1e-6)
    f = np.column_stack([net.features(texts), np.ones(len(texts))])
    w = np.zeros(4)
    for _ in range(30):  # Newton steps with a small ridge
        p = _sigmoid(f @ w)
        w += np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + np.eye(4) * 1e-2, f.T @ (y - p) - 1e-2 * w)
    net.head = w
    return net


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most: int = TRAIN_BYTES) -> Net | float:
    """A network from documents (doc_id, text) and labels (doc_id, toxic) outside the held-out fold."""
    kept = labels.filter((fold("doc_id", 5) != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = int(min(1.0, rows / max(1, kept.count())) * (1 << 30))
    some = kept.filter(unit < share)  # about `rows` rows, whatever the size of the table
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter(F.col("text").isNotNull() & (unit < share))
    sample = texts.join(F.broadcast(some), "doc_id").select(unit.alias("unit"), "doc_id", F.col("toxic").cast("long").alias("toxic"), "text")
    one = sample.repartition(1).sortWithinPartitions("unit", "doc_id", "text").select("text", "toxic")

    def fit(batches):
        given, y, size = [], [], 0
        for batch in batches:
            for part in shared.slices(batch, 0, 1_000_000):
                if size < most:
                    given += shared.utf8(part.column(0))
                    y += part.column(1).to_pylist()
                    size += part.column(0).nbytes
        made = train(given, np.array(y, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["net"])

    found = one.mapInArrow(shared.tidy(fit), "net binary").collect()
    return pickle.loads(found[0]["net"]) if found else 0.0  # noqa: S301  written by this function's own task


def score(df: DataFrame, net: Net | float, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """df with score and predicted after its columns; these replace columns so named."""
    kept = df.drop(*names)
    schema = T.StructType([*kept.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    held = df.sparkSession.sparkContext.broadcast(net)  # of fixed size
    at = kept.columns.index(text)

    def run(batches):
        net = held.value
        for batch in batches:
            for part in shared.slices(batch, at):
                found = net.scores(shared.utf8(part.column(at))) if isinstance(net, Net) else np.full(part.num_rows, net)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], schema.names)

    return kept.mapInArrow(shared.tidy(run), schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    net = learn(docs, shared.read(spark, sf_dir, "labels"))
    rows = docs.withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))
    return score(rows, net).select("doc_id", "held_out", "score", "predicted")
