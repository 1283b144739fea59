"""Exact top-k search by integer inner product over an impact-ordered index, score at a time.

Index: vectors are packed in blocks. A block keeps, for each quantised impact level 2**b, the posting
segments of that level: which rows hold it in which dimension, as one bit matrix (values are shifted by the
block's minimum, so that every impact is positive). Search takes the segments of a block in descending
impact and adds each level's contribution to the accumulators of all its queries. After level b every
remaining contribution lies within (2**b - 1) times the sums of a query's negative and positive weights:
rows whose upper bound is below the k-th lower bound are proven out. When few possible members are left
they are scored again exactly from the stored values; else the next level follows, down to b = 0,
where the sums are exact. Nothing is stopped without that proof.

Queries are packed too and sent in bounded blocks, one after the other; each block meets the index where it
lies, so the index isn't shuffled, and only the k best of each index block and query are. Sums are exact: where a
block's bounds could leave the numbers that floating point counts exactly, it is scored with whole numbers of any size.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part; shorter vectors
count as ending in zeros; rows with the query's own id are its own and never its results; equal scores go to
the smaller id; fewer than k candidates give fewer rows; null ids take no part; repeated rows are candidates each; other
columns are ignored; empty tables give no rows; a component or score that doesn't fit a long raises.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
QUERY_BYTES = 16_000_000
RESCORE_SHARE = 0.02
FOUND = "query_id bigint, vec_id bigint, score bigint"
BLOCK = "ids binary, dims int, base bigint, levels int, planes binary, stored binary"


def quantised(df: DataFrame, ident: str, vector: str, scale: float = 256.0) -> DataFrame:
    """(id, v): components as floor(scale * x), only rows that take part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull() & ok).select(
        F.col(ident).cast("long").alias("id"), F.transform(vector, lambda x: _whole(F.lit(scale) * x.cast("double"))).alias("v")
    )


def _whole(x):
    return F.when(F.abs(x) < float(1 << 62), F.floor(x)).otherwise(F.raise_error(F.lit("component too large for a long")).cast("long"))


def _matrix(vectors: list) -> np.ndarray:
    dims = max((len(v) for v in vectors), default=0)
    if all(len(v) == dims for v in vectors):
        return np.array(vectors, np.int64).reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _pack(ids: np.ndarray, v: np.ndarray) -> dict:
    base = int(v.min()) if v.size else 0
    shifted = (v - base).astype(np.uint64)
    levels = int(shifted.max()).bit_length() if v.size else 0
    planes = b"".join(np.packbits((shifted >> np.uint64(b)) & np.uint64(1) != 0, axis=None).tobytes() for b in range(levels - 1, -1, -1))
    return {"ids": ids.tobytes(), "dims": v.shape[1], "base": base, "levels": levels, "planes": planes, "stored": v.tobytes()}


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block of (id, v)."""

    def blocks(parts):
        ids, rows = [], []
        for part in parts:
            for i, v in zip(part["id"], part["v"], strict=True):
                ids.append(i)
                rows.append(v)
                if len(ids) == block_rows:
                    yield pd.DataFrame([_pack(np.array(ids, np.int64), _matrix(rows))])
                    ids, rows = [], []
        if ids:
            yield pd.DataFrame([_pack(np.array(ids, np.int64), _matrix(rows))])

    return vectors.mapInPandas(shared.tidy(blocks), BLOCK)


def search_block(q_ids: np.ndarray, q: np.ndarray, block: dict, k: int, share: float = RESCORE_SHARE):
    """(query id, candidate id, score) of the block's k best for each query, by levels as told above."""
    ids = np.frombuffer(block["ids"], np.int64)
    n, dims = len(ids), int(block["dims"])
    stored = np.frombuffer(block["stored"], np.int64).reshape(n, dims)
    common = min(dims, q.shape[1])
    stored, weights = stored[:, :common], q[:, :common]
    k = min(k, n)
    most = max(1, common) * float(np.abs(weights).max(initial=1)) * 2.0 * float(max(1, np.abs(stored).max(initial=1)))
    if most >= 2**53:
        return _plain(q_ids, weights, ids, stored, k)
    kind = np.float32 if most < 2**23 else np.float64
    w = weights.astype(kind)
    up, down = np.maximum(w, 0).sum(1, keepdims=True), np.maximum(-w, 0).sum(1, keepdims=True)
    own = q_ids[:, None] == ids[None, :]
    acc = np.zeros((len(q), n), kind)
    planes = np.frombuffer(block["planes"], np.uint8)
    width = (n * dims + 7) // 8
    possible = ~own
    for step, b in enumerate(range(int(block["levels"]) - 1, -1, -1)):
        bits = np.unpackbits(planes[step * width : (step + 1) * width], count=n * dims).reshape(n, dims)[:, :common]
        acc += kind(2**b) * (w @ bits.T.astype(kind))
        if n <= k:
            continue
        left = kind(2**b - 1)
        low = np.where(own, -np.inf, acc - left * down)
        bar = np.partition(low, n - k, axis=1)[:, n - k : n - k + 1]
        possible = (acc + left * up >= bar) & ~own
        if possible.sum() <= share * possible.size:
            break
    row, col = np.nonzero(possible)
    score = np.empty(len(row), np.int64)
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        score[part] = np.einsum("ij,ij->i", weights[row[part]], stored[col[part]])
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    first = np.searchsorted(row, row, "left")
    best = np.arange(len(row)) - first < k
    return q_ids[row[best]], ids[col[best]], score[best]


def _plain(q_ids: np.ndarray, weights: np.ndarray, ids: np.ndarray, stored: np.ndarray, k: int):
    """The same for values beyond exact floating point: whole numbers of any size, one query at a time."""
    wide, out = stored.astype(object), ([], [], [])
    for q, w in zip(q_ids.tolist(), weights.astype(object), strict=True):
        best = sorted((-s, i) for s, i in zip((wide * w).sum(1).tolist() if wide.shape[1] else [0] * len(ids), ids.tolist(), strict=True) if i != q)[:k]
        for s, i in best:
            if not -(1 << 63) < s < 1 << 63:
                raise ValueError(f"the score of {q} and {i} doesn't fit a long")
            for column, v in zip(out, (q, i, -s), strict=True):
                column.append(v)
    return tuple(np.array(x, np.int64) for x in out)


def query_blocks(queries: DataFrame, query_rows: int = QUERY_ROWS, most: int = QUERY_BYTES):
    """(ids, matrix) pairs in lists of bounded size, read a partition at a time."""

    def pack(parts):
        for part in parts:
            for at in range(0, len(part), query_rows):
                some = part.iloc[at : at + query_rows]
                v = _matrix(list(some["v"]))
                yield pd.DataFrame({"ids": [some["id"].to_numpy(np.int64).tobytes()], "dims": [v.shape[1]], "q": [v.tobytes()]})

    block, size = [], 0
    for r in queries.mapInPandas(shared.tidy(pack), "ids binary, dims int, q binary").toLocalIterator():
        ids = np.frombuffer(r["ids"], np.int64)
        block.append((ids, np.frombuffer(r["q"], np.int64).reshape(len(ids), r["dims"])))
        size += len(r["q"])
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(index: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS, most: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the stated query set against every block, both in blocks."""
    spark, near = index.sparkSession, []
    for block in query_blocks(queries, query_rows, most):
        held = spark.sparkContext.broadcast(block)  # little more than `most` bytes

        def best(parts, held=held):
            for part in parts:
                for r in part.to_dict("records"):
                    for q_ids, q in held.value:
                        found = search_block(q_ids, q, r, k)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

        def run(batches, best=best):
            return best(b.to_pandas() for whole in batches for b in shared.slices(whole, 5))

        near.append(index.mapInArrow(shared.tidy(run), FOUND))
    found = near[0] if near else spark.createDataFrame([], FOUND)
    for more in near[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every row for each row whose vec_id is divisible by 50."""
    vectors = quantised(shared.read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return search(shared.cut(build_index(vectors), "index"), vectors.filter("id % 50 = 0"), 5)


ORACLE = """
with v as (
  select vec_id, embedding from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c as (select vec_id, unnest(range(len(embedding))) as d, floor(256 * unnest(embedding)::double)::bigint as x from v),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, sum(q.x * c.x)::bigint as score
  from c q join c on q.d = c.d and q.vec_id <> c.vec_id where q.vec_id % 50 = 0 group by 1, 2)
select query_id, rank, vec_id, score from (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s) where rank <= 5
"""
