"""Minimizers and anchors.

`minimizers` is the exact state machine, a Python function for Arrow batches; `window_minimizers` is the form in array
expressions only, the rightmost smallest k-mer of each window. Both stay within a read's row. Anchor pairs are made inside a read's row, so they
need no shuffle; the anchor index is one aggregation by (cluster, batch, m1, m2).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequences import kmers, poly_a
from ..session import dealt
from .packing import pack, sorting, unpack

MINIMIZERS = "array<struct<kmer:string,pos:int>>"
#: Anchor pairs that a task makes, holds and hands on at once.
PAIRS = 1 << 20
#: Reads whose minimizers are Python objects at the same time.
READS = 64
#: Bases in their order as text, by three bits each.
_ORDER = "-ACGNTU"
_CODES = np.full(256, -1, np.int64)
_CODES[[ord(ch) for ch in _ORDER]] = np.arange(len(_ORDER))
#: Bases of k-mers as numbers of two bits.
_BASES = np.full(256, 4, np.int64)
_BASES[[ord(ch) for ch in "ACGT"]] = np.arange(4)


def minimizers(seq: str, k: int, w: int, largest: bool = False) -> list[tuple[str, int]]:
    """Lexicographic minimizers (or maximizers) of a sequence, ties in a window to the last.

    One stays until its place leaves the window, or a better one comes in. The final k-mer is not looked at, and a sequence
    shorter than a window yields clamped k-mers; both decide which bases are corrected, so they are kept.
    """
    span, end = w - k, len(seq) - k
    mers = [seq[i : i + k] for i in range(max(span + 1, end))]
    pick, better = (max, str.__gt__) if largest else (min, str.__lt__)

    def last(first: int) -> int:
        window = mers[first : first + span + 1]
        return first + span - window[::-1].index(pick(window))

    at = last(0)
    found = [at]
    for i in range(span + 1, end):
        if at < i - span:
            at = last(i - span)
        elif better(mers[i], mers[at]):
            at = i
        else:
            continue
        found.append(at)
    return [(mers[i], i) for i in found]


def first_minimizers(seq: str, k: int, w: int, largest: bool = False) -> list[tuple[str, int]]:
    """The older form of minimizers: ties in a window to the first, and a new choice whenever a k-mer that equals the chosen one leaves, wherever it stood."""
    span, end = w - k, len(seq) - k
    mers = [seq[i : i + k] for i in range(max(span + 1, end))]
    pick = max if largest else min
    best = pick(mers[: span + 1])
    found = [mers.index(best)]
    for i in range(span + 1, end):
        window = mers[i - span : i + 1]
        if mers[i - span - 1] == best or pick(mers[i], best) != best:
            best = pick(window)
            found.append(i - span + window.index(best))
    return [(mers[i], i) for i in found]


def minimizer_places(seq: str, k: int, w: int) -> list[int]:
    """Places of minimizers(seq, k, w), from array operations on the whole sequence and a step for each minimizer.

    The least value of each window and its last place come from a sliding minimum. A minimizer stays until that value falls, which only
    a better k-mer at that place can cause, or until its place leaves the window, when the window's last least one follows.
    """
    span, end = w - k, len(seq) - k
    codes = _CODES[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    if k > 10 or end <= span + 1 or codes.min() < 0:  # clamped k-mers, other signs
        return [p for _, p in minimizers(seq, k, w)]
    value, place = _sliding(codes[:-1], k, w)
    falls = np.flatnonzero(value[1:] < value[:-1]) + 1
    out, window, at = [int(place[0])], 0, int(place[0])
    places, falls = place.tolist(), [*falls.tolist(), len(value)]
    fall, last = 0, len(value)
    while True:
        leaves = at + 1
        while falls[fall] <= window:
            fall += 1
        window = min(falls[fall], leaves)
        if window >= last:
            return out
        at = places[window]
        out.append(at)


def with_minimizers(reads: DataFrame, k: int, w: int, column: str = "minimizers") -> DataFrame:
    """reads with their exact minimizers; a null sequence has none."""

    @F.arrow_udf(MINIMIZERS)
    def run(seqs: pa.Array) -> pa.Array:
        sizes, places, mers = [0], [np.empty(0, np.int64)], [pa.array([], pa.string())]
        for at in range(0, len(seqs), READS):  # few reads at a time as Python objects
            for s in seqs.slice(at, READS).to_pylist():
                found = np.array([] if s is None else minimizer_places(s, k, w), np.int64)
                sizes.append(len(found))
                if not len(found):
                    continue
                places.append(found.astype(np.int32))
                # Of short reads the last k-mers are clamped.
                mers.append(_mers(s, found, k) if found.max() + k <= len(s) else pa.array([s[p : p + k] for p in found.tolist()], pa.string()))
        made = pa.StructArray.from_arrays([pa.concat_arrays(mers), pa.array(np.concatenate(places), pa.int32())], ["kmer", "pos"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), made)

    return reads.withColumn(column, run("seq"))


def _sliding(codes: np.ndarray, k: int, w: int, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(value, place) of the rightmost smallest k-mer of every full window."""
    n = len(codes) - k + 1
    value = np.zeros(n, np.int64)
    for i in range(k):
        value = (value << bits) + codes[i : i + n]
    both = (value << 32) | ((1 << 32) - 1 - np.arange(n))
    span, size = w - k + 1, 1
    while size < span:  # sliding minimum by doubling
        step = min(size, span - size)
        both = np.minimum(both[:-step], both[step:])
        size += step
    return both >> 32, (1 << 32) - 1 - (both & ((1 << 32) - 1))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[order], first)


def _window_places(codes: np.ndarray, k: int, w: int, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(value, place) of the rightmost smallest k-mer of every full window, each place once."""
    value, place = _sliding(codes, k, w, bits)
    new = np.append(True, place[1:] != place[:-1])
    return value[new], place[new]


def anchor_text(key: Column, k: int) -> Column:
    """The k-mer of a number of three bits a base."""
    return F.translate(F.lpad(F.conv(key.cast("string"), 10, 8), k, "0"), "0123456", _ORDER)


def _pair_keys(codes: np.ndarray, bits: int, half: int, tail: int, k: int, w: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of a read's anchors, from PAIRS pairs at a time: both k-mers as numbers of `bits` a base, the first one shifted by half."""
    value, place = _window_places(codes, k, w, bits)
    a, b = np.searchsorted(place, place + low, "right"), np.searchsorted(place, place + high, "right")
    ends, found, at = np.cumsum(b - a), [], 0
    while at < len(place):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        n = (b - a)[at:stop]
        first = np.repeat(np.arange(at, stop), n)
        second = np.repeat(a[at:stop] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        m1, m2 = value[first], value[second]
        found.append(np.unique(((m1 << half) | m2)[(m1 != tail) | (m2 != tail)], return_counts=True))
        at = stop
    return found[0] if len(found) == 1 else _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))


#: Anchors that a task packs at once, each read's counted once.
PACKED = 1 << 23
#: Packed anchors that are held as numbers while they are added up.
MERGED = 1 << 22
#: Reads, by their numbers, whose sums are added up together.
BLOCK = 1 << 14
#: An odd number, which spreads keys over buckets by their upper bits; it has an inverse for any power of two.
_SPREAD = 0x9E3779B97F4A7C15
#: The two bits of a base that has three; 4 for what has none.
_NARROW = np.full(8, 4, np.int64)
_NARROW[[_ORDER.index(ch) for ch in "ACGT"]] = np.arange(4)


def _spread(keys: np.ndarray, size: int, factor: int = _SPREAD) -> np.ndarray:
    """keys times an odd number, modulo 2 ** size."""
    return ((keys.astype(np.uint64) * np.uint64(factor % (1 << size))) & np.uint64((1 << size) - 1)).astype(np.int64)


def _read_keys(text: str, k: int, w: int, low: int, high: int) -> list[tuple[bool, np.ndarray, np.ndarray]]:
    """(whether other signs than A, C, G, T are in them, key, count) of a read's anchors; keys have two bits a base, else three."""
    signs = np.frombuffer(text.encode("ascii", "replace"), np.uint8)
    codes = _BASES[signs]
    if codes.max() < 4:
        return [(False, *_pair_keys(codes, 2, 2 * k, 0, k, w, low, high))]
    keys, counts = _pair_keys(np.maximum(_CODES, 0)[signs], 3, 3 * k, int("1" * k, 8), k, w, low, high)
    narrow, plain = np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    for i in range(2 * k - 1, -1, -1):
        base = _NARROW[(keys >> (3 * i)) & 7]
        plain &= base < 4
        narrow = (narrow << 2) | base
    return [(False, narrow[plain], counts[plain]), (True, keys[~plain], counts[~plain])]


def _packed_anchors(reads: DataFrame, k: int, w: int, low: int, high: int, by_read: bool) -> DataFrame:
    """cluster_id, bucket, n, data: the anchors of PACKED pairs of reads and anchors at a time, as sorted differences.

    data: keys, occurrences, and the numbers of the reads (by_read) or how many they are. A key is spread by an odd factor; its upper bits
    are its bucket, and keys with other signs than bases have buckets of their own.
    """
    if k > 10:
        raise ValueError("k must be at most 10")
    spark = reads.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    top = min((4 * tasks).bit_length() - 1, 10, 4 * k)
    kind = reads.schema["cluster_id"].dataType
    schema = T.StructType([T.StructField("cluster_id", kind), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("data", T.BinaryType())])

    def rows(held: dict) -> Iterator[tuple]:
        for (cluster, other), parts in held.items():
            size = (6 if other else 4) * k
            ids = np.repeat(np.array([x[0] for x in parts], np.int64), [len(x[1]) for x in parts])
            keys, counts = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
            parts.clear()
            keys = _spread(keys, size)
            order = sorting(keys, size)
            keys, counts, ids = keys[order], counts[order], ids[order]
            if not by_read:
                first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                ids, keys, counts = np.diff(np.append(first, len(keys))), keys[first], np.add.reduceat(counts, first)
            edges = np.searchsorted(keys, np.arange((1 << top) + 1) << (size - top))
            least = 0 if not by_read else int(ids.min())
            for bucket in np.flatnonzero(np.diff(edges)).tolist():
                at = slice(edges[bucket], edges[bucket + 1])
                few = [np.array([least + (1 << 62)])] if by_read else []  # numbers of reads can be negative, so they are stored from the least one on
                yield cluster, ~bucket if other else bucket, int(edges[bucket + 1] - edges[bucket]), pack(keys[at], counts[at], ids[at] - least, *few)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(held: dict, of: pa.Schema) -> Iterator[pa.RecordBatch]:
            made = list(rows(held))
            for at in range(0, len(made), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made[at : at + 256], strict=True), (of.field(0).type, pa.int32(), pa.int64(), pa.binary()), strict=True)], schema.names)

        held, n, of = {}, 0, None
        for batch in batches:
            of = batch.schema
            for cluster, ident, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = seq.as_py()
                if text is None or len(text) < w:
                    continue
                for other, keys, counts in _read_keys(text, k, w, low, high):
                    if not len(keys):
                        continue
                    if n and n + len(keys) > PACKED:
                        yield from given(held, of)
                        held, n = {}, 0
                    held.setdefault((cluster, other), []).append((ident or 0, keys, counts))
                    n += len(keys)
        if n:
            yield from given(held, of)

    return dealt(reads.select("cluster_id", F.col("r_id").cast("long").alias("r_id"), "seq").mapInArrow(run, schema), "cluster_id", "bucket")


def _merged(n: pa.Array, data: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """(keys, occurrences, ids) of the rows of a bucket, sorted by key: some MERGED at a time, never a key in two of them."""
    sizes, columns = n.to_numpy(), data.to_pylist()
    parts = -(-int(sizes.sum()) // MERGED)
    if parts == 1:
        met = [unpack(x) for x in columns]
        edges = None
    else:  # keys of a bucket are spread evenly between its ends
        ends = [(x[0][0], x[0][-1]) for x in map(unpack, columns)]
        edges = np.linspace(min(a for a, _ in ends), max(b for _, b in ends) + 1, parts + 1).astype(np.int64)
        edges[-1] = max(b for _, b in ends) + 1
    for part in range(parts):
        if edges is not None:
            met = []
            for x in map(unpack, columns):
                a, b = np.searchsorted(x[0], edges[part : part + 2])
                met.append([x[0][a:b], x[1][a:b], x[2][a:b], *x[3:]])
        keys, counts = np.concatenate([x[0] for x in met]), np.concatenate([x[1] for x in met])
        ids = np.concatenate([x[2] + (x[3][0] - (1 << 62) if len(x) > 3 else 0) for x in met])
        if len(keys):
            order = sorting(keys, int(keys.max()).bit_length())
            yield keys[order], counts[order], ids[order]


def _letters(keys: np.ndarray, other: bool, k: int) -> tuple[pa.Array, pa.Array]:
    """Both k-mers of keys (as they were before they were spread)."""
    bits, signs = (3, _ORDER) if other else (2, "ACGT")
    table = np.frombuffer(signs.encode().ljust(8, b"-"), np.uint8)
    every = np.empty((len(keys), 2 * k), np.uint8)
    for i in range(2 * k):
        every[:, i] = table[(keys >> (bits * (2 * k - 1 - i))) & ((1 << bits) - 1)]
    text = lambda part: pa.Array.from_buffers(pa.string(), len(keys), [None, pa.py_buffer(np.arange(0, k * len(keys) + 1, k, np.int32)), pa.py_buffer(np.ascontiguousarray(part))])
    return text(every[:, :k]), text(every[:, k:])


def anchor_counts(reads: DataFrame, k: int, w: int, low: int, high: int, least: int = 1) -> DataFrame:
    """cluster_id, m1, m2, occurrences, reads of the anchor pairs of window minimizers that occur `least` times: a row for each anchor of a cluster.

    Anchors are counted over PACKED of them before they leave a task, and travel as differences of their order: some two bytes each.
    """
    packed = _packed_anchors(reads, k, w, low, high, by_read=False)
    kind = reads.schema["cluster_id"]
    schema = T.StructType([kind, T.StructField("m1", T.StringType()), T.StructField("m2", T.StringType()), T.StructField("occurrences", T.LongType()), T.StructField("reads", T.LongType())])

    def run(rows: pa.Table) -> pa.Table:
        cluster, other = rows["cluster_id"][:1].combine_chunks(), rows["bucket"][0].as_py() < 0
        size = (6 if other else 4) * k
        back, out = pow(_SPREAD, -1, 1 << size), []
        for keys, counts, ids in _merged(rows["n"], rows["data"]):
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            counts, ids, keys = np.add.reduceat(counts, first), np.add.reduceat(ids, first), keys[first]
            kept = counts >= least
            m1, m2 = _letters(_spread(keys[kept], size, back), other, k)
            row = pa.array(np.zeros(len(m1), np.int64))
            out.append(pa.RecordBatch.from_arrays([cluster.take(row), m1, m2, pa.array(counts[kept]), pa.array(ids[kept])], schema.names))
        return pa.Table.from_batches(out)

    return packed.groupBy("cluster_id", "bucket").applyInArrow(run, schema)


def _summed_reads(ids: np.ndarray, anchors: np.ndarray, most: np.ndarray, supporting: np.ndarray) -> list[np.ndarray]:
    """Each read once: the sum of its anchors, the most reads that share one, the sum of those that do."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    return [ids[first], np.add.reduceat(anchors[order], first), np.maximum.reduceat(most[order], first), np.add.reduceat(supporting[order], first)]


def anchor_support(reads: DataFrame, sizes: DataFrame, k: int, w: int, low: int, high: int, least: int = 3) -> DataFrame:
    """cluster_id, r_id, anchors, most, supporting: the anchors of a read that occur `least` times in its cluster and that kept_anchors keeps,
    the most reads that share one of them, and the sum of those that do. Reads without such anchors, and those of no cluster, are left out.

    sizes: cluster_id, n_reads. A read's anchors are shuffled once, packed; what a bucket adds to the reads of a block travels as one value.
    r_id is a number, the only one of its kind in a cluster.
    """
    kind = reads.schema["cluster_id"]
    packed = _packed_anchors(reads.filter(F.col("cluster_id").isNotNull()), k, w, low, high, by_read=True).join(F.broadcast(sizes.select("cluster_id", "n_reads")), "cluster_id")
    part = T.StructType([kind, T.StructField("block", T.LongType()), T.StructField("data", T.BinaryType())])
    schema = T.StructType([kind, *[T.StructField(c, T.LongType()) for c in ("r_id", "anchors", "most", "supporting")]])

    def share(rows: pa.Table) -> pa.Table:
        cluster, other, n_reads = rows["cluster_id"][:1].combine_chunks(), rows["bucket"][0].as_py() < 0, rows["n_reads"][0].as_py()
        size = (6 if other else 4) * k
        tail, back = int("1" * k, 8) if other else 0, pow(_SPREAD, -1, 1 << size)
        held: list[np.ndarray] | None = None
        for keys, counts, ids in _merged(rows["n"], rows["data"]):
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            occurrences, shared = np.add.reduceat(counts, first), np.diff(np.append(first, len(keys)))
            poly = (_spread(keys[first], size, back) & ((1 << (size // 2)) - 1)) == tail
            kept = (occurrences >= max(least, 2)) & ~((occurrences > n_reads) & (poly | (occurrences > 10 * n_reads)))
            mine, most = np.repeat(kept, shared), np.repeat(shared[kept], shared[kept])
            if len(most):
                more = _summed_reads(ids[mine], counts[mine], most, counts[mine] * most)
                held = more if held is None else _summed_reads(*(np.concatenate(x) for x in zip(held, more, strict=True)))
        if held is None:
            return pa.Table.from_batches([], pa.schema([(c.name, t) for c, t in zip(part, (cluster.type, pa.int64(), pa.binary()), strict=True)]))
        blocks = held[0] // BLOCK
        edges = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])).tolist()
        data = [pack(held[0][a:b] - blocks[a] * BLOCK, *(x[a:b] for x in held[1:])) for a, b in zip(edges, [*edges[1:], len(blocks)], strict=True)]
        return pa.Table.from_arrays([cluster.take(pa.array([0] * len(data))), pa.array(blocks[edges]), pa.array(data, pa.binary())], names=part.names)

    def whole(rows: pa.Table) -> pa.Table:
        sums = np.zeros((3, BLOCK), np.int64)
        for data in rows["data"]:
            ids, anchors, most, supporting = unpack(data.as_py())
            sums[0][ids] += anchors
            sums[1][ids] = np.maximum(sums[1][ids], most)
            sums[2][ids] += supporting
        found = np.flatnonzero(sums[0])
        cluster = rows["cluster_id"][:1].combine_chunks().take(pa.array([0] * len(found)))
        return pa.Table.from_arrays([cluster, pa.array(found + rows["block"][0].as_py() * BLOCK), *(pa.array(x[found]) for x in sums)], names=schema.names)

    parts = packed.groupBy("cluster_id", "bucket").applyInArrow(share, part)
    return dealt(parts, "cluster_id", "block").groupBy("cluster_id", "block").applyInArrow(whole, schema)


def anchor_keys(reads: DataFrame, k: int, w: int, low: int, high: int, by_read: bool = True) -> DataFrame:
    """cluster_id, r_id, key, occurrences, reads (1) of every read's anchors; without by_read, added up for every PAIRS of them, r_id null.

    A task holds PAIRS anchors at a time, or those of one longer read: a read of 3000 bases has some 4000.

    A key is both k-mers as numbers of three bits a base, 30 bits each, so k is at most 10. Other signs than bases count as
    the lowest one.
    """
    if k > 10:
        raise ValueError("k must be at most 10")
    table = np.maximum(_CODES, 0)
    tail = int("1" * k, 8)
    kind = reads.schema["cluster_id"].dataType

    def of_text(text: str) -> tuple[np.ndarray, np.ndarray]:
        return _pair_keys(table[np.frombuffer(text.encode("ascii", "replace"), np.uint8)], 3, 30, tail, k, w, low, high)

    def packed(batch, clusters, number, which, keys, counts):
        """One batch of what the reads `which` have: a row for each read's key, or added up by cluster."""
        keys, counts, n = np.concatenate(keys), np.concatenate(counts), [len(x) for x in keys]
        if by_read:
            row = pa.array(np.repeat(which, n))
            return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(keys), pa.array(counts), pa.array(np.ones(len(row), np.int64))], names)
        of = np.repeat(number[which], n)
        order = np.lexsort((keys, of))
        of, keys, counts = of[order], keys[order], counts[order]
        first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])))
        group = clusters.dictionary.take(pa.array(of[first], mask=of[first] < 0))
        return pa.RecordBatch.from_arrays([group, pa.nulls(len(first), pa.int32()), pa.array(keys[first]), pa.array(np.add.reduceat(counts, first)), pa.array(np.diff(np.append(first, len(keys))))], names)

    def run(batches):
        for batch in batches:
            clusters = batch.column(0).dictionary_encode()
            number = np.array([-1 if x is None else x for x in clusters.indices.to_pylist()], np.int64)
            which, keys, counts, held = [], [], [], 0
            for i, seq in enumerate(batch.column(2)):
                text = seq.as_py()
                if text is None or len(text) < w:
                    continue
                key, count = of_text(text)
                if not len(key):
                    continue
                if held and held + len(key) > PAIRS:
                    yield packed(batch, clusters, number, which, keys, counts)
                    which, keys, counts, held = [], [], [], 0
                which.append(i)
                keys.append(key)
                counts.append(count)
                held += len(key)
            if held:
                yield packed(batch, clusters, number, which, keys, counts)

    schema = T.StructType([T.StructField("cluster_id", kind), T.StructField("r_id", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("key", "occurrences", "reads")]])
    names = schema.names
    return reads.select("cluster_id", F.col("r_id").cast("int").alias("r_id"), "seq").mapInArrow(run, schema)


def window_minimizer_array(seq: Column, k: int, w: int) -> Column:
    """Rightmost smallest k-mer of every full window, each position once: array of (kmer, neg), neg = -pos. No shuffle."""
    n = w - k + 1
    mers = F.transform(kmers(seq, k), lambda m: F.struct(m["kmer"].alias("kmer"), (-m["pos"]).alias("neg")))

    def best(ms: Column) -> Column:
        wins = F.transform(F.sequence(F.lit(1), F.size(ms) - (n - 1)), lambda i: F.array_min(F.slice(ms, i, F.lit(n))))
        # Positions never fall from window to window, so repeats stand together.
        return F.get(F.transform(F.array(wins), lambda ws: F.filter(ws, lambda x, i: (i == 0) | (x["neg"] != F.get(ws, i - 1)["neg"]))), F.lit(0))

    return F.when(F.length(seq) >= w, F.get(F.transform(F.array(mers), best), F.lit(0)))


def window_minimizers(reads: DataFrame, k: int, w: int, keys: tuple[str, ...] = ("cluster_id", "r_id")) -> DataFrame:
    """keys, pos, kmer of window_minimizer_array, whose elements a kernel finds in Arrow batches: PAIRS of them at once, or one read's."""
    source = reads.select(*keys, F.col("seq").cast("string").alias("seq"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.StringType())])
    names = schema.names

    def packed(batch, which, places, mers):
        row = pa.array(np.repeat(which, [len(p) for p in places]))
        made = [pa.array(np.concatenate(places), pa.int32()), pa.concat_arrays(mers)]
        return pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(len(keys))], *made], names)

    def run(batches):
        for batch in batches:
            which, places, mers, held = [], [], [], 0
            for i, seq in enumerate(batch.column(len(keys))):
                text = seq.as_py()
                if text is None or len(text) < w:
                    continue
                place = window_places(text, k, w)
                if held and held + len(place) > PAIRS:
                    yield packed(batch, which, places, mers)
                    which, places, mers, held = [], [], [], 0
                which.append(i)
                places.append(place)
                mers.append(_mers(text, place, k))
                held += len(place)
            if held:
                yield packed(batch, which, places, mers)

    return source.mapInArrow(run, schema)


def window_places(text: str, k: int, w: int) -> np.ndarray:
    """Places of the rightmost smallest k-mer of every full window, each place once."""
    if len(text) < w:
        return np.empty(0, np.int64)
    codes = _CODES[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    if k <= 10 and codes.min() >= 0:
        return _window_places(codes, k, w)[1]
    mers = [text[i : i + k] for i in range(len(text) - k + 1)]
    found = [min(range(i, i + w - k + 1), key=lambda p: (mers[p], -p)) for i in range(len(text) - w + 1)]
    return np.array([p for i, p in enumerate(found) if not i or p != found[i - 1]])


def _mers(text: str, place: np.ndarray, k: int) -> pa.Array:
    """The k-mers of a text at these places, without an object for each where a sign is a byte."""
    if not text.isascii():
        return pa.array([text[p : p + k] for p in place.tolist()], pa.string())
    letters = np.frombuffer(text.encode("ascii"), np.uint8)[np.asarray(place, np.int64)[:, None] + np.arange(k)]
    return pa.Array.from_buffers(pa.string(), len(place), [None, pa.py_buffer(np.arange(0, k * len(place) + 1, k, np.int32)), pa.py_buffer(np.ascontiguousarray(letters))])


def pair_spans(reads: DataFrame, k: int, w: int, low: int, high: int) -> DataFrame:
    """cluster_id, r_id, pairs, nearest, farthest: how many anchor pairs of window minimizers a read has, and their least and largest span.

    Pairs are counted by the range of partners of each place; only those of two poly-A k-mers, which don't count, are made. Reads without pairs are left out.
    """
    source = reads.select("cluster_id", "r_id", "seq")
    schema = T.StructType([*source.schema.fields[:2], *[T.StructField(c, T.LongType()) for c in ("pairs", "nearest", "farthest")]])
    names, tail = schema.names, "A" * k

    def of_text(text: str) -> tuple[int, int, int] | None:
        place = window_places(text, k, w)
        poly = np.array([text.startswith(tail, p) for p in place.tolist()], bool)
        n, least, most = 0, high + 1, 0
        for these, partners in ((place[~poly], place), (place[poly], place[~poly])):
            a, b = np.searchsorted(partners, these + low, "right"), np.searchsorted(partners, these + high, "right")
            some = b > a
            if some.any():
                n += int((b - a).sum())
                least = min(least, int((partners[a[some]] - these[some]).min()))
                most = max(most, int((partners[b[some] - 1] - these[some]).max()))
        return (n, least, most) if n else None

    def run(batches):
        for batch in batches:
            found = [(i, *x) for i, t in enumerate(batch.column(2)) if t.as_py() is not None and (x := of_text(t.as_py()))]
            if found:
                row, *made = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), *[pa.array(c, pa.int64()) for c in made]], names)

    return source.mapInArrow(run, schema)


def kmer_codes(text: bytes, k: int) -> np.ndarray:
    """The k-mers of a text as numbers, two bits a base; those that hold another sign than A, C, G, T are left out."""
    n = len(text) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    bases = _BASES[np.frombuffer(text, np.uint8)]
    other = np.append(0, np.cumsum(bases > 3))
    codes = np.zeros(n, np.int64)
    for i in range(k):
        codes <<= 2
        codes |= bases[i : i + n]
    return codes[other[k:] == other[:-k]]


def kmer_counts(reads: DataFrame, target: DataFrame, k: int) -> DataFrame:
    """(cluster_id, kmer, n): how often reads (cluster_id, seq) hold the k-mers of target (kmer), both of A, C, G, T; k is 31 at most.

    k-mers are counted over some PAIRS of them at a time before they leave a task, as numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[object, list[str]] = {}
            size = 0
            clusters, seqs = batch.column(0).to_pylist(), batch.column(1)
            for i, cluster in enumerate(clusters):
                seq = seqs[i].as_py()
                if seq:
                    held.setdefault(cluster, []).append(seq)
                    size += len(seq)
                if held and (size >= PAIRS or i == len(clusters) - 1):
                    for key, texts in held.items():
                        codes, n = np.unique(kmer_codes("-".join(texts).encode("latin-1", "replace"), k), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array([key] * len(codes), batch.schema.field(0).type), pa.array(codes), pa.array(n)], ["cluster_id", "code", "n"])
                    held, size = {}, 0

    counts = reads.select("cluster_id", "seq").mapInArrow(run, T.StructType([reads.schema["cluster_id"], T.StructField("code", T.LongType()), T.StructField("n", T.LongType())]))
    wanted = target.select(F.conv(F.translate("kmer", "ACGT", "0123"), 4, 10).cast("long").alias("code")).distinct()
    found = counts.join(wanted, "code", "left_semi").groupBy("cluster_id", "code").agg(F.sum("n").alias("n"))
    return found.select("cluster_id", F.translate(F.lpad(F.conv(F.col("code").cast("string"), 10, 4), k, "0"), "0123", "ACGT").alias("kmer"), "n")


def anchor_pairs(mins: Column, low: int, high: int, k: int) -> Column:
    """Ordered pairs with low < p2 - p1 <= high, the farthest partner first, no poly-A pairs: array of (m1, p1, m2, p2)."""
    # Positions grow, so partners are among the next `high` minimizers.
    of_first = lambda a, i: F.transform(
        F.reverse(F.filter(F.slice(mins, i + 2, F.lit(high)), lambda b: (b["pos"] - a["pos"] > low) & (b["pos"] - a["pos"] <= high))),
        lambda b: F.struct(a["kmer"].alias("m1"), a["pos"].alias("p1"), b["kmer"].alias("m2"), b["pos"].alias("p2")),
    )
    return F.filter(F.flatten(F.transform(mins, of_first)), lambda x: ~(poly_a(x["m1"], k) & (x["m1"] == x["m2"])))


def exploded_pairs(reads: DataFrame, low: int, high: int, k: int, keys: tuple[str, ...] = ("cluster_id", "r_id")) -> DataFrame:
    """keys, ord (order of generation), m1, p1, m2, p2."""
    return reads.select(*keys, F.posexplode_outer(anchor_pairs(F.col("minimizers"), low, high, k)).alias("ord", "a")).filter("a is not null").select(*keys, "ord", "a.*")


def anchor_index(pairs: DataFrame, group: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """group, m1, m2, occurrences, reads and where they are, in order of generation."""
    return pairs.groupBy(*group, "m1", "m2").agg(
        F.count("*").alias("occurrences"), F.count_distinct("r_id").alias("reads"), F.array_sort(F.collect_list(F.struct("r_id", "ord", "p1", "p2"))).alias("places")
    )


def kept_anchors(counts: DataFrame, sizes: DataFrame, k: int, group: tuple[str, ...] = ("cluster_id",)) -> DataFrame:
    """Anchors seen more than once, without those of more occurrences than reads that end in poly-A or exceed ten times the reads.

    counts: group, m1, m2, occurrences; sizes: group, n_reads.
    """
    more = counts.filter("occurrences > 1").join(sizes, list(group))
    drop = (F.col("occurrences") > F.col("n_reads")) & (poly_a(F.col("m2"), k) | (F.col("occurrences") > 10 * F.col("n_reads")))
    return more.filter(~drop)


def support(pairs: DataFrame, kept: DataFrame, group: tuple[str, ...] = ("cluster_id",), least: int = 3) -> DataFrame:
    """For each pair of a read the number of other reads that share its anchor: the equi-join on (group, m1, m2)."""
    use = kept.filter(F.col("occurrences") >= least).select(*group, "m1", "m2", "occurrences", "reads")
    return pairs.join(use, [*group, "m1", "m2"]).select(*group, "r_id", "m1", "p1", "m2", "p2", "occurrences", F.col("reads").alias("supporting"))


def with_batches(reads: DataFrame, size: int) -> DataFrame:
    return reads.withColumn("batch_id", F.floor((F.col("r_id") - 1) / size).cast("int"))


def iterate_pairs(mins: list[tuple[str, int]], low: int, high: int) -> Iterator[tuple[str, int, list[tuple[str, int]]]]:
    """For each minimizer but the last: it and its partners, the farthest first."""
    for i, (m, p) in enumerate(mins[:-1]):
        near = [(m2, p2) for m2, p2 in mins[i + 1 :] if low < p2 - p <= high]
        yield m, p, near[::-1]
