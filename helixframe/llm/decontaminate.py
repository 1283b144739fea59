"""Benchmark decontamination with the q-gram lemma.

Texts are folded (case over all of Unicode, ASCII that is no letter or digit to a space, spaces in a row to one). Every
benchmark item is cut into overlapping segments of SEGMENT bytes that begin every STRIDE bytes; a document is
contaminated by an item if some region of it is within a segment's edit budget, RATE of its length. STRIDE is twice the
budget, so every verbatim passage of SEGMENT folded bytes is certain to be found wherever it starts: a segment begins within
the budget of it, and what it has beyond the passage counts as edits. Of SEGMENT + STRIDE - 1 bytes, a passage holds a
whole segment, and may have as many edits as that allows. An item of fewer than SEGMENT bytes is one segment; below
SHORT bytes it must stand in the text as whole words, without edits.

With at most e edits, a region shares at least m - Q + 1 - Q * e of a segment's q-grams, and they lie on
diagonals (document position minus segment position) at most e apart. So shared q-grams are counted in diagonal
bands, each overlapping the next by half, of width 2 * (e + 1); bands that reach the bound are kept and verified by
banded alignment. Counts can only be too high, so nothing within the budget is lost.

The benchmark is the stated query set: it is taken in blocks of at most BLOCK_BYTES of folded text (longer items are cut
where segments begin), and each block meets all documents in one scan without a shuffle. Whole texts are searched, in
windows of WINDOW bytes that overlap by more than a region's length; q-grams that many segments hold are expanded
HITS at a time, so memory is bounded for texts and passages of any length and frequency.

Defined cases: null and empty texts match nothing; null items and items without a letter, digit or non-ASCII sign are
no evidence; an item with a null id is reported with it; equal items are each reported; rows with equal or null ids are
pooled by id; empty tables give no rows; matches() ignores other columns, clean() keeps all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

Q = 10
SEGMENT, STRIDE = 100, 16
RATE = 0.08
SHORT = 32
BLOCK_BYTES = 500_000
BITS = 22
WINDOW, MARGIN = 2_000_000, 3 * SEGMENT
HITS = 2_000_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not chr(c).isalnum()]] = 32


def fold_case(text: bytes) -> bytes:
    """UTF-8 without case; ASCII is left to _FOLD, bytes that are no UTF-8 stay. Upper case first: casefold alone keeps a dotless i apart from its capital."""
    return text if text.isascii() else text.decode("utf-8", "surrogateescape").upper().casefold().encode("utf-8", "surrogateescape")


def fold(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts in one array, each with a space at both ends and a zero byte before and after, and where each starts (and one past the last)."""
    data, offsets = shared.joined([b" " + fold_case(t) + b" " for t in texts])
    data = _FOLD[data]
    data[offsets[1:] - 1] = 0
    keep = (data != 32) | (np.append(np.uint8(0), data[:-1]) != 32)
    kept = np.add.reduceat(keep, offsets[:-1], dtype=np.int64) if len(texts) else np.empty(0, np.int64)
    return np.append(np.uint8(0), data[keep]), np.append(0, np.cumsum(kept)) + 1


def body(text: str | None) -> bytes:
    """An item's folded bytes without spaces at the ends; nothing if they say nothing."""
    data, offsets = fold([(text or "").encode("utf-8", "surrogatepass")])
    return data[offsets[0] : offsets[1] - 1].tobytes().strip(b" ")


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from every position on."""
    padded = np.append(data, np.zeros(Q, np.uint8)).astype(np.uint64)
    n = len(data)
    two = padded[:-1] | (padded[1:] << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    eight = four[:-4] | (four[4:] << np.uint64(32))
    return eight[:n] * np.uint64(0x9E3779B97F4A7C15) ^ two[Q - 2 : Q - 2 + n] * np.uint64(0xC2B2AE3D27D4EB4F)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Matcher:
    """Segments of a block of items (index, folded bytes), and a table of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]]):
        owners, parts, self.tiny = [], [], {}
        for owner, text in items:
            if len(text) + 2 < Q:
                self.tiny.setdefault(b" " + text + b" ", []).append(owner)
                continue
            if len(text) < SHORT:
                owners.append(owner)
                parts.append(b" " + text + b" ")
                continue
            last = max(0, len(text) - SEGMENT)
            for start in [*range(0, last, STRIDE), last]:
                owners.append(owner)
                parts.append(text[start : start + SEGMENT])
        self.owner = np.array(owners, np.int64)
        self.length = np.array([len(p) for p in parts], np.int64)
        exact = np.array([p[:1] == b" " and p[-1:] == b" " and len(p) < SHORT + 2 for p in parts], bool)
        self.budget = np.where(exact, 0, np.minimum((self.length * RATE).astype(np.int64), (self.length - Q) // Q))
        self.need = self.length - Q + 1 - Q * self.budget
        self.text = np.zeros((len(parts), SEGMENT), np.uint8)
        for i, p in enumerate(parts):
            self.text[i, : len(p)] = np.frombuffer(p, np.uint8)
        many = self.length - Q + 1
        segment = np.repeat(np.arange(len(parts), dtype=np.int32), many)
        place = (np.arange(len(segment)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int16)
        codes = np.concatenate([grams(np.frombuffer(p, np.uint8))[: len(p) - Q + 1] for p in parts]) if parts else np.empty(0, np.uint64)
        order = np.argsort(codes, kind="stable")
        self.segment, self.place = segment[order], place[order]
        self.codes, self.first = np.unique(codes[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(codes)))
        self.mark = np.zeros(1 << BITS, bool)
        self.mark[self.codes >> np.uint64(64 - BITS)] = True

    def find(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index of the text, item, edits, offset in the folded text) of every region that passes."""
        data, starts = fold(texts)
        found = [(np.empty(0, np.int64),) * 4]
        for a in range(0, max(1, len(data) - MARGIN), WINDOW):
            owner, edits, ends, length = self._window(data[a : a + WINDOW + MARGIN])
            found.append((owner, edits, ends + a, length))
        owner, edits, ends, length = (np.concatenate(x) for x in zip(*found, strict=True))
        text = np.searchsorted(starts, ends - 1, "right") - 1
        return text, owner, edits, np.maximum(0, ends - length - starts[text])

    def _window(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item, edits, end, length of the segment) of the regions of one window."""
        codes = grams(data)
        hit = np.flatnonzero(self.mark[codes >> np.uint64(64 - BITS)])
        index = np.searchsorted(self.codes, codes[hit])
        same = index < len(self.codes)
        same[same] = self.codes[index[same]] == codes[hit][same]
        hit, index = hit[same], index[same]
        wide = np.int64(2 * SEGMENT + len(data))
        sums = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        total = np.cumsum(self.count[index])
        edge = [0, *np.searchsorted(total, np.arange(HITS, int(total[-1]), HITS)), len(hit)] if len(hit) else [0]
        for a, b in zip(edge, edge[1:], strict=False):
            n = self.count[index[a:b]]
            entry = np.repeat(self.first[index[a:b]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            segment = self.segment[entry].astype(np.int64)
            diagonal = np.repeat(hit[a:b], n) - self.place[entry] + SEGMENT  # never negative
            sums.append(np.unique(segment * wide + diagonal // (self.budget[segment] + 1), return_counts=True))
        keys, counts = _summed(*(np.concatenate(x) for x in zip(*sums, strict=True)))
        # A band is a cell and its right neighbour: every cell begins one, and every cell ends one.
        both = np.unique(np.concatenate([keys, keys - 1]))
        total = np.zeros(len(both), np.int64)
        for shift in (0, 1):
            at = np.searchsorted(keys, both + shift)
            there = at < len(keys)
            there[there] = keys[at[there]] == both[there] + shift
            total[there] += counts[at[there]]
        ok = total >= self.need[np.clip(both // wide, 0, max(0, len(self.need) - 1))] if len(both) else np.empty(0, bool)
        segment, band = both[ok] // wide, both[ok] % wide
        low = band * (self.budget[segment] + 1) - SEGMENT
        found = [self.align(data, segment[i : i + 4096], low[i : i + 4096]) for i in range(0, len(segment), 4096)]
        edits, ends = (np.concatenate([f[j] for f in found]) if found else np.empty(0, np.int64) for j in (0, 1))
        good = edits <= self.budget[segment]
        segment, edits, ends = segment[good], edits[good], ends[good]
        out = [(self.owner[segment], edits, ends, self.length[segment])]
        if self.tiny:
            whole = data.tobytes()
            for word, owners in self.tiny.items():
                at, places = whole.find(word), []
                while at >= 0:
                    places.append(at + len(word))
                    at = whole.find(word, at + 1)
                n = len(places)
                out.append((np.repeat(owners, n), np.zeros(n * len(owners), np.int64), np.tile(np.array(places, np.int64), len(owners)), np.full(n * len(owners), len(word))))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def align(self, data: np.ndarray, segment: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits of each segment against a region of its band's diagonals, budget wider on both sides, and where it ends."""
        e = self.budget[segment]
        width = int(4 * e.max(initial=0) + 4)
        across = np.arange(width)
        origin = low - e
        cost = np.zeros((len(segment), width), np.int32)
        steps, best, ends = self.length[segment], np.full(len(segment), 1 << 20, np.int64), np.zeros(len(segment), np.int64)
        for i in range(int(steps.max(initial=0))):
            at = origin[:, None] + across + i
            byte = np.where((at >= 0) & (at < len(data)), data[np.clip(at, 0, len(data) - 1)], 0)
            differs = (byte != self.text[segment, i][:, None]) + (byte == 0) * 1024
            down = np.concatenate([cost[:, 1:], np.full((len(cost), 1), 1 << 20, np.int32)], 1) + 1
            cost = np.minimum(cost + differs, down)
            cost = np.minimum.accumulate(cost - across, 1) + across
            done = steps == i + 1
            if done.any():
                best[done] = cost[done].min(1)
                ends[done] = origin[done] + cost[done].argmin(1) + i + 1
        return best, ends


Items = list[tuple[int | None, bytes]]


def blocks(benchmark: DataFrame, ident: str = "item_id", text: str = "text", most: int = BLOCK_BYTES) -> Iterator[Items]:
    """The items' folded texts in blocks of bounded size, read a partition at a time; a longer one in parts that share what a segment needs."""
    block, size, step = [], 0, most // STRIDE * STRIDE
    for row in benchmark.filter(F.col(text).isNotNull()).select(ident, text).toLocalIterator():
        whole = body(row[1])
        for start in range(0, max(1, len(whole) - SEGMENT + 1), step) if whole else ():
            block.append((row[0], whole[start : start + step + SEGMENT]))
            size += len(block[-1][1])
            if size >= most:
                yield block
                block, size = [], 0
    if block:
        yield block


def _matcher(block: Items) -> Matcher:
    return Matcher([(i, text) for i, (_, text) in enumerate(block)])


FOUND = "doc_id bigint, item_id bigint, edits bigint, at bigint"


def matches(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, regions, edits (fewest), first_at (in the folded text, in bytes)."""
    parts = []
    spark = docs.sparkSession
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(_matcher(block))  # at most BLOCK_BYTES of items
        items = pa.array([x for x, _ in block], pa.int64())

        def run(batches, held=held, items=items):
            for batch in batches:
                for part in shared.slices(batch, 1, WINDOW):
                    at, item, edits, place = held.value.find(shared.utf8(part.column(1)))
                    if len(at):
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)).cast(pa.int64()), items.take(pa.array(item)), pa.array(edits), pa.array(place)], ["doc_id", "item_id", "edits", "at"])

        parts.append(docs.select(ident, text).mapInArrow(shared.tidy(run), FOUND))
    found = parts[0] if parts else spark.createDataFrame([], FOUND)
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.count_distinct("at").alias("regions"), F.min("edits").alias("edits"), F.min("at").alias("first_at"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs without the contaminated rows; all columns stay. A scan for each block of the benchmark, no shuffle."""
    index = docs.columns.index(text)
    for block in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(_matcher(block))

        def run(batches, held=held):
            for batch in batches:
                for part in shared.slices(batch, index, WINDOW):
                    keep = np.ones(part.num_rows, bool)
                    keep[held.value.find(shared.utf8(part.column(index)))[0]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(shared.tidy(run), docs.schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document with each item that it holds: doc_id, item_id, regions, edits, first_at."""
    return matches(shared.read(spark, sf_dir, "documents"), shared.read(spark, sf_dir, "benchmark"))


def brute(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> set[tuple[int, int]]:
    """(doc_id, item_id) by aligning every segment with every whole text; for tests."""
    out = set()
    for item, text in items:
        whole = body(text)
        if not whole:
            continue
        m = Matcher([(0, whole)])
        segments = [(m.text[s, : m.length[s]], m.budget[s]) for s in range(len(m.owner))] + [(np.frombuffer(w, np.uint8), 0) for w in m.tiny]
        for ident, t in docs:
            data = fold([(t or "").encode()])[0]
            for segment, budget in segments:
                row = np.arange(len(segment) + 1)
                for byte in data:
                    new = np.minimum(np.append(0, row[:-1] + (segment != byte) + (byte == 0) * 1024), row + 1)
                    row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
                    if row[-1] <= budget:
                        out.add((ident, item))
                        break
    return out
