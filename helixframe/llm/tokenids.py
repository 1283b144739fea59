"""Token ids in a binary format: canonical, length-limited Huffman codes in independent blocks.

Documents are put in order of their id and encoded once, whole documents into blocks of about BLOCK_TOKENS ids,
which are kept in the shared folder. Ids are counted over all of them; from the counts come code lengths of at most
MAX_BITS bits (more where there are more ids than that can tell apart), and canonical codes from the lengths, so that the
code book is one byte for each id. Then each block is packed. It stands on its own: ids and lengths of its documents, its bits, and the bit offset of every
STRIDE-th id, from which decoding goes on in parallel by table look-up.

Files: `codebook` (one row: lengths) and `blocks` (part, start within the part, tokens, doc_ids, counts, offsets,
bits), both written by Spark's committer, so any store works. Where a part starts follows from the totals
of the parts before it.

Encoding is the tokenizers library's own. Where the tokenizer's file asks for byte-level pieces and nothing else, the
texts of a slice are cut together into the pieces that its pre-tokenizer makes, equal pieces become one, and what the
library's model gives for a piece is kept in arrays of bounded size. New pieces go to the model many at a time, kept apart
by a sign that it merges with nothing. Characters from U+0250 on, whose classes depend on the version of Unicode, go to the
whole library with what stands around them up to the next spaces; so do, whole, texts of which they are more than half,
texts that may hold an added token, and all texts of other tokenizers. A worker holds one slice of a batch (SLICE_BYTES of text, or one longer text), one block and
the arrays at a time.

Defined cases: null and empty texts are just the end id; rows with equal or null ids are kept, null first, equal ones
in the order of a hash of their text, which also spreads an id that many rows share; an empty table gives empty files. A
document is never split over blocks. Other columns are ignored.
"""

from __future__ import annotations

import codecs
import os
import re
import unicodedata
import zlib
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

MAX_BITS = 16
BLOCK_TOKENS = 262_144
STRIDE = 64
END = 0
TABLE_BYTES = 24_000_000
SLICE_BYTES = 4_000_000
#: Bytes of pieces in one call of the library's model (or one longer piece), and of the largest entry that is kept.
TOGETHER = 4096
LONG = 256
BLOCKS = "part int, start bigint, tokens bigint, doc_ids binary, nulls binary, counts binary, offsets binary, bits binary"

_ID = attrgetter("id")
#: Characters below this have the same class in every version of Unicode.
LIMIT = 0x250


#: Kinds of a text's bytes: letters, digits, other signs, white space, characters from LIMIT on. A character's bytes have one kind.
_LETTER, _DIGIT, _SIGN, _SPACE, _ODD = range(5)


def _kind(code: int) -> int:
    sign = chr(code)
    if sign.isspace() and not 0x1C <= code <= 0x1F:
        return _SPACE
    return {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(sign)[0], _SIGN)


#: By code point, up to the largest of two bytes that a byte below 0xCA begins.
_KINDS = np.array([_kind(i) if i < LIMIT else _ODD for i in range(0x280)], np.uint8)
_ASCII = np.concatenate([_KINDS[:0x80], np.full(0x80, _ODD, np.uint8)])
#: Where a long text may be cut: what follows a space after another sign is encoded by itself.
_GAP = re.compile(rb"[!-~] ")


def piece_starts(data: np.ndarray, edges: np.ndarray, whole: list[tuple[int, int]]) -> np.ndarray:
    """Where the pre-tokenizer's pieces of UTF-8 texts begin; edges: where texts begin, and the end of the last.

    The pattern is the usual one: contractions, then letters, digits and other signs with a space before them, then white
    space, whose last sign stands alone before something else. Characters from LIMIT on stay with all that reaches from the
    last space after a character of another kind to the next one; texts where they are more than half, and the given
    ranges of whole texts, stay whole.
    """
    n = len(data)
    kinds = _ASCII[data]
    high = np.flatnonzero(data > 0x7F)
    lead = high[(data[high] >= 0xC2) & (data[high] < 0xCA)]
    kinds[lead] = kinds[lead + 1] = _KINDS[(data[lead] & 0x1F).astype(np.int64) << 6 | data[lead + 1] & 0x3F]
    begins = np.zeros(n + 1, bool)
    begins[edges] = True
    cut = begins[:n].copy()
    cut[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == _SPACE
    after = np.flatnonzero(space[:-1] & ~space[1:] & ~begins[1:n]) + 1
    cut[after - 1 - (data[after - 1] > 0x7F)] = True
    cut[after] = data[after - 1] != 0x20
    quotes = np.flatnonzero(data == 0x27)
    quotes = quotes[cut[quotes] & ~begins[quotes + 1]]
    first, second = data[quotes + 1], data[np.minimum(quotes + 2, n - 1)]
    one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
    two = (np.isin(first, np.frombuffer(b"rv", np.uint8)) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
    two &= ~begins[np.minimum(quotes + 2, n)]
    cut[quotes[one | two] + 1] = False
    ends = np.concatenate([quotes[one] + 2, quotes[two] + 3])
    cut[ends[ends < n]] = True
    odd = high[kinds[high] == _ODD]
    text = np.searchsorted(edges, odd, "right") - 1
    many = np.flatnonzero(2 * np.bincount(text, minlength=len(edges) - 1) > np.diff(edges))
    odd = odd[~np.isin(text, many)]
    if len(odd):
        safe = begins.copy()
        safe[1:n] |= (data[1:] == 0x20) & (kinds[:-1] < _SPACE)
        safe = np.flatnonzero(safe)
        k = np.unique(np.searchsorted(safe, odd, "right"))
        whole = [*zip(safe[k - 1].tolist(), safe[k].tolist(), strict=True), *whole]
    for a, b in [*zip(edges[many].tolist(), edges[many + 1].tolist(), strict=True), *whole]:
        cut[a + 1 : b] = False
    return np.flatnonzero(cut)


class _Table(dict):
    """Encoded pieces by text, in two generations of at most TABLE_BYTES each: what is used moves to the young one, what isn't goes."""

    def __init__(self, make):
        self.make, self.old, self.room = make, {}, TABLE_BYTES

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self.room -= 180 + len(key) + len(value)  # both objects and their place in the table, about
        if self.room < 0:
            self.old = dict(self)
            self.clear()
            self.room = TABLE_BYTES
        self[key] = value
        return value


class _Pieces:
    """Encoded pieces in arrays. Beyond TABLE_BYTES half of that stays: what most slices of text held, the younger of equals."""

    def __init__(self, make):
        self.make = make
        self.keys, self.sizes, self.ids, self.seen = pa.array([], pa.large_binary()), np.empty(0, np.int64), np.empty(0, "<u4"), np.empty(0, np.int32)

    def find(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct keys: where their ids begin, how many they are, and the ids of all pieces."""
        rows = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)
        lost = np.flatnonzero(rows < 0)
        if len(lost):
            ids, sizes = self.make(keys.take(pa.array(lost)).to_numpy(zero_copy_only=False).tolist())
            rows[lost] = len(self.sizes) + np.arange(len(lost))
            self.keys = pa.concat_arrays([self.keys, keys.take(pa.array(lost))])
            self.sizes, self.ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
            self.seen = np.concatenate([self.seen, np.zeros(len(lost), np.int32)])
        self.seen[rows] += 1
        out = (np.cumsum(self.sizes) - self.sizes)[rows], self.sizes[rows], self.ids
        self.shrink()
        return out

    def shrink(self) -> None:
        costs = pc.binary_length(self.keys).to_numpy() + 4 * self.sizes + 20
        if costs.sum() <= TABLE_BYTES:
            return
        order = np.argsort(self.seen, kind="stable")[::-1]
        order = order[costs[order] <= LONG]
        stay = np.sort(order[np.cumsum(costs[order]) <= TABLE_BYTES // 2])
        kept = np.zeros(len(self.sizes), bool)
        kept[stay] = True
        self.ids = self.ids[np.repeat(kept, self.sizes)]
        self.keys, self.sizes, self.seen = self.keys.take(pa.array(stay)), self.sizes[stay], self.seen[stay] // 2


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tool = Tokenizer.from_file(path)
        model = self.model = self.tool.model
        cut = self.tool.pre_tokenizer
        self.simple = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space and self.tool.normalizer is None and isinstance(model, models.BPE)
        self.added = [t.content.encode() for t in self.tool.get_added_tokens_decoder().values()]
        self.apart = re.compile(b"|".join([rb"[\xca-\xff]|\xc9[\x90-\xbf]", *map(re.escape, self.added)]))  # signs from LIMIT on, added tokens
        # The byte-level alphabet: printable Latin-1 signs stand for themselves, the others for U+0100 and on, in order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(0x100) if b not in plain]
        signs = {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}
        self.signs = "".join(signs[b] for b in range(0x100))
        # No text holds the byte 0xFF. Where nothing is merged with its sign, it keeps pieces apart within one call of the model.
        self.between = None
        if self.simple and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges or model.fuse_unk):
            held = self.tool.get_vocab(with_added_tokens=False)
            if sum(self.signs[0xFF] in x for x in held) == 1:
                self.between = held.get(self.signs[0xFF])
        self.pieces, self.others = _Pieces(self.make), _Table(self.whole)

    def tokens(self, pieces: bytes) -> np.ndarray:
        """Ids of pieces, by the library's model alone."""
        found = self.model.tokenize(codecs.charmap_decode(pieces, "strict", self.signs)[0])
        return np.fromiter(map(_ID, found), "<u4", len(found))

    def whole(self, text: str) -> bytes:
        return np.array(self.tool.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def make(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has: many in a call of the model, or by the whole library where a piece needs it."""
        ids, sizes, at = [], [], 0
        most = TOGETHER if self.between is not None else 1
        odd = [i for i, x in enumerate(keys) if self.apart.search(x)]
        for stop in [*odd, len(keys)]:
            for a, b in shared.pieces(keys[at:stop], most):
                found = self.tokens(b"\xff".join(keys[at + a : at + b]))
                ends = np.flatnonzero(found == self.between)
                ids.append(np.delete(found, ends))
                sizes.append(np.diff(ends, prepend=-1, append=len(found)) - 1)
            if stop < len(keys):
                text = keys[stop].decode()
                ids.append(np.frombuffer(self.others[text] if len(text) <= LONG else self.whole(text), "<u4"))
                sizes.append(np.array([len(ids[-1])]))
            at = stop + 1
        return np.concatenate(ids), np.concatenate(sizes)

    def added_in(self, data: np.ndarray) -> bool:
        """Whether a text may hold an added token."""
        held = data.tobytes()
        return any(x in held for x in self.added)

    def stretch(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of neighbouring texts, and how many stand before each edge. Equal pieces are looked up once."""
        whole = []
        if self.added_in(data):
            whole = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) if self.added_in(data[a:b])]
        starts = piece_starts(data, edges, whole)
        cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        places, sizes, held = self.pieces.find(cut.dictionary)
        which = cut.indices.to_numpy()
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        return held[np.repeat(places[which] - ends[:-1], n) + np.arange(ends[-1])], ends[np.searchsorted(starts, edges)]

    def texts(self, column: pa.Array) -> list[bytes]:
        """Of a column of at most SLICE_BYTES, or of one text, which is cut where it is longer."""
        if not self.simple:
            return [self.whole(x) if x else b"" for x in column.to_pylist()]
        column = column.cast(pa.large_string()).fill_null("")
        column.validate(full=True)
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        if edges[0] == edges[-1]:
            return [b""] * len(column)
        data = np.frombuffer(column.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        if len(column) == 1 and len(data) > SLICE_BYTES and not self.added_in(data):
            stops = [0]
            while found := _GAP.search(data, stops[-1] + SLICE_BYTES):
                stops.append(found.end() - 1)
            stops.append(len(data))
            return [b"".join(self.stretch(data[a:b], np.array([0, b - a]))[0].tobytes() for a, b in zip(stops, stops[1:], strict=False))]
        ids, ends = self.stretch(data, edges)
        held = ids.tobytes()
        return [held[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def text(self, text: str | None) -> bytes:
        return self.texts(pa.array([text], pa.string()))[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that later tasks find its tables filled."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for every id (package-merge); 0 for ids that don't occur.

    A limit that can't tell the ids apart is raised to one bit more than they need.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
    if len(used) < 2:
        return lengths
    if len(used) > 1 << limit:
        limit = (len(used) - 1).bit_length() + 1
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, merged = [], weights
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(weights))
        merged = both[by]
    take = 2 * len(weights) - 2
    depth = np.zeros(len(weights), np.int64)
    for single in reversed(levels):
        n = int(single[:take].sum())
        depth[:n] += 1
        take = 2 * (take - n)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


class Code:
    """Canonical codes: by length, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, self.lengths[used]))]
        self.top = int(self.lengths.max(initial=1))
        spans = np.int64(1) << (self.top - self.lengths[order])
        left = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (left >> (self.top - self.lengths[order])).astype(np.uint64)
        self.symbols = np.zeros(1 << self.top, np.uint32)
        self.symbols[: int(spans.sum())] = np.repeat(order, spans)
        self.steps = self.lengths[self.symbols]

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits (first bit highest, padded) and the bit offset of every STRIDE-th id."""
        if not len(ids):
            return b"", np.empty(0, np.uint32)
        n, codes, most = self.lengths[ids], self.codes[ids], self.top
        marks = (np.cumsum(n) - n)[::STRIDE].astype("<u4")
        while 2 * most <= 64:  # neighbours become one code while they fit in 64 bits
            if len(n) % 2:
                n, codes = np.append(n, 0), np.append(codes, np.uint64(0))
            codes = codes[::2] << n[1::2].astype(np.uint64) | codes[1::2]
            n, most = n[::2] + n[1::2], 2 * most
        ends = np.cumsum(n)
        at = ends - n
        word, room = at >> 6, 64 - (at & 63) - n
        out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        head = np.where(room >= 0, codes << np.maximum(room, 0).astype(np.uint64), codes >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] |= np.bitwise_or.reduceat(head, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], marks

    def unpack(self, bits: bytes, offsets: np.ndarray, total: int) -> np.ndarray:
        """The ids again: all checkpoints move on together, one id a step."""
        data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
        windows = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        at = offsets.astype(np.int64)
        out = np.empty((STRIDE, len(at)), np.uint32)
        shift, mask = 32 - self.top, (1 << self.top) - 1
        for i in range(STRIDE):
            index = (windows[np.minimum(at >> 3, len(windows) - 1)] >> (shift - (at & 7)).astype(np.uint32)) & mask
            out[i] = self.symbols[index]
            at += self.steps[index]
        return out.T.reshape(-1)[:total]


ENCODED = "part int, start bigint, tokens bigint, doc_ids binary, nulls binary, counts binary, width int, ids binary"
_ENCODED = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
_BLOCKS = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]


def _row(values: list, types: list, ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [x.split()[0] for x in ddl.split(", ")])


def _rows(batches):
    """Rows of batches as dicts, one block at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def encode(rows: DataFrame, path: str, end: int = END) -> DataFrame:
    """Blocks of the ids of (id, text) in ascending order of id, in 16 or 32 bits each."""

    def blocks(batches):
        from pyspark import TaskContext

        tool, stop = encoder(path), np.array([end], "<u4").tobytes()
        part, start = TaskContext.get().partitionId(), 0
        idents, encoded, size = [], [], 0

        def block():
            ids = np.frombuffer(b"".join(encoded), "<u4")
            width = 2 if ids.max() < 1 << 16 else 4
            known = np.array([0 if x is None else x for x in idents], "<i8")
            none = np.packbits(np.array([x is None for x in idents], bool))
            counts = np.array([len(x) // 4 for x in encoded], "<u4")
            return _row([part, start, len(ids), known.tobytes(), none.tobytes(), counts.tobytes(), width, ids.astype(f"<u{width}").tobytes()], _ENCODED, ENCODED)

        for batch in batches:
            for part_ in shared.slices(batch, 1, SLICE_BYTES):
                for ident_, ids_ in zip(part_.column(0).to_pylist(), tool.texts(part_.column(1)), strict=True):
                    idents.append(ident_)
                    encoded.append(ids_ + stop)
                    size += len(encoded[-1]) // 4
                    if size >= BLOCK_TOKENS:
                        yield block()
                        start += size
                        idents, encoded, size = [], [], 0
        if idents:
            yield block()

    ordered = rows.select("id", "text", F.xxhash64("text").alias("h")).repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    return ordered.select("id", "text").mapInArrow(shared.tidy(blocks), ENCODED)


def count_ids(encoded: DataFrame) -> np.ndarray:
    """How often every id occurs over all blocks. What reaches the driver is bounded by the ids there are."""

    def count(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            for width, ids in zip(batch.column(0), batch.column(1), strict=True):
                more = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"), minlength=len(total))
                more[: len(total)] += total
                total = more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], ["token", "n"])

    rows = encoded.select("width", "ids").mapInArrow(shared.tidy(count), "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(max([0, *rows["token"]]) + 1, np.int64)
    counts[rows["token"]] = rows["n"]
    return counts


def write(docs: DataFrame, target: str, path: str, ident: str = "doc_id", text: str = "text", end: int = END) -> None:
    """Write the texts' ids below target, in ascending order of ident; path: the tokenizer's file."""
    spark = docs.sparkSession
    encoded = shared.cut(encode(docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text")), path, end), "ids")
    lengths = code_lengths(count_ids(encoded))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{target}/codebook")
    held = spark.sparkContext.broadcast(lengths.tobytes())  # a byte for each id of the vocabulary

    def pack(batches):
        code = Code(np.frombuffer(held.value, np.uint8))
        for r in _rows(batches):
            bits, offsets = code.pack(np.frombuffer(r["ids"], f"<u{r['width']}"))
            yield _row([r["part"], r["start"], r["tokens"], r["doc_ids"], r["nulls"], r["counts"], offsets.tobytes(), bits], _BLOCKS, BLOCKS)

    encoded.mapInArrow(shared.tidy(pack), BLOCKS).write.option("compression", "none").parquet(f"{target}/blocks")


def _documents(spark: SparkSession, target: str, column: str, kind: str, finish) -> DataFrame:
    """Decoded files: a row for each document with id, start (over all files), n_tokens and finish(its ids' bytes).

    Broadcast are the code book and a number for each file, so ids don't move.
    """
    stored = spark.read.schema("lengths binary").parquet(f"{target}/codebook").first()
    held = spark.sparkContext.broadcast(bytes(stored["lengths"]))
    files = spark.read.schema(BLOCKS).parquet(f"{target}/blocks")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", F.coalesce(F.sum("tokens").over(ahead), F.lit(0)).alias("ahead"))

    def decode(batches):
        code = Code(np.frombuffer(held.value, np.uint8))
        for r in _rows(batches):
            counts = np.frombuffer(r["counts"], "<u4").astype(np.int64)
            ids = memoryview(code.unpack(r["bits"], np.frombuffer(r["offsets"], "<u4"), r["tokens"]).astype("<u4").tobytes())
            ends = np.cumsum(counts)
            none = np.unpackbits(np.frombuffer(r["nulls"], np.uint8), count=len(counts)).astype(bool)
            known = pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=none)
            done = pa.array([finish(ids[4 * a : 4 * b]) for a, b in zip(ends - counts, ends, strict=True)], {"bigint": pa.int64(), "binary": pa.binary()}[kind])
            yield pa.RecordBatch.from_arrays([known, pa.array(np.full(len(counts), r["part"], np.int32)), pa.array(r["start"] + ends - counts), pa.array(counts), done], ["id", "part", "start", "n_tokens", column])

    rows = files.mapInArrow(shared.tidy(decode), f"id bigint, part int, start bigint, n_tokens bigint, {column} {kind}")
    return rows.join(F.broadcast(parts), "part").select("id", (F.col("start") + F.col("ahead")).alias("start"), "n_tokens", column)


def read(spark: SparkSession, target: str) -> DataFrame:
    """Decode files: id, start, n_tokens and ids (32-bit little-endian) of every document."""
    return _documents(spark, target, "ids", "binary", bytes)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def digest(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from files; sums are taken where ids are decoded."""
    return _documents(spark, target, "ids_crc32", "bigint", zlib.crc32).withColumnRenamed("id", "doc_id")


def encode_and_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    target = shared.shared_path(docs.sparkSession, "tokens")
    write(docs, target, path or tokenizer_path())
    return digest(docs.sparkSession, target)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, from the files read back: doc_id, start, n_tokens, ids_crc32."""
    return encode_and_digest(shared.read(spark, sf_dir, "documents"))


def brute(rows: list[tuple[int, str | None]], path: str) -> list[tuple[int, int, int, int]]:
    """What op6 must give for rows of distinct ids, text by text with the library alone; for tests."""
    from tokenizers import Tokenizer

    tool, start, out = Tokenizer.from_file(path), 0, []
    for ident, text in sorted(rows):
        ids = [*tool.encode(text or "", add_special_tokens=False).ids, END]
        out.append((ident, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out
