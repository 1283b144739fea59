"""N-gram Jaccard join as a blocked sparse matrix product of the document by n-gram incidence.

Documents link when their sets of distinct word n-grams have 100 * |intersection| >= 75 * |union|. The product of
the incidence matrix with its transpose holds all intersections; it is computed in blocks, and what size bounds
rule out is discarded before it is multiplied:

1. Columns. Texts become sets of 64-bit n-gram hashes in numpy, a chunk of documents at a time. Each chunk sends
   its entries to column ranges, in order and packed as differences of as few bytes as hold them (8 bytes an entry instead of
   12), with the place of the document in the chunk; an n-gram that several
   documents of a chunk hold is sent once with its count, so a very frequent n-gram costs an entry a chunk. A column
   held by one document adds to no intersection and is dropped; the others come back with the bit length of
   their document frequency.
2. Rows. A linked pair shares at least 75% of either set, so a row whose remaining columns are fewer is
   discarded. Rows with equal sets become one class.
3. Pairs. With columns ordered from rare to frequent (then by hash), linked rows share one of the first
   |shared| - ceil(0.75 * n) + 1 columns of each. Every column joins its rows to its smallest row; rows that hang
   together through such pairs are a group, and no link leaves a group.
4. Products. Groups are multiplied in tiles of bounded size: overlap counts accumulate over the columns of a tile, row
   by row; pairs outside the size bound, and pairs that links found before already connect, are skipped. Groups larger
   than a tile are cut into tiles; then rows outside the largest component so far meet all tiles of their
   group, each side cut into tiles.

Only links that connect something new are written, so a group of m copies costs about m links, not m * m. The
component of a document is the smallest id that it reaches. An n-gram is known by all 64 bits of its hash.

Defined cases: null, empty and wordless texts have an empty set and link with nothing; texts of fewer than n words
have the one n-gram of all their words; words are runs of other than ASCII white space with A-Z lower-cased;
rows with equal ids are one document with several texts, each of which is looked up: the document has the links of
all; null ids are left out; empty tables give no rows; other columns are ignored, and carried by keep_first(). A text
of any length is hashed in parts of PART_BYTES that overlap by n - 1 words.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .graph import components

N = 5
PERCENT = 75
CHUNK_BYTES = 8_000_000
RANGE_BYTES = 8_000_000
TILE_COLUMNS = 2_000_000
PART_BYTES = 2_000_000
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def _parts(texts: list[bytes], n: int):
    """(texts, text of each, whether each ends its text): short texts together, long ones cut at white space so that parts share n - 1 words."""
    for a, b in shared.pieces(texts, PART_BYTES):
        if b - a > 1 or len(texts[a]) <= 2 * PART_BYTES:
            yield texts[a:b], np.arange(a, b), np.ones(b - a, bool)
            continue
        text, start = texts[a], 0
        while start < len(text):
            # The part takes in n more words, so that n - 1 are whole; the next one begins at the first of them.
            stop = _SPACES.search(text, start + PART_BYTES)
            end = stop
            for _ in range(n - 1):
                end = _SPACES.search(text, end.end()) if end else None
            if end is None:
                yield [text[start:]], np.array([a]), np.array([True])
                break
            yield [text[start : end.start()]], np.array([a]), np.array([False])
            start = stop.end()


def shingles(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each): the distinct n-grams of texts, sorted by text."""
    hashes, docs, cut = [], [], False
    for some, which, ends in _parts(texts, n):
        data, offsets = shared.joined(some)
        words, starts, _ = shared.word_hashes(shared.lower_ascii(data))
        of = np.searchsorted(starts, offsets)
        count = np.diff(of)
        doc = np.repeat(np.arange(len(some)), count)
        rest = of[1:][doc] - np.arange(len(words))  # words from here to the end of the text
        short = (count < n) & ends & (not cut)
        value = np.zeros(len(words), np.uint64)
        padded = np.append(words, np.zeros(n, np.uint64))
        for i in range(n):
            value = shared.mix64(value * np.uint64(0x9E3779B97F4A7C15) + np.where(i < rest, padded[i : i + len(words)], np.uint64(0)) + np.uint64(i + 1))
        keep = (rest >= n) | (short[doc] & (rest == count[doc]))
        hashes.append(value[keep])
        docs.append(which[doc[keep]])
        cut = not ends[-1]
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value, doc = np.concatenate(hashes), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1]))[: len(value)]
    return value[new], doc[new]


#: Marks a count in an array of places.
MARK = np.uint32(0x80000000)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys: bytes of a difference (one byte), the first key, the differences to the next ones."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked_keys(data) -> np.ndarray:
    if not len(data):
        return np.empty(0, np.uint64)
    steps = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    wide = np.zeros((len(steps) + 1, 8), np.uint8)
    wide[1:, : data[0]] = steps
    wide[0] = np.frombuffer(data, np.uint8, 8, 1)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def packed_places(who: np.ndarray) -> bytes:
    """Places and marked counts in two bytes each where all fit, else in four; the first byte says which."""
    bare = who & ~MARK
    if bare.max(initial=0) < 1 << 15:
        return b"\2" + (bare | (who & MARK) >> np.uint32(16)).astype("<u2").tobytes()
    return b"\4" + who.astype("<u4").tobytes()


def unpacked_places(data) -> np.ndarray:
    if not len(data) or data[0] == 4:
        return np.frombuffer(data, "<u4", offset=min(1, len(data))).astype(np.uint32)
    who = np.frombuffer(data, "<u2", offset=1).astype(np.uint32)
    return (who & np.uint32(0x7FFF)) | (who & np.uint32(0x8000)) << np.uint32(16)


def _unpacked(column, read) -> list[np.ndarray]:
    return [read(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in column]


ENTRIES = "slot bigint, chunk bigint, ids binary, sizes binary, who binary, keys binary"
_TYPES = [pa.int64(), pa.int64(), *[pa.binary()] * 4]


def _row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], ["slot", "chunk", "ids", "sizes", "who", "keys"])


def entries(docs: DataFrame, ranges: int, n: int = N) -> DataFrame:
    """Packed entries of (id, text). Slots 0 to ranges - 1 are column ranges, -1 - (chunk mod ranges) what stays with its chunk."""

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in shared.slices(batch, 1, CHUNK_BYTES):
                texts, ids = shared.utf8(some.column(1)), some.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                chunk = (part << 32) + seq
                seq += 1
                key, doc = shingles(texts, n)
                sizes = np.bincount(doc, minlength=len(texts))
                order = np.argsort(key, kind="stable")
                key, who = key[order], doc[order].astype(np.uint32)
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                count = np.diff(np.append(first, len(key)))
                # A column of several rows here goes out once, marked, with its count; its rows stay with the chunk.
                sent, k = np.where(count > 1, count.astype(np.uint32) | MARK, who[first]), key[first]
                edge = np.searchsorted((k >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges + 1).astype(np.uint64))
                for r in np.flatnonzero(np.diff(edge)):
                    x = slice(edge[r], edge[r + 1])
                    yield _row(int(r), chunk, None, None, packed_places(sent[x]), packed_keys(k[x]))
                local = np.repeat(count > 1, count)
                yield _row(-1 - chunk % ranges, chunk, ids.tobytes(), sizes.astype("<u4").tobytes(), packed_places(who[local]), packed_keys(key[local]))

    return docs.mapInArrow(shared.tidy(run), ENTRIES)


def columns(table: pa.Table) -> pa.Table:
    """One slot: for a column range the entries of columns of more than one row, back to their chunks with the frequency's bit length."""
    slot, n = table.column("slot")[0].as_py(), table.num_rows
    if slot < 0:
        return table.append_column("bits", pa.array([None] * n, pa.binary()))
    chunks = table.column("chunk").to_pylist()
    who = _unpacked(table.column("who"), unpacked_places)
    of = np.repeat(np.arange(n, dtype=np.int32), [len(w) for w in who])
    who, keys = np.concatenate(who), np.concatenate(_unpacked(table.column("keys"), unpacked_keys))
    order = np.argsort(keys, kind="stable")
    keys, who, of = keys[order], who[order], of[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    weight = np.where(who & MARK, who & ~MARK, 1).astype(np.int64)
    total = np.add.reduceat(weight, first)
    bits = np.floor(np.log2(total)).astype(np.uint8) + 1
    span = np.diff(np.append(first, len(keys)))
    keep = np.repeat(total > 1, span)
    keys, who, of, bits = keys[keep], who[keep], of[keep], np.repeat(bits, span)[keep]
    order = np.argsort(of, kind="stable")  # within a chunk by key, as they are packed
    keys, who, of, bits = keys[order], who[order], of[order], bits[order]
    edge = np.searchsorted(of, np.arange(n + 1))
    out = {k: [] for k in ("chunk", "who", "keys", "bits")}
    for i in np.flatnonzero(np.diff(edge)):
        x = slice(edge[i], edge[i + 1])
        for name, v in zip(out, (chunks[i], packed_places(who[x]), packed_keys(keys[x]), bits[x].tobytes()), strict=True):
            out[name].append(v)
    made = len(out["chunk"])
    return pa.table(
        [pa.array([slot] * made, pa.int64()), pa.array(out["chunk"], pa.int64()), pa.nulls(made, pa.binary()), pa.nulls(made, pa.binary()), *[pa.array(out[k], pa.binary()) for k in ("who", "keys", "bits")]],
        names=[*table.column_names, "bits"],
    )


ROWS = "id bigint, n bigint, columns binary, bits binary, shared bigint, set1 bigint, set2 bigint"


def rows_of(table: pa.Table) -> pa.Table:
    """One chunk: a row for each document, with its columns (rare first) where enough are left, else none."""
    ids = sizes = None
    who, keys, bits, marked, marked_bits = [], [], [], [], []
    views = zip(_unpacked(table.column("who"), unpacked_places), _unpacked(table.column("keys"), unpacked_keys), shared.arrays(table.column("bits"), np.uint8), table.column("ids"), table.column("sizes"), strict=True)
    for w, k, b, own, n in views:
        if own.is_valid:
            ids, sizes = np.frombuffer(own.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), "<u4").astype(np.int64)
            local = (w, k)
            continue
        mark = w >= MARK
        who.append(w[~mark])
        keys.append(k[~mark])
        bits.append(b[~mark])
        marked.append(k[mark])
        marked_bits.append(b[mark])
    known = np.concatenate(marked) if marked else np.empty(0, np.uint64)
    order = np.argsort(known, kind="stable")
    if len(local[0]):
        at = order[np.searchsorted(known, local[1], sorter=order)]
        who.append(local[0])
        keys.append(local[1])
        bits.append(np.concatenate(marked_bits)[at])
    who, keys, bits = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((who, np.uint32), (keys, np.uint64), (bits, np.uint8)))
    order = np.lexsort((keys, bits, who))
    who, keys, bits = who[order], keys[order], bits[order]
    edge = np.searchsorted(who, np.arange(len(ids) + 1))
    out = {k.split()[0]: [] for k in ROWS.split(", ")}
    sums = [np.append(np.uint64(0), np.cumsum(shared.mix64(keys ^ np.uint64(c)))) for c in (0x1234567, 0x89ABCDEF0123)]
    sums = [(s[edge[1:]] - s[edge[:-1]]).astype(np.int64) for s in sums]
    for i in range(len(ids)):
        a, b = edge[i], edge[i + 1]
        enough = sizes[i] > 0 and 100 * (b - a) >= PERCENT * sizes[i]
        sets = [int(s[i]) for s in sums] if enough and b - a == sizes[i] else [None, None]
        for name, v in zip(out, [int(ids[i]), int(sizes[i]), keys[a:b].tobytes() if enough else None, bits[a:b].tobytes() if enough else None, int(b - a), *sets], strict=True):
            out[name].append(v)
    return pa.table(out, pa.schema([(k, pa.binary() if k in ("columns", "bits") else pa.int64()) for k in out]))


def need(n):
    return -(-PERCENT * n // 100)


def link_tile(ids: np.ndarray, n: np.ndarray, sets: list[np.ndarray], group: np.ndarray, label: np.ndarray, active: np.ndarray) -> list[tuple[int, int]]:
    """Links of a tile that connect what label doesn't connect yet; only active rows are multiplied with all the others.

    Row by row: the columns of one row are looked up in the tile, overlap counts of all rows accumulate, and the
    rows within the size bound that are over the threshold and not connected yet are united with it.
    """
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    _, column = np.unique(flat, return_inverse=True)
    order = np.argsort(column, kind="stable")
    members = rows[order]
    start = np.searchsorted(column[order], np.arange(int(column.max(initial=-1)) + 2))
    begin = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int64)
    _, component = np.unique(label, return_inverse=True)
    links = []
    by_group = {}
    for g in np.unique(group):
        by_group[g] = np.flatnonzero(group == g)
    for g, inside in by_group.items():
        parts = np.unique(component[inside])
        if len(parts) < 2:
            continue
        for i in inside[active[inside]]:
            other = component[inside] != component[i]
            if not other.any():
                continue
            near = inside[other]
            near = near[(100 * n[near] >= PERCENT * n[i]) & (100 * n[i] >= PERCENT * n[near])]
            if not len(near):
                continue
            mine = column[begin[i] : begin[i + 1]]
            lengths = start[mine + 1] - start[mine]
            at = np.repeat(start[mine] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
            overlap = np.bincount(members[at], minlength=len(sets))[near]
            for j in near[100 * overlap >= PERCENT * (n[i] + n[near] - overlap)]:
                if component[j] != component[i]:
                    links.append((int(ids[i]), int(ids[j])))
                    component[component == component[j]] = component[i]
    return links


def tile_links(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["grp", "id"])
    sets = [np.frombuffer(c, "<u8") for c in frame["columns"]]
    links = link_tile(frame["id"].to_numpy(), frame["n"].to_numpy(), sets, frame["grp"].to_numpy(), frame["label"].to_numpy(), frame["active"].to_numpy(bool))
    return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def _without(kept: DataFrame, gone: DataFrame, same: list[str]) -> DataFrame:
    """kept without the rows of gone (id and same); columns are wide, so only rows that a sieve takes for gone ones by mistake are shuffled."""
    tag = F.xxhash64("id", *same).alias("tag")
    marks = shared.cut(shared.sieve(gone.select(tag), "tag"), "gone")
    whole = kept.filter("set1 is not null").withColumn("tag", tag)
    maybe = shared.sifted(whole, "tag", marks)
    wrong = shared.cut(maybe.select("tag", "id", *same).join(gone, ["id", *same], "left_anti").distinct(), "not-gone")
    again = shared.sifted(maybe, "tag", shared.sieve(wrong, "tag")).join(wrong.drop("tag"), ["id", *same], "left_semi")
    parts = [kept.filter("set1 is null"), shared.sifted(whole, "tag", marks, False), again]
    return parts[0].unionByName(parts[1].select(*kept.columns)).unionByName(parts[2].select(*kept.columns))


def _places(rows: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """(id, grp, tiles): groups with the number of tiles of each, from the (id, shared) of rows."""
    total = rows.join(groups, "id").groupBy("grp").agg((F.floor(F.sum("shared") / tile) + 1).cast("int").alias("tiles"), F.sum("shared").alias("shared"))
    return groups.join(total, "grp")


def join(docs: DataFrame, ident: str = "doc_id", text: str = "text", n: int = N, tile: int = TILE_COLUMNS) -> DataFrame:
    """(id, n_shingles, component_id) of every document with an id."""
    given = docs.filter(F.col(ident).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(8, int(size // RANGE_BYTES) + 1)
    back = entries(given, ranges, n).groupBy("slot").applyInArrow(shared.lean(columns), ENTRIES + ", bits binary")
    rows = shared.cut(back.groupBy("chunk").applyInArrow(shared.lean(rows_of), ROWS), "rows")
    kept = rows.filter("columns is not null")
    # Equal sets: all their columns are shared, so their sums are known. The smallest id stands for them.
    equal = kept.filter("set1 is not null").groupBy("n", "set1", "set2").agg(F.min("id").alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    same = ["n", "set1", "set2"]
    copies = shared.cut(kept.select("id", *same).join(equal, same).filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), *same), "copies")
    # A text goes if it is a copy, not its id: rows with equal ids may have other texts.
    gone = copies.select(F.col("b").alias("id"), *same).distinct()
    alone = _without(kept, gone, same)
    # The first columns of each row that must hold one in common with every row it links to.
    firsts = shared.cut(alone.select("id", "n", "columns").mapInPandas(shared.tidy(_firsts), "id bigint, column bigint"), "firsts")
    least = firsts.groupBy("column").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a <> z").drop("z")
    hang = firsts.join(least, "column").filter("a <> id").select("a", F.col("id").alias("b")).distinct()
    groups = components(hang, "groups").select("id", F.col("root").alias("grp"))
    places = shared.cut(_places(alone.select("id", "shared"), groups, tile), "places")
    totals = places.select("grp", "tiles", "shared").distinct()
    packs = max(1, int((totals.filter("tiles = 1").agg(F.sum("shared")).first()[0] or 0) // tile) + 1)
    rows_in = shared.sifted(alone.select("id", "n", "shared", "columns"), "id", shared.sieve(places, "id")).join(places.drop("shared"), "id")
    block = F.when(F.col("tiles") == 1, F.struct(F.lit(-1).cast("long").alias("g"), F.pmod(F.xxhash64("grp"), F.lit(packs)).alias("t"))).otherwise(
        F.struct(F.col("grp").alias("g"), F.pmod(F.xxhash64("id"), F.col("tiles").cast("long")).alias("t"))
    )
    one = rows_in.withColumn("block", block).withColumn("label", F.col("id")).withColumn("active", F.lit(True))
    links = shared.cut(one.select("block", "grp", "id", "n", "columns", "label", "active").groupBy("block").applyInPandas(shared.lean(tile_links), "a bigint, b bigint"), "links")
    big = rows_in.filter("tiles > 1")
    if places.filter("tiles > 1").limit(1).count():
        links = links.unionByName(shared.cut(_across(big, links, tile), "links-across"))
    roots = components(links.unionByName(copies.select("a", "b")), "roots")
    # Rows with equal ids are one document: the smallest class that any of them reaches is that of the id.
    per_id = rows.groupBy("id").agg(F.max("n").alias("n_shingles"))
    return per_id.join(roots, "id", "left").select("id", "n_shingles", F.coalesce("root", "id").alias("component_id"))


def _firsts(frames):
    for f in frames:
        ids, cols = [], []
        for i, n, c in zip(f["id"], f["n"], f["columns"], strict=True):
            c = np.frombuffer(c, "<i8")
            lead = c[: max(0, len(c) - int(need(n)) + 1)]
            ids.append(np.full(len(lead), i, np.int64))
            cols.append(lead)
        if ids:
            yield pd.DataFrame({"id": np.concatenate(ids), "column": np.concatenate(cols)})


def _across(big: DataFrame, links: DataFrame, tile: int) -> DataFrame:
    """Links between tiles of groups larger than one: rows outside a group's largest component against all its tiles."""
    labels = components(links, "inner").withColumnRenamed("root", "label")
    placed = big.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    sizes = placed.groupBy("grp", "label").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("grp").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    placed = shared.cut(placed.join(largest, "grp"), "placed")
    rest = placed.filter("label <> main")
    cuts = rest.groupBy("grp").agg((F.floor(F.sum("shared") / tile) + 1).cast("int").alias("cuts"))
    cols = ["block", "grp", "id", "n", "columns", "label", "active"]
    where = lambda t, u: F.struct(F.col("grp").alias("g"), t.alias("t"), u.alias("u"))
    own = F.pmod(F.xxhash64("id"), F.col("tiles").cast("long"))
    side = F.pmod(F.xxhash64("id"), F.col("cuts").cast("long"))
    every = placed.join(cuts, "grp").withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts").cast("long") - 1))).withColumn("block", where(own, F.col("u"))).withColumn("active", F.lit(False))
    some = rest.join(cuts, "grp").withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles").cast("long") - 1))).withColumn("block", where(F.col("t"), side)).withColumn("active", F.lit(True))
    both = some.select(*cols).unionByName(every.select(*cols))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        # A row may be here twice, from either side; the active one stays.
        return tile_links(frame.sort_values("active", ascending=False).drop_duplicates(["id", "n", "columns"]))

    return both.groupBy("block").applyInPandas(shared.lean(run), "a bigint, b bigint")


def keep_first(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest id of each component, all its rows; documents without an id stay."""
    found = join(docs, ident, text)
    drop = found.filter("id <> component_id").select(F.col("id").alias(ident))
    return docs.join(drop, ident, "left_anti").select(*docs.columns)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    return join(shared.read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def brute(rows: list[tuple[int, str | None]], n: int = N) -> list[tuple[int, int, int]]:
    """What op10 must give for rows of distinct ids, from all pairs; for tests."""
    import re

    sets = {}
    for ident, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[ident] = {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= PERCENT * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(sets[i]), find(i)) for i in ids]
