"""Line dedup by a segment-partition edit join; DataFrame functions only.

Lines are the pieces of a text between line feeds, trimmed; blank ones don't count. Equal lines are one. Two
lines are near duplicates when they are few edits apart: one for every PER characters of the shorter one, at most EDITS. So
lines below PER characters are duplicates only when equal.

A line of length l is split into EDITS + 1 segments; with at most EDITS edits one of them stands unchanged in the
other line, at a place that its index and the difference of the lengths bound. So each line has an index
key (length, number, segment) for each segment, and probes the keys of lines as long as itself or up to
EDITS shorter with the substrings at just those places. Keys are counted first; only lines of keys that several lines
have are looked at again, found by a bitmap of bounded size.

Lines that meet at a key are discarded when the parities of their characters, or of their neighbouring characters, differ in
more places than edits can explain, and else verified by a banded bit-parallel computation of the distance (a band of 2 * EDITS + 1 diagonals as
bits of one number, a step for each character).

A key's lines are first held against two representatives, the owners with the smallest and the largest hash, so a group
of m near lines takes about m comparisons and links. What these links leave apart is compared pair by pair: at each
key the lines outside its largest class so far against all others of other classes, in slots of at most PAIRS pairs, so
a hot key is spread. Nothing is left out. Classes are connected components; the first line of a class by (doc_id, line
number) stays.

Defined cases: null and empty texts have no lines; rows with equal ids pool their lines in the counts of the query; rows without an id are not
compared (dedup() leaves them as they are); lines are told apart by a 64-bit hash; an empty table gives no rows; other
columns are carried by dedup(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from .graph import components

EDITS = 2
PER = 8
PAIRS = 1_000_000


def lines(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """id, line_no, line, h: trimmed lines that aren't blank."""
    rows = docs.filter(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim("line")).filter("line <> ''").withColumn("h", F.xxhash64("line"))


def _segment(length: Column, i: Column, edits: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment i of 0 to edits; the last ones take what doesn't divide."""
    parts = edits + 1
    base, extra = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    longer = F.greatest(F.lit(0), i - (F.lit(parts) - extra))
    return base * i + longer + 1, base + (i >= F.lit(parts) - extra).cast("int")


def keyed(rows: DataFrame, edits: int, per: int) -> DataFrame:
    """(h, key): keys of lines (h, line, len), none where the other line would be too short; the lowest bit is set in those of a line's own segments, which are probes as well.

    Places are exploded first and a key is made for each row: an expression of all keys of a line is too long for the JVM to compile.
    """
    places = [(delta, i, shift) for delta in range(edits + 1) for i in range(edits + 1) for shift in range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1)]
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("delta", "i", "shift"), place, strict=True)]) for place in places]))
    short = F.col("len") - F.col("p.delta")
    wide = rows.select("h", "line", "len", each.alias("p")).filter(short >= F.lit(per) * F.greatest(F.lit(1), F.col("p.delta")))
    start, size = _segment(short, F.col("p.i"), edits)
    key = F.xxhash64(short.cast("int"), F.col("p.i"), F.substring(F.col("line"), start + F.col("p.shift"), size))
    own = ((F.col("p.delta") == 0) & (F.col("p.shift") == 0)).cast("long")
    return wide.select("h", key.bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(own).alias("key"))


def parities(line: str) -> Column:
    """One bit for each of 64 groups of characters: whether the line holds an odd number of them. An edit changes two at most."""
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64)))


def pair_parities(line: str) -> Column:
    """The same of neighbouring characters in 64 groups by hash, the last one with none. An edit changes four bits at most."""
    return F.get(F.transform(F.array(F.split(line, "")), lambda c: F.aggregate(
        F.zip_with(c, F.slice(c, 2, F.size(c)), lambda x, y: F.pmod(F.hash(x, F.coalesce(y, F.lit(""))), F.lit(64))), F.lit(0).cast("long"),
        lambda acc, at: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), at)))), F.lit(0))


def bit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is at most edits, else a larger number.

    Bit k of a state stands for diagonal k - edits of the band; level e holds the diagonals that e edits reach
    after each character of a. Levels are numbers in one struct, so a step is a few bit operations. Character arrays
    and the masks of equal characters are bound to lambda variables, hence made once.
    """
    width, full = 2 * edits + 1, (1 << (2 * edits + 1)) - 1

    def step(acc: Column, mask: Column) -> Column:
        made: list[Column] = []
        for e in range(edits + 1):
            now = acc[f"l{e}"].bitwiseAND(mask)
            if e:
                below = acc[f"l{e - 1}"]
                # Substitution stays on the diagonal; a character of a is skipped one diagonal down, one of b one up.
                now = now.bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)).bitwiseOR(F.shiftleft(made[-1], 1).bitwiseAND(full))
            made.append(now)
        return F.struct(*[m.alias(f"l{e}") for e, m in enumerate(made)])

    first = [1 << edits]
    for _ in range(edits):
        first.append((first[-1] | first[-1] << 1) & full)
    start = F.struct(*[F.lit(v).alias(f"l{e}") for e, v in enumerate(first)])

    def masks(x: Column, y: Column) -> Column:
        """For each character i of x: bit k where it equals character i + k - edits of y."""
        one = lambda c, i, k: F.when(c == F.get(y, i + F.lit(k - edits)), F.lit(1 << k)).otherwise(F.lit(0))
        return F.transform(x, lambda c, i: sum((one(c, i, k) for k in range(1, width)), one(c, i, 0)))

    def of(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        last = F.call_function("shiftleft", F.lit(1), F.size(y) - F.size(x) + edits)
        best = lambda acc: F.coalesce(*[F.when(acc[f"l{e}"].bitwiseAND(last) != 0, F.lit(e)) for e in range(edits + 1)], F.lit(edits + 1))
        return F.when(F.abs(F.size(x) - F.size(y)) > edits, F.lit(edits + 1)).otherwise(F.aggregate(masks(x, y), start, step, best))

    return F.get(F.transform(F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y"))), of), F.lit(0))


def _budget(short: Column, edits: int, per: int) -> Column:
    return F.least(F.lit(edits), F.floor(short / per).cast("int"))


def _verified(pairs: DataFrame, texts: DataFrame, edits: int, per: int) -> DataFrame:
    """The pairs (a, b) of lines that are within their budget."""
    thin = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    full = thin.join(texts.select(F.col("h").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("lb")), "b")
    near = bit_distance(F.col("la"), F.col("lb"), edits) <= _budget(F.least(F.length("la"), F.length("lb")), edits, per)
    return full.filter(near).select("a", "b")


def links(docs: DataFrame, ident: str = "doc_id", text: str = "text", edits: int = EDITS, per: int = PER, pairs: int = PAIRS) -> DataFrame:
    """(a, b): hashes of distinct lines that are near; enough of them to connect all that are."""
    if per <= edits:
        raise ValueError("every segment needs a character")
    sized = lines(docs, ident, text).withColumn("len", F.length("line")).filter(F.col("len") >= per)
    # Making keys costs far more than reading them, and they are read twice.
    rows = shared.cut(keyed(sized, edits, per), "line-keys", "none")
    rows = rows.select("h", F.col("key").bitwiseAND(F.lit(-2).cast("long")).alias("k"), (F.col("key").bitwiseAND(F.lit(1).cast("long")) == 1).alias("own"))
    shares = rows.groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("own").alias("any")).filter("lo <> hi and any").select("k")
    shares = shared.cut(shares, "met-keys")
    found = shared.sifted(rows, "k", shared.sieve(shares, "k")).groupBy("k", "h").agg(F.max("own").alias("own"))
    found = shared.cut(found.join(shares, "k", "left_semi"), "met-rows")
    texts = shared.sifted(sized.select("h", "line"), "h", shared.sieve(found, "h")).dropDuplicates(["h"])
    texts = shared.cut(texts.select("h", "line", F.length("line").alias("len"), parities("line").alias("sig"), pair_parities("line").alias("sig2")), "met-lines")
    met = shared.cut(found.join(texts.select("h", "len", "sig", "sig2"), "h"), "met")

    def may(a: str, b: str) -> Column:
        differ = lambda c: F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")))
        return (differ("sig") <= 2 * edits) & (differ("sig2") <= 4 * edits) & (F.abs(F.col(f"{a}.len") - F.col(f"{b}.len")) <= edits)

    owner = F.struct("h", "len", "sig", "sig2")
    heads = met.filter("own").groupBy("k").agg(F.array_distinct(F.array(F.min(owner), F.max(owner))).alias("r")).select("k", F.explode("r").alias("r"))
    with_heads = met.select("k", F.struct("h", "len", "sig", "sig2").alias("m")).join(heads, "k").filter((F.col("m.h") != F.col("r.h")) & may("m", "r"))
    first = shared.cut(_verified(with_heads.select(F.col("m.h").alias("a"), F.col("r.h").alias("b")), texts, edits, per), "line-links-1")
    labels = components(first, "lines-1").select(F.col("id").alias("h"), F.col("root").alias("label"))
    placed = met.join(labels, "h", "left").withColumn("label", F.coalesce("label", "h"))
    counted = placed.groupBy("k", "label").agg(F.count("*").alias("m"))
    main = counted.groupBy("k").agg(F.max_by("label", F.struct("m", "label")).alias("main"), F.sum("m").alias("n"), F.max("m").alias("most")).filter("n > most")
    slots = F.least(F.col("n") - F.col("most"), F.ceil((F.col("n") - F.col("most")) * F.col("n") / pairs))
    open_ = shared.cut(placed.join(main.select("k", "main", slots.alias("slots")), "k"), "line-rest")
    rest = open_.filter("label <> main").select("k", F.pmod(F.xxhash64("h"), "slots").alias("slot"), F.struct("h", "len", "sig", "sig2", "label", "own").alias("a"))
    every = open_.select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), F.struct("h", "len", "sig", "sig2", "label", "own").alias("b"))
    left = rest.join(every, ["k", "slot"]).filter((F.col("a.label") != F.col("b.label")) & (F.col("a.own") | F.col("b.own")) & may("a", "b"))
    return first.unionByName(_verified(left.select(F.col("a.h").alias("a"), F.col("b.h").alias("b")), texts, edits, per))


def classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", **settings) -> tuple[DataFrame, DataFrame]:
    """(distinct lines: h, first (id, line_no), places, class; roots of classes that hold near duplicates)."""
    roots = components(shared.cut(links(docs, ident, text, **settings), "line-links"), "lines").select(F.col("id").alias("h"), "root")
    seen = lines(docs, ident, text).groupBy("h").agg(F.min(F.struct("id", "line_no")).alias("first"), F.count("*").alias("places"))
    seen = shared.cut(seen.join(roots, "h", "left").select("h", "first", "places", F.coalesce("root", "h").alias("class")), "distinct-lines")
    return seen, roots


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """docs with only the first line of each class left in the texts; blank lines stay, all columns too.

    Rows with equal ids are told apart by their texts' order, so a repeated row loses what the one before it has.
    """
    names = shared.fresh(docs.columns, "row", "id")
    order = Window.partitionBy(F.col(ident)).orderBy(F.xxhash64(text), F.col(text))
    own = F.when(F.col(ident).isNotNull(), F.struct(F.col(ident).alias("id"), F.row_number().over(order).alias("nth")))
    rows = docs.select(F.struct(*shared.columns(docs)).alias(names[0]), own.alias(names[1]), F.col(text).alias("text"))
    seen, _ = classes(rows.select(F.col(names[1]).alias("id"), "text"), "id", "text", **settings)
    stay = seen.groupBy("class").agg(F.min("first").alias("f")).groupBy(F.col("f.id").alias("keeper")).agg(F.collect_set("f.line_no").alias("stay"))
    joined = rows.drop("text").join(stay, F.col(names[1]) == F.col("keeper"), "left")
    left = F.filter(F.split(F.col(f"{names[0]}.`{text}`"), "\n"), lambda x, i: (F.trim(x) == "") | F.coalesce(F.array_contains("stay", i), F.lit(False)))
    rebuilt = F.when(F.col(names[1]).isNull(), F.col(f"{names[0]}.`{text}`")).otherwise(F.array_join(left, "\n")).alias(text)
    return joined.select(*[rebuilt if c == text else F.col(f"{names[0]}.`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what dedup() leaves of its text: doc_id, text."""
    return dedup(shared.read(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_new (not equal to an earlier line), n_kept (nor near one's class), copies_of (documents that keep its dropped lines)."""
    docs = shared.read(spark, sf_dir, "documents").select("doc_id", "text")
    seen, _ = classes(docs)
    total = lines(docs).groupBy("id").agg(F.count("*").alias("n_lines"))
    new = seen.groupBy(F.col("first.id").alias("id")).agg(F.count("*").alias("n_new"))
    whole = shared.cut(seen.groupBy("class").agg(F.min("first").alias("f"), F.sum("places").alias("places")), "line-classes")
    kept = whole.groupBy(F.col("f.id").alias("id")).agg(F.count("*").alias("n_kept"))
    several = shared.cut(seen.select("h", "class").join(whole.filter("places > 1").select("class", F.col("f.id").alias("of")), "class").select("h", "of"), "line-copies")
    held = shared.sifted(lines(docs).select("id", "h"), "h", shared.sieve(several, "h")).distinct()
    copies = held.join(several, "h").filter("id <> of").groupBy("id").agg(F.array_sort(F.collect_set("of")).alias("copies_of"))
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    out = ids.join(total, "id", "left").join(new, "id", "left").join(kept, "id", "left").join(copies, "id", "left").fillna(0)
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_new", "n_kept", F.coalesce("copies_of", F.array().cast("array<bigint>")).alias("copies_of"))


def brute(rows: list[tuple[int, str | None]], edits: int = EDITS, per: int = PER) -> list[tuple[int, int, int, int, list[int]]]:
    """What op1 must give for rows of distinct ids, from all pairs of lines; for tests."""
    found = [(ident, n, line.strip(" ")) for ident, text in rows for n, line in enumerate((text or "").split("\n")) if line.strip(" ")]
    distinct = list(dict.fromkeys(x[2] for x in sorted(found)))
    root = {x: x for x in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1] <= min(edits, min(len(a), len(b)) // per)

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if abs(len(a) - len(b)) <= edits and find(a) != find(b) and near(a, b):
                root[find(b)] = find(a)
    equal, keepers, out = set(), {}, {ident: [0, 0, 0, set()] for ident, _ in rows}
    for ident, _, line in sorted(found):
        out[ident][0] += 1
        out[ident][1] += line not in equal
        out[ident][2] += find(line) not in keepers
        equal.add(line)
        of = keepers.setdefault(find(line), ident)
        out[ident][3] |= {of} - {ident}
    return [(i, *v[:3], sorted(v[3])) for i, v in sorted(out.items())]
