"""What several operators here need: the folder all executors share, cutting lineage, byte-level tokenising."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Bits of a sieve: 8 MB in all, whatever the size of the table.
SIEVE_BITS = 26


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where a single local process runs, as in tests."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="helixframe-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def run_dir(spark: SparkSession) -> str:
    """The folder of everything that this application writes; discard() removes it when its results have been used."""
    return f"{shared_dir(spark)}/helixframe-{spark.conf.get('spark.app.id', 'local')}"


def discard(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. DataFrames that read them can't be used any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for one table of one run."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df where every executor can read it and return it read back: lineage ends here.

    A lost executor costs only the tasks that were running; what was written stays.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sieve(df: DataFrame, column: str) -> DataFrame:
    """A bitmap of hashes of a column, of bounded size, as (bucket, bitmap: 64 numbers of 64 bits): for sifted().

    What is shuffled are numbers, not bitmaps; at most 16384 rows are left at the end.
    """
    at = F.pmod(F.xxhash64(column), F.lit(1 << SIEVE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    numbers = df.select(F.shiftright(at, 12).alias("bucket"), F.shiftright(at, 6).bitwiseAND(63).cast("int").alias("n"), bit.alias("bit")).groupBy("bucket", "n").agg(F.bit_or("bit").alias("bits"))
    held = F.map_from_entries(F.collect_list(F.struct("n", "bits")))
    whole = numbers.groupBy("bucket").agg(held.alias("held"))
    return whole.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda n: F.coalesce(F.try_element_at("held", n), F.lit(0).cast("long"))).alias("bitmap"))


def sifted(df: DataFrame, column: str, marks: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of df whose value may be in the sieve: all that are stay, what else stays costs only time. Or the others, which certainly aren't."""
    at = F.pmod(F.xxhash64(column), F.lit(1 << SIEVE_BITS))
    names = fresh(df.columns, "bucket", "bitmap")
    number = F.get(F.col(names[1]), F.shiftright(at, 6).bitwiseAND(63).cast("int"))
    there = F.coalesce(F.call_function("shiftright", number, at.bitwiseAND(63).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(False))
    joined = df.join(F.broadcast(marks.toDF(*names)), F.shiftright(at, 12) == F.col(names[0]), "inner" if inside else "left")
    return joined.filter(there if inside else ~there).select(*columns(df))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Names like these that no column has, whatever the case of its letters."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """The columns of df by name, whatever signs the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def tidy(run):
    """A function over batches that gives freed memory back at its end, as workers are kept for later stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def lean(run):
    """A function of one group that gives freed memory back when it is done."""

    def wrapped(group):
        out = run(group)
        release()
        return out

    return wrapped


def release() -> None:
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MUL = np.uint64(0x9E3779B97F4A7C15)
_POLY = 0x100000001B3


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the odd multiplier modulo 2**64, and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> np.ndarray:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            more = np.full(size, _POLY, np.uint64)
            more[0] = 1
            cls.up = np.multiply.accumulate(more)
        return cls.up


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a byte string, with their start and end offsets.

    Words are runs of bytes other than space, \\t, \\n, \\v, \\f and \\r. One pass of array operations,
    no loop over words: the hash of a word is the sum of its bytes times powers that count from its start.
    """
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    lengths = ends - starts
    inside = np.flatnonzero(~space)
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(inside), dtype=np.int64) - np.repeat(first, lengths)
    powers = Powers.get(int(lengths.max()) + 1)
    values = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[at]
    sums = np.add.reduceat(values, first)
    return mix64(sums + lengths.astype(np.uint64) * _MUL), starts, ends


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased; bytes of other characters stay."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one array with a newline after each, and the offset at which each starts (one more at the end)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.empty(0, np.uint8)
    return data, offsets


def ranges(sizes, most: int):
    """Ranges (from, to) of rows that hold at most `most` bytes each, or one longer row."""
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def pieces(texts, most: int = 2_000_000):
    """Ranges (from, to) of a list of byte strings of at most `most` bytes each, or of one longer text."""
    return ranges([len(t) if t is not None else 0 for t in texts], most)


def slices(batch, column: int, most: int = 4_000_000):
    """An Arrow batch in parts that hold at most `most` bytes of a text or binary column, or one longer row; nothing is copied."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in ranges(sizes, most):
        yield batch.slice(a, b - a)


def utf8(column) -> list[bytes]:
    """An Arrow string column as UTF-8 byte strings; null as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def arrays(column, kind) -> list[np.ndarray]:
    """The values of an Arrow binary column as arrays that share its memory; null as empty."""
    return [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.empty(0, kind) for x in column]
