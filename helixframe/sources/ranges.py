"""FASTA and FASTQ files read in byte ranges, so that no task holds a file and a large file spreads over many tasks.

A record belongs to the range in which its header begins. Where a range's first record begins can't be known from the
range alone: a quality may start with @ or >, and records take any number of lines. So each range guesses its first
record by looking ahead, parses on from there, and says where the first record after its end begins. The chain of
these answers, from the start of each file, proves the guesses; a range whose guess was wrong is asked again with the
right start until all of them agree. Numbers of records before each range follow from the same pass. The result is that of
parsing the whole file, whatever the ranges.

Files are opened by the tasks themselves with Arrow's file systems (local and mounted folders, s3://, gs://, hdfs://).
The driver holds a row for each range: where it begins and how many records it has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import scratch

RANGE_BYTES = 64 << 20
CHUNK = 1 << 20
#: Bytes of the first piece read from a place; each is twice as long as the one before, up to CHUNK.
FIRST_CHUNK = 1 << 16
#: Most bytes of the neighbouring ranges that a task goes through, one after another.
TASK_BYTES = 64 << 20
#: Letters of a batch that a task hands to Spark at once, or one longer record.
BATCH_BYTES = 4 << 20
PLAN = "path string, no int, lo long, hi long, first long, base long"
ANSWER = "path string, no int, lo long, hi long, first long, next long, n long"
RECORDS = "path string, r_id int, acc string, seq string, qual string"


def open_file(path: str):
    """A file of any store that Arrow knows, for reading at any place."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", path)
    system, inner = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
    return system.open_input_file(inner)


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path or pattern names."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in system.globStatus(pattern) or []:
        inner = system.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [(s.getPath().toString(), s.getLen()) for s in inner if s.isFile() and s.getPath().getName()[0] not in "._"]
    return sorted(out)


def lines(file, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from a place at which a line begins."""
    file.seek(start)
    at, open_line, size = start, [], min(FIRST_CHUNK, CHUNK)
    while chunk := file.read(size):
        size = min(2 * size, CHUNK)
        parts = chunk.split(b"\n")
        open_line.append(parts[0])
        for part in parts[1:]:
            line = b"".join(open_line)
            yield at, line
            at += len(line) + 1
            open_line = [part]
    if last := b"".join(open_line):
        yield at, last


def lines_after(file, lo: int) -> Iterator[tuple[int, bytes]]:
    """Lines that begin at lo or later."""
    found = lines(file, max(lo - 1, 0))
    if lo:
        next(found, None)
    return found


def _width(line: bytes) -> int:
    return len(line) if line.isascii() else len(line.decode("utf-8", "replace"))


def records(found: Iterator[tuple[int, bytes]], stop: int, after: list) -> Iterator[tuple[str, str, str | None]]:
    """(header, sequence, quality) of records that begin before stop; where the next one begins, if any, is left in `after`.

    A quality goes on until it is as long as the sequence, whatever its lines begin with.
    """
    header, seq, qual, want, have, in_quality = None, [], [], 0, 0, False

    def record():
        text, quality = (b"".join(x).decode("utf-8", "replace") for x in (seq, qual))
        return header.decode("utf-8", "replace").replace(" ", "_"), text, quality if in_quality and have >= want else None

    for at, line in found:
        line = line.rstrip(b"\r\n")
        if in_quality and have < want:
            qual.append(line)
            have += _width(line)
        elif line[:1] in (b">", b"@") and line:
            if header is not None:
                yield record()
            if at >= stop:
                after.append(at)
                return
            header, seq, qual, want, have, in_quality = line[1:], [], [], 0, 0, False
        elif line[:1] == b"+" and header is not None:
            in_quality = True
        elif header is not None:
            seq.append(line)
            want += _width(line)
    if header is not None:
        yield record()


def _fasta(file) -> bool:
    for _, line in lines(file, 0):
        if line[:1] in (b">", b"@") and line:
            return line[:1] == b">"
    return True


def _plausible(file, at: int) -> bool:
    """Whether a FASTQ record may begin here: letters, a + line, as many qualities, then another header or the end."""
    found = lines(file, at)
    next(found)
    want = have = 0
    for _, line in found:
        line = line.rstrip(b"\r\n")
        if line[:1] == b"+":
            break
        if line[:1] in (b"@", b">") and line:
            return False
        want += _width(line)
    for _, line in found:
        line = line.rstrip(b"\r\n")
        if have >= want:
            return not line or line[:1] in (b"@", b">")
        have += _width(line)
    return have <= want


def guess(file, lo: int, hi: int) -> int | None:
    """Where the first record of a range seems to begin."""
    fasta = _fasta(file)
    for at, line in lines_after(file, lo):
        if at >= hi:
            return None
        if line[:1] == b">" and fasta:
            return at
        if line[:1] in (b"@", b">") and line and not fasta:
            with open_file(file.path) as other:
                if _plausible(other, at):
                    return at
    return None


class _File:
    """An open file that knows its path."""

    def __init__(self, path: str):
        self.path, self.file = path, open_file(path)
        self.seek, self.read, self.size = self.file.seek, self.file.read, self.file.size

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def records4(file, lo: int, hi: int, before: int) -> Iterator[list[bytes]]:
    """Groups of four lines that begin in a range with so many lines before it; an incomplete last one is left out."""
    found, group = lines_after(file, lo), []
    for _ in range(-before % 4):
        next(found, None)
    for at, line in found:
        if not group and at >= hi:
            return
        group.append(line)
        if len(group) == 4:
            yield group
            group = []
    if len(group) == 3:  # a last line that is empty
        file.seek(file.size() - 1)
        if file.read(1) == b"\n":
            yield [*group, b""]


@dataclass
class Range(InputPartition):
    path: str
    no: int
    lo: int
    hi: int
    first: int | None
    base: int


@dataclass
class Ranges(InputPartition):
    """The ranges of one task."""

    parts: list[Range]


def packed(parts: list[Range], tasks: int, most: int) -> list[Ranges]:
    """Neighbouring ranges for each task, of even sizes: `tasks` of them, or more where those would have over `most` bytes."""
    share = min(most, -(-sum(p.hi - p.lo for p in parts) // tasks))
    out: list[Ranges] = []
    size = share
    for part in parts:
        if size + part.hi - part.lo > share:
            out.append(Ranges([]))
            size = 0
        out[-1].parts.append(part)
        size += part.hi - part.lo
    return out


def first_header(file) -> int | None:
    """Where a file's first record begins."""
    return next((at for at, line in lines(file, 0) if line[:1] in (b">", b"@") and line), None)


def answer(part: Range) -> tuple:
    """A row of ANSWER: first and next are null where nothing begins in the range and it can't tell; next is -1 at the end of the file."""
    with _File(part.path) as file:
        first = part.first
        if first is None:
            first = first_header(file) if part.no == 0 else guess(file, part.lo, part.hi)
        if first is None or first >= part.hi:
            return part.path, part.no, part.lo, part.hi, None, (-1 if first is None else first) if part.no == 0 else None, 0
        after: list[int] = []
        n = sum(1 for _ in records(lines(file, first), part.hi, after))
        return part.path, part.no, part.lo, part.hi, first, after[0] if after else -1, n


class SequenceSource(DataSource):
    """Format helix_sequences. Options: plan, a Parquet table of ranges, tasks, into how many they are packed at least, and emit: answers, records, lines (counts of them) or records4."""

    @classmethod
    def name(cls) -> str:
        return "helix_sequences"

    def schema(self) -> str:
        return ANSWER if self.options.get("emit") in ("answers", "lines") else RECORDS

    def reader(self, schema) -> DataSourceReader:
        return SequenceReader(self.options)


class SequenceReader(DataSourceReader):
    def __init__(self, options):
        self.plan, self.emit, self.tasks = options["plan"], options.get("emit", "records"), int(options.get("tasks", "1"))

    def partitions(self) -> list[Ranges]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        uri = re.sub(r"^file:/+", "file:///", self.plan)
        system, inner = fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
        return packed([Range(**row) for row in pq.read_table(inner, filesystem=system).to_pylist()], self.tasks, TASK_BYTES)

    def read(self, several: Ranges):
        for part in several.parts:
            yield from self.of_range(part)

    def of_range(self, part: Range):
        if self.emit == "answers":
            yield answer(part)
            return
        with _File(part.path) as file:
            if self.emit == "lines":
                n = 0
                for at, _ in lines_after(file, part.lo):
                    if at >= part.hi:
                        break
                    n += 1
                yield part.path, part.no, part.lo, part.hi, None, None, n
                return
            if self.emit == "records":
                found, start = records(lines(file, part.first), part.hi, []), part.base + 1
            else:
                text = lambda x: x.decode("utf-8", "replace")
                found = ((text(h)[1:].replace(" ", "_"), text(s), text(q)) for h, s, _, q in records4(file, part.lo, part.hi, part.base))
                start = -(-part.base // 4) + 1
            rows, size = [], 0
            for i, (acc, seq, qual) in enumerate(found, start):
                rows.append((part.path, i, acc, seq, qual))
                size += 2 * len(seq) + 100
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
    names = [c.split()[0] for c in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _load(spark: SparkSession, plan: list[tuple], emit: str) -> DataFrame:
    spark.dataSource.register(SequenceSource)
    path = scratch(spark, "ranges")
    spark.createDataFrame(plan, PLAN).coalesce(1).write.parquet(path)
    tasks = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format("helix_sequences").option("plan", path).option("emit", emit).option("tasks", tasks).load()


def _settled(rows: list[dict]) -> tuple[list[dict], dict | None]:
    """A file's answers up to the first that the chain contradicts, and that range with its right start."""
    due = None
    for i, row in enumerate(rows):
        if row["no"] == 0:
            due = row["next"] if row["next"] is not None else -1
            continue
        begins = due != -1 and row["lo"] <= due < row["hi"]
        if not begins:
            row.update(first=None, next=None, n=0)
        elif row["first"] == due:
            due = row["next"]
        else:
            return rows[:i], {**row, "first": due}
    return rows, None


def index(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> pd.DataFrame:
    """path, no, lo, hi, first, n of all ranges in which records begin, proven by the chain; base: records before them in the file."""
    plan = [(p, i, lo, min(lo + range_bytes, size), None, 0) for p, size in files for i, lo in enumerate(range(0, size, range_bytes))]
    known: dict[str, list[dict]] = {}
    while plan:
        found: dict[tuple, dict] = {(r["path"], r["no"]): r.asDict() for r in _load(spark, plan, "answers").collect()}
        for (path, no), row in sorted(found.items()):
            rows = known.setdefault(path, [])
            if no < len(rows):
                rows[no] = row
            else:
                rows.append(row)
        plan = []
        for path in {p for p, _ in found}:
            wrong = _settled(known[path])[1]
            if wrong:
                plan.append((path, wrong["no"], wrong["lo"], wrong["hi"], wrong["first"], 0))
    columns = ["path", "no", "lo", "hi", "first", "base", "n"]
    out = []
    for rows in known.values():
        base = 0
        for row in rows:
            if row["n"]:
                out.append((row["path"], row["no"], row["lo"], row["hi"], row["first"], base, row["n"]))
            base += row["n"]
    return pd.DataFrame(out, columns=columns)


def read_records(spark: SparkSession, path: str | list[tuple[str, int]], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, r_id (from 1 within a file), acc (spaces as _), seq, qual of FASTA or FASTQ files, in ranges of range_bytes.

    path: a path or pattern, or (path, bytes) of the files.
    """
    ranges = index(spark, list_files(spark, path) if isinstance(path, str) else path, range_bytes)
    if ranges.empty:
        return spark.createDataFrame([], RECORDS)
    plan = [tuple(None if pd.isna(v) else v for v in row) for row in ranges.drop(columns="n").itertuples(index=False)]
    return _load(spark, plan, "records")


def read_records4(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same columns of strict four-line FASTQ, by line numbers alone: lines are counted in all ranges, then each reads the records that begin in it."""
    ranges = [(p, i, lo, min(lo + range_bytes, size), None, 0) for p, size in list_files(spark, path) for i, lo in enumerate(range(0, size, range_bytes))]
    if not ranges:
        return spark.createDataFrame([], RECORDS)
    counts = {(r["path"], r["no"]): r["n"] for r in _load(spark, ranges, "lines").collect()}
    plan, base = [], 0
    for p, i, lo, hi, first, _ in ranges:
        base = base if i else 0
        plan.append((p, i, lo, hi, first, base))
        base += counts[p, i]
    return _load(spark, plan, "records4")
