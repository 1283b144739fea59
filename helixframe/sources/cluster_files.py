"""Corrected reads as one file for each cluster, committed as a whole.

Reads are range-partitioned by cluster, batch and number, so a large cluster is written by many tasks. A task attempt
writes the pieces of its clusters into a folder of its own below a staging folder and reports them when it is done;
attempts that fail or are run twice report nothing or are not taken up. The commit writes the list of reported pieces.
Then the pieces of each cluster are put together, in order, as tasks of a second job, and each file gets its name when it is complete:
a file with its final name is whole. At the end, whatever happened, the staging folder goes.

Files lie at <folder>/<cluster>/corrected_reads.fastq. A cluster that has such a file is kept or written anew as `replace` says.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FILE = "corrected_reads.fastq"
COPY = 4 << 20


def _store(folder: str):
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", folder)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt wrote: (cluster, first batch key, first number, path, records)."""

    pieces: list[tuple[str, str, int, str, int]]


class ClusterFiles(DataSource):
    """Format helix_clusters: rows (cluster, batch, r_id, record), sorted within tasks, into pieces and a list of them."""

    @classmethod
    def name(cls) -> str:
        return "helix_clusters"

    def writer(self, schema, overwrite: bool) -> ClusterWriter:
        return ClusterWriter(self.options["staging"])


class ClusterWriter(DataSourceArrowWriter):
    def __init__(self, staging: str):
        self.staging = staging

    def write(self, iterator) -> Written:
        system, inner = _store(self.staging)
        attempt = f"{inner}/{uuid.uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        pieces, open_piece, stream = [], None, None
        for batch in iterator:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for cluster, key, number, record in rows:
                if open_piece is None or open_piece[0] != cluster:
                    if stream:
                        stream.close()
                    open_piece = [cluster, key, number, f"{attempt}/{len(pieces)}", 0]
                    pieces.append(open_piece)
                    stream = system.open_output_stream(open_piece[3])
                stream.write(record.encode())
                open_piece[4] += 1
        if stream:
            stream.close()
        return Written([tuple(p) for p in pieces])

    def commit(self, messages) -> None:
        """The list of pieces, under its name only when it is complete."""
        system, inner = _store(self.staging)
        with system.open_output_stream(f"{inner}/pieces.part") as out:
            for message in messages:
                for piece in message.pieces if message else []:
                    out.write((json.dumps(piece) + "\n").encode())
        system.move(f"{inner}/pieces.part", f"{inner}/pieces")

    def abort(self, messages) -> None:
        system, inner = _store(self.staging)
        system.delete_dir_contents(inner, missing_dir_ok=True)


def _join(folder: str):
    """Puts the pieces of clusters together: one file each, renamed when whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = _store(folder)
        for frame in frames:
            done = []
            for cluster, pieces in zip(frame["cluster"], frame["pieces"], strict=True):
                target = f"{inner}/{quote(cluster, safe='')}"
                part = f"{target}/.{FILE}-{uuid.uuid4().hex}"
                system.create_dir(target, recursive=True)
                records = 0
                try:
                    with system.open_output_stream(part) as out:
                        for piece in pieces:
                            records += piece["records"]
                            with system.open_input_stream(piece["path"]) as source:
                                while data := source.read(COPY):
                                    out.write(data)
                    system.move(part, f"{target}/{FILE}")
                except BaseException:
                    if system.get_file_info(part).is_file:
                        system.delete_file(part)
                    raise
                done.append((cluster, records, len(pieces)))
            yield pd.DataFrame(done, columns=["cluster", "records", "pieces"])

    return run


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """(cluster, records) of the files that a folder holds; files are read in ranges."""
    from .ranges import list_files, read_records4

    if not list_files(spark, f"{folder}/*/{FILE}"):
        return spark.createDataFrame([], "cluster string, records long")
    name = F.url_decode(F.regexp_extract("path", rf"([^/]+)/{FILE}$", 1))
    return read_records4(spark, f"{folder}/*/{FILE}").groupBy(name.alias("cluster")).agg(F.count("*").alias("records"))


def write_clusters(reads: DataFrame, folder: str, by_name: int = 0, replace: bool = True, tasks: int | None = None) -> DataFrame:
    """One FASTQ file for each cluster of reads (cluster_id, r_id, acc, seq, qual); (cluster, records, pieces) of what was written.

    Reads follow in the order of r_id; with by_name, the size of a batch, in the order of the batches' numbers as text.
    With replace off, clusters stay as they are whose file has as many records as they have reads: a restarted run does what is missing.
    A null cluster is named `null`; reads without a sequence or qualities have empty lines.
    """
    from .sequence_files import fastq_record

    spark = reads.sparkSession
    cluster = F.coalesce(F.col("cluster_id").cast("string"), F.lit("null"))
    batch = F.floor((F.col("r_id") - 1) / by_name).cast("string") if by_name else F.lit("")
    text = F.concat(fastq_record(*[F.coalesce(F.col(c), F.lit("")) for c in ("acc", "seq", "qual")]), F.lit("\n"))
    rows = reads.select(cluster.alias("cluster"), batch.alias("batch"), F.col("r_id").cast("long").alias("r_id"), text.alias("record"))
    if not replace:
        same = rows.groupBy("cluster").agg(F.count("*").alias("records")).join(finished(spark, folder), ["cluster", "records"])
        rows = rows.join(same.select("cluster"), "cluster", "left_anti")
    order = ["cluster", "batch", "r_id"]
    n = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    staging = f"{folder.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    system, inner = _store(staging)
    system.create_dir(inner, recursive=True)
    try:
        spark.dataSource.register(ClusterFiles)
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        dealt.write.format("helix_clusters").option("staging", staging).mode("append").save()
        pieces = spark.read.schema("value string").text(f"{staging}/pieces").select(F.from_json("value", "array<string>").alias("p"))
        piece = F.struct(F.get("p", F.lit(1)).alias("batch"), F.get("p", F.lit(2)).cast("long").alias("r_id"), F.get("p", F.lit(3)).alias("path"), F.get("p", F.lit(4)).cast("long").alias("records"))
        clusters = pieces.groupBy(F.get("p", F.lit(0)).alias("cluster")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
        written = clusters.mapInPandas(_join(folder), "cluster string, records long, pieces int").toPandas()
    finally:
        system.delete_dir(inner)
    return spark.createDataFrame(written, "cluster string, records long, pieces int")
