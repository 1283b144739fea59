"""Structured Streaming over cluster files, clusters that grow, and result events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.correction import correct, correct_batch
from ..operators.seeds import with_batches
from ..plans.params import Params
from ..sources.ranges import read_records


def correct_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, params: Params = Params()) -> StreamingQuery:  # noqa: B008
    """Correct cluster files as they arrive; a file is corrected once, as a cluster of its own.

    The stream is of names and sizes; a batch reads its files in byte ranges.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).load(f"{folder.rstrip('/')}/*.fastq").select("path", "length")

    def batch(df: DataFrame, n: int) -> None:
        new = sorted((r["path"], r["length"]) for r in df.collect())
        reads = read_records(df.sparkSession, new).withColumn("cluster_id", F.regexp_extract("path", "([^/]+)$", 1))
        correct(reads, params).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def correct_growing(reads: DataFrame, params: Params = Params(), wait: str = "10 minutes") -> DataFrame:  # noqa: B008
    """Corrected reads of clusters that grow over many files: a stream of (cluster_id, r_id, acc, seq, qual) in, one of corrected reads out.

    A batch of a cluster, by the numbers of its reads, is kept as state until all its reads have come, whatever files and
    triggers they came with, and is corrected then, as correct() does with the whole cluster. One that hasn't got a read for
    `wait`, as the last one of a cluster, is corrected as it is. A read that comes twice counts once; one that comes after
    its batch was corrected is the first of a new one. A lost executor or a restart goes on from the checkpointed state.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    if params.exact_limit:
        raise ValueError("the size of a growing cluster isn't known: exact_limit can't be used")
    kind = reads.schema["cluster_id"].dataType.simpleString()
    columns = ("r_id", "acc", "seq", "qual")
    milliseconds = int(pd.Timedelta(wait).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(columns, state.get, strict=True)) if state.exists else {c: [] for c in columns}
        known = set(held["r_id"])
        if not state.hasTimedOut:
            for frame in frames:
                for row in frame[list(columns)].itertuples(index=False):
                    if row.r_id not in known:
                        known.add(row.r_id)
                        for c, value in zip(columns, row, strict=True):
                            held[c].append(int(value) if c == "r_id" else value if isinstance(value, str) else None)
            if len(known) < params.batch_size:
                state.update(tuple(held[c] for c in columns))
                state.setTimeoutDuration(milliseconds)
                return
        if state.exists:
            state.remove()
        rows = pd.DataFrame(held).sort_values("r_id")
        given = rows[rows["seq"].notna()]
        done = dict(correct_batch(given["r_id"].tolist(), given["seq"].tolist(), [q if isinstance(q, str) else None for q in given["qual"]], params, params.exact))
        seqs = [done.get(r) for r in rows["r_id"]]
        yield pd.DataFrame({"cluster_id": key[0], "r_id": rows["r_id"].astype("int32"), "acc": rows["acc"], "seq": seqs, "qual": [None if x is None else "+" * len(x) for x in seqs]})

    keyed = with_batches(reads.select("cluster_id", F.col("r_id").cast("int").alias("r_id"), "acc", "seq", "qual"), params.batch_size)
    return keyed.groupBy("cluster_id", "batch_id").applyInPandasWithState(
        run, f"cluster_id {kind}, r_id int, acc string, seq string, qual string", "r_id array<int>, acc array<string>, seq array<string>, qual array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def windowed_counts(events: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts by tumbling window and keys with a watermark; the same code for a table and for a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")
