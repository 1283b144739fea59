"""Arrow-batched wrappers of the kernels, for use as columns and grouped operators."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.params import Params
from ..session import dealt
from .alignment import Graph, cigar_of, consensus, path
from .batches import infix_distances, paths, semi_globals
from .correction import guarded, schedule, stitch
from .matrix import context_windows, corrected_rows, multialignment, positioned
from .seeds import iterate_pairs, minimizers, with_batches


def _struct(**fields: T.DataType) -> T.StructType:
    """Types as objects, since parsing their names needs a session that isn't there yet on import."""
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


@F.pandas_udf(_struct(ed=T.IntegerType(), cigar=T.StringType(), query_aln=T.StringType(), target_aln=T.StringType()))
def path_udf(query: pd.Series, target: pd.Series) -> pd.DataFrame:
    """Global alignment path of two columns."""
    rows = paths(query.tolist(), target.tolist())
    return pd.DataFrame([(d, cigar_of(q, t), q, t) for d, q, t in rows], columns=["ed", "cigar", "query_aln", "target_aln"])


@F.pandas_udf(_struct(score=T.IntegerType(), query_aln=T.StringType(), target_aln=T.StringType()))
def affine_udf(query: pd.Series, target: pd.Series) -> pd.DataFrame:
    """Semi-global affine alignment of two columns."""
    return pd.DataFrame(semi_globals(query.tolist(), target.tolist()), columns=["score", "query_aln", "target_aln"])


@F.pandas_udf(_struct(score=T.IntegerType(), query_aln=T.StringType(), target_aln=T.StringType()))
def gentle_udf(query: pd.Series, target: pd.Series) -> pd.DataFrame:
    """Semi-global alignment of two columns with small gap costs."""
    return pd.DataFrame(semi_globals(query.tolist(), target.tolist(), 2, -2, 2, 1), columns=["score", "query_aln", "target_aln"])


@F.pandas_udf(T.IntegerType())
def infix_udf(pattern: pd.Series, text: pd.Series) -> pd.Series:
    """Fewest edits of the pattern against an infix of the text."""
    return pd.Series(infix_distances(pattern.tolist(), text.tolist()), dtype="int32")


@F.pandas_udf(T.StringType())
def guard_udf(orig: pd.Series, corrected: pd.Series) -> pd.Series:
    """The corrected read after the structural guard against the original."""
    return pd.Series([guarded(o, c) for _, o, c in semi_globals(orig.tolist(), corrected.tolist())])


def poa_by(reads: DataFrame, key: str) -> DataFrame:
    """Partial-order consensus of all reads of every group, in the order of r_id: key, reads, consensus.

    Equal reads go one way through the graph, so a text is sent once, where it first stands, with the number of its copies. Groups come
    one after another, and a task holds one graph and one batch of texts.
    """
    source = dealt(reads.groupBy(key, "seq").agg(F.min("r_id").alias("r_id"), F.count("*").alias("n")), key).sortWithinPartitions(key, "r_id", "seq")
    schema = T.StructType([reads.schema[key], T.StructField("reads", T.IntegerType()), T.StructField("consensus", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for b in batches for x in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
        for group, members in groupby(rows, lambda x: x[0]):
            graph, size = Graph(), 0
            for _, seq, n in members:
                graph.add(seq or "", n)
                size += n
            yield pa.RecordBatch.from_arrays([pa.array([group.as_py()], group.type), pa.array([size], pa.int32()), pa.array([graph.consensus()])], schema.names)

    return source.select(key, "seq", "n").mapInArrow(run, schema)


_SPANS = T.ArrayType(_struct(stop=T.IntegerType(), start=T.IntegerType(), support=T.IntegerType()))


@F.pandas_udf(_SPANS)
def schedule_udf(spans: pd.Series) -> pd.Series:
    """The chosen ones of arrays of (stop, start, support), sorted."""
    return spans.map(lambda xs: [xs[i] for i in schedule([(x["start"], x["stop"], x["support"]) for x in xs])])


def schedule_by(intervals: DataFrame, key: str) -> DataFrame:
    """Weighted interval scheduling of (key, start, stop, support): the chosen rows of every key, many keys a batch."""
    spans = intervals.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("stop", "start", "support"))).alias("s"))
    return spans.select(key, F.explode(schedule_udf("s")).alias("x")).select(key, "x.start", "x.stop", "x.support")


@F.udtf(returnType=_struct(m1=T.StringType(), p1=T.IntegerType(), m2=T.StringType(), p2=T.IntegerType()))
class Anchors:
    """Table function: the anchor pairs of a sequence."""

    def eval(self, seq: str, k: int, w: int, low: int, high: int):
        for m1, p1, partners in iterate_pairs(minimizers(seq or "", k, w), low, high):
            for m2, p2 in partners:
                yield m1, p1, m2, p2


def register(spark) -> None:
    """Make the functions known to SQL: edit_path, affine_align, infix_distance, structural_guard, anchors."""
    for name, f in (("edit_path", path_udf), ("affine_align", affine_udf), ("infix_distance", infix_udf), ("structural_guard", guard_udf)):
        spark.udf.register(name, f)
    spark.udtf.register("anchors", Anchors)


def multialign_by(reads: DataFrame, key: str, k: int = 9, ratio: float = 0.1, batch: int = Params.batch_size) -> DataFrame:
    """The reads of every group in one alignment with their consensus: key, r_id (0: the consensus), row, corrected.

    r_id counts from 1; a group is aligned in batches of `batch` reads, each with a consensus of its own.
    """
    kind = reads.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("r_id")
        texts = dict(zip(group["r_id"].tolist(), group["seq"].fillna("").tolist(), strict=True))
        center = consensus(list(texts.values())[: Params.consensus_limit + 1])
        rows: dict[object, list[str]] = {0: positioned(center, center)}
        known: dict[str, list[str]] = {}
        for r, t in texts.items():
            if t not in known:
                known[t] = positioned(*path(t, center)[1:])
            rows[r] = known[t]
        matrix = multialignment(rows)
        done = corrected_rows({r: x for r, x in matrix.items() if r != 0}, matrix[0], k, ratio)
        return pd.DataFrame({key: group[key].iloc[0], "r_id": list(matrix), "row": list(matrix.values()), "corrected": [center if r == 0 else done[r] for r in matrix]})

    return dealt(with_batches(reads, batch), key, "batch_id").groupBy(key, "batch_id").applyInPandas(run, f"`{key}` {kind}, r_id int, row string, corrected string")


@F.pandas_udf(T.ArrayType(_struct(start=T.IntegerType(), stop=T.IntegerType())))
def windows_udf(row: pd.Series, half: pd.Series) -> pd.Series:
    """[start, stop) of the context of every column of a gapped row."""
    return pd.Series([[{"start": a, "stop": b} for a, b in context_windows(x, int(h))] for x, h in zip(row, half, strict=True)])


@F.pandas_udf(T.StringType())
def stitch_udf(seq: pd.Series, parts: pd.Series) -> pd.Series:
    """A read with the parts (start, stop, text) put in, in order."""
    return pd.Series([stitch(s, [(x["start"], x["stop"], x["text"]) for x in xs]) for s, xs in zip(seq, parts, strict=True)])


@F.pandas_udf(T.StringType())
def guard_rows_udf(orig: pd.Series, corrected: pd.Series) -> pd.Series:
    """The structural guard on two gapped rows of one alignment."""
    return pd.Series([guarded(o, c) for o, c in zip(orig, corrected, strict=True)])


def columns_by(rows: DataFrame, key: str, consensus_row: str = "consensus", k: int = 9, ratio: float = 0.1) -> DataFrame:
    """key, r_id, corrected: the column rules on rows (key, r_id, row) of one alignment, whose consensus row is a column."""
    kind = rows.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("r_id")
        done = corrected_rows(dict(zip(group["r_id"].tolist(), group["row"].tolist(), strict=True)), group[consensus_row].iloc[0], k, ratio)
        return pd.DataFrame({key: group[key].iloc[0], "r_id": list(done), "corrected": list(done.values())})

    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kind}, r_id int, corrected string")
