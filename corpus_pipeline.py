"""A corpus pipeline over `documents`: toxicity, near duplicates, benchmark leaks, source mix, token files.

Every stage takes all rows that the one before it kept and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, mixing, ngram_join, shared, tokenids, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on labels of these documents, doesn't call toxic."""
    net = toxicity.learn(docs, shared.read(spark, sf_dir, "labels"))
    names = tuple(shared.fresh(docs.columns, "score", "predicted"))
    return toxicity.score(docs, net, names=names).filter(F.col(names[1]) == 0).select(*shared.columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle near duplicates."""
    return ngram_join.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold nothing of the benchmark."""
    return decontaminate.clean(docs, shared.read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, and the digest read back from them."""
    return tokenids.encode_and_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mixing", mix),
    ("tokens", token_files),
]

#: Neural scoring and tokenising have no SQL form; the tests compose the stages' brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = shared.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
