"""Readers and writers of FASTA, FASTQ, SAM and GFF/GTF files.

The line formats are read with text scans and built-in expressions. FASTA and FASTQ need a parser with state, which reads
byte ranges (`ranges`); `parse` is the same for lines at hand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .ranges import RANGE_BYTES, read_records, read_records4


def parse(lines: Iterable[str]) -> Iterator[tuple[str, str, str | None]]:
    """(header with spaces as _, sequence, quality or None) of FASTA or FASTQ lines, over several lines or one.

    A quality is taken until it is as long as the sequence; where it falls short the record has none.
    """
    header, seq, qual, in_quality = None, [], [], False
    for line in lines:
        line = line.rstrip("\r\n")
        if in_quality and sum(map(len, qual)) < sum(map(len, seq)):
            qual.append(line)
            continue
        if line[:1] in (">", "@"):
            if header is not None:
                yield _record(header, seq, qual if in_quality else None)
            header, seq, qual, in_quality = line[1:], [], [], False
        elif line[:1] == "+" and header is not None:
            in_quality = True
        elif header is not None:
            seq.append(line)
    if header is not None:
        yield _record(header, seq, qual if in_quality else None)


def _record(header: str, seq: list[str], qual: list[str] | None) -> tuple[str, str, str | None]:
    text = "".join(seq)
    quality = "".join(qual) if qual is not None else None
    return header.replace(" ", "_"), text, quality if quality is not None and len(quality) >= len(text) else None


def read_sequences(spark: SparkSession, path: str, header: str = "full", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, r_id (from 1 within a file), acc, seq, qual; files are read in byte ranges, whatever their size.

    header: full, word (to the first space), stem (to the first space or _) or clean (to the first space, without brackets and commas).
    """
    out = read_records(spark, path, range_bytes)
    if header == "full":
        return out
    word = F.split_part("acc", F.lit("_"), F.lit(1))
    return out.withColumn("acc", F.translate(word, "(),", "") if header == "clean" else word)


def read_accessions(spark: SparkSession, path: str, pattern: str = r"transcript:([A-Za-z0-9]+)") -> DataFrame:
    """The distinct accessions (acc) that a pattern with one group finds in the lines of a file, all of a line's."""
    found = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("acc"))
    return found.filter("acc <> ''").distinct()


def read_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Reads of all *.fastq files of a folder, with cluster_id and batch from names <cluster>[_<batch>].fastq."""
    name = F.regexp_extract("path", r"([^/]+)\.fastq$", 1)
    rows = read_sequences(spark, f"{folder.rstrip('/')}/*.fastq")
    return rows.withColumn("cluster_id", F.split_part(name, F.lit("_"), F.lit(1)).cast("long")).withColumn("file_batch", F.nullif(F.regexp_extract(name, r"_(\d+)", 1), F.lit("")).cast("int"))


def read_fastq4(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Strict four-line FASTQ by line numbers alone; an incomplete last record is left out, as are those whose qualities don't fit."""
    return read_records4(spark, path, range_bytes).filter("length(qual) = length(seq)")


def read_sam(spark: SparkSession, path: str, primary_only: bool = False) -> DataFrame:
    """qname, flag, rname, start (from 0), mapq, cigar, seq, nm, ord of SAM lines; mapped ones only."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("@")).select(
        f[0].alias("qname"), f[1].cast("int").alias("flag"), f[2].alias("rname"), (f[3].cast("int") - 1).alias("start"), f[4].cast("int").alias("mapq"),
        f[5].alias("cigar"), f[9].alias("seq"), F.nullif(F.regexp_extract("value", r"\tNM:i:(\d+)", 1), F.lit("")).cast("int").alias("nm"), F.monotonically_increasing_id().alias("ord"),
    )
    return rows.filter(F.col("flag").bitwiseAND(0x904 if primary_only else 4) == 0)


def read_gff(spark: SparkSession, path: str, feature: str = "exon") -> DataFrame:
    """chrom, gene, tx, exon_start (from 0), exon_end, strand of GFF3 or GTF lines of one kind."""
    f = F.split("value", "\t")
    note = lambda *keys: F.coalesce(*[F.nullif(F.regexp_extract(f[8], rf'(?:^|[;\s]){k}[= ]"?([^";]+)', 1), F.lit("")) for k in keys])
    return spark.read.text(path).filter(~F.col("value").startswith("#") & (f[2] == feature)).select(
        f[0].alias("chrom"), note("gene_id", "gene").alias("gene"), note("transcript_id", "Parent").alias("tx"), (f[3].cast("int") - 1).alias("exon_start"), f[4].cast("int").alias("exon_end"), f[6].alias("strand"),
    )


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """A CSV or TSV file with a given schema."""
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def fastq_record(acc: Column, seq: Column, qual: Column) -> Column:
    return F.concat(F.lit("@"), acc, F.lit("\n"), seq, F.lit("\n+\n"), qual)


def write_fastq(reads: DataFrame, path: str, by_name: int = 0) -> None:
    """Reads as FASTQ, a folder for each cluster, in the order of r_id within a file.

    With by_name, the size of a batch, batches follow each other in the order of their number as text: 0, 1, 10, 2.
    """
    order = [F.floor((F.col("r_id") - 1) / by_name).cast("string")] if by_name else []
    rows = reads.repartition("cluster_id").sortWithinPartitions("cluster_id", *order, "r_id")
    rows.select("cluster_id", fastq_record(F.col("acc"), F.col("seq"), F.col("qual")).alias("value")).write.partitionBy("cluster_id").text(path)


def write_fasta(seqs: DataFrame, path: str) -> None:
    seqs.select(F.concat(F.lit(">"), "acc", F.lit("\n"), "seq").alias("value")).write.text(path)


#: Columns of the published result files, in order. Fixed values.
RESULTS = {
    "per_read_genome": "acc,read_type,ins,del,subs,matches,error_rate,read_length,aligned_length,cluster_size,is_unaligned_in_other_method,tot_splices,read_sm_junctions,read_nic_junctions,fsm,nic,ism,nnc,no_splices,donor_acceptors,donor_acceptors_choords,transcript_fsm_id,chr_id,reference_start,reference_end,sam_flag",
    "per_read_transcriptome": "acc,read_type,ins,del,subs,matches,error_rate,read_length,aligned_length,chr_id",
    "error_profile": "read,read_length,err,ins,del,subs,matches,err_rate,type,transcript_cov,gene_cov,gene_fam_cov",
    "perturbation": "id,type,Depth,p,q_acc,r_acc,total_errors,error_rate,abundance,preserved,minor",
    "location_stability": "nr_reads,nr_isoforms,is_overcorrected",
    "aligned_coverage": "transcript,type,depth",
}


def write_results(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Result rows as CSV with a header; of a published kind with just its columns, which df must have."""
    (df.select(*RESULTS[kind].split(",")) if kind else df).write.option("header", True).csv(path)


def annotation(spark: SparkSession, path: str, make: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Introns (chrom, tx, start, stop) kept at a path: read from there, or made, written and read where there are none yet."""
    schema = "chrom string, tx string, start int, stop int"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        if make is None:
            raise
    made = make()
    made.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")]).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def observed(reads: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """reads, and an observation of them: rows, bases, and rows with signs that are no bases, counted while they pass."""
    seen = Observation(name)
    odd = F.col("seq").rlike("[^ACGTUN-]")
    return reads.observe(seen, F.count(F.lit(1)).alias("reads"), F.sum(F.length("seq")).alias("bases"), F.count_if(odd).alias("odd")), seen


def unfinished(reads: DataFrame, finished: DataFrame) -> DataFrame:
    """Reads of clusters whose number of finished reads differs from their own: what a restarted run still has to do."""
    have = finished.groupBy("cluster_id").agg(F.count("*").alias("n"))
    want = reads.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return reads.join(want.join(have, ["cluster_id", "n"], "left_semi").select("cluster_id"), "cluster_id", "left_anti")
