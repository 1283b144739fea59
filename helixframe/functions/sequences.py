"""Built-in expressions over sequences, headers and qualities. All evaluate in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: IUPAC complement, upper and lower case. Fixed values.
IUPAC = ("ACGTURYSWKMBDHVNacgturyswkmbdhvn", "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn")
#: Error probability above which Phred 1 and below are clamped. Fixed value.
WORST = 0.79433
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTAC"


def bases_of(text: Column) -> Column:
    """A deterministic nucleotide sequence from text: letters only, lower-cased, mapped in turn to A, C, G, T."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), ALPHABET, BASES)


def reads_of(documents: DataFrame) -> DataFrame:
    """Reads from documents: cluster_id is the language, r_id the rank by doc_id, seq its bases, qual by position.

    Ids are ranked without their texts, which are joined on afterwards; doc_id says which document a row is.
    """
    rows = documents.select("doc_id", F.col("lang").alias("cluster_id"), bases_of(F.col("text")).alias("seq"))
    ranks = documents.select(F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")).alias("r_id"))
    return rows.join(ranks, rows["doc_id"] == ranks["id"]).withColumn("acc", F.concat(F.lit("doc_"), F.col("doc_id"))).withColumn("qual", cyclic_quality(F.length("seq"))).select("cluster_id", "r_id", "acc", "seq", "qual")


def cyclic_quality(length: Column) -> Column:
    """A quality string that runs through Phred 5 to 34 by position."""
    pattern = "".join(chr(33 + 5 + (i * 7) % 30) for i in range(30))
    return F.substring(F.repeat(F.lit(pattern), F.ceil(length / 30).cast("int")), F.lit(1), length)


def kmers(seq: Column, k: int, block: int = 256) -> Column:
    """All k-mers with their position: array of (pos, kmer).

    Taken from blocks of the sequence, since a substring is found by walking from the start of its string.
    """
    last = F.length(seq) - k

    def of_block(start: Column) -> Column:
        piece = F.array(F.substring(seq, start + 1, F.lit(block + k - 1)))
        inside = lambda p: F.transform(F.sequence(F.lit(0), F.least(F.lit(block - 1), last - start)), lambda j: F.struct((start + j).cast("int").alias("pos"), F.substring(p, j + 1, F.lit(k)).alias("kmer")))
        return F.get(F.transform(piece, inside), F.lit(0))

    return F.when(last >= 0, F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(block)), of_block))).otherwise(F.array().cast("array<struct<pos:int,kmer:string>>"))


def poly_a(kmer: Column, k: int) -> Column:
    return kmer == "A" * k


def phred_error(ch: Column) -> Column:
    """Error probability of a quality character."""
    return F.least(F.pow(F.lit(10.0), -(F.ascii(ch) - 33) / 10.0), F.lit(WORST))


def quality_prefix(qual: Column) -> Column:
    """Sums of error probabilities before each position; one longer than the quality, from 0."""
    each = F.transform(F.filter(F.split(qual, ""), lambda c: c != ""), phred_error)
    return F.aggregate(each, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def span_error(prefix: Column, start: Column, stop: Column) -> Column:
    return (F.element_at(prefix, (stop + 1).cast("int")) - F.element_at(prefix, (start + 1).cast("int"))) / (stop - start)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), *IUPAC)


def compress_homopolymers(seq: Column) -> Column:
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def degap(aligned: Column) -> Column:
    return F.replace(aligned, F.lit("-"), F.lit(""))


def trim_anchors(seq: Column, k: int) -> Column:
    return F.substring(seq, F.lit(k + 1), F.greatest(F.length(seq) - 2 * k, F.lit(0)))


def contains_either(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def last_position(values: Column, value: Column) -> Column:
    """1-based last position of a value in an array; 0 if it isn't there."""
    at = F.array_position(F.reverse(values), value)
    return F.when(at > 0, F.size(values) - at + 1).otherwise(F.lit(0))


def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Unit edit distance, -1 above `most`."""
    return F.levenshtein(a, b, most)


def header_parts(acc: Column) -> list[Column]:
    """gene, transcript and ordinal of headers gene|...|transcript_ordinal."""
    last = F.element_at(F.split(acc, r"\|"), -1)
    return [
        F.split_part(acc, F.lit("|"), F.lit(1)).alias("gene"),
        F.regexp_replace(last, r"_[^_]*$", "").alias("transcript"),
        F.element_at(F.split(last, "_"), -1).alias("ordinal"),
    ]


def header_origin(acc: Column) -> Column:
    """The transcript of headers ..._from_TX."""
    return F.nullif(F.regexp_extract(acc, r"_from_(.+)$", 1), F.lit(""))


def header_gene(acc: Column, pattern: str = r"^([A-Za-z]+\d)") -> Column:
    """The gene of a transcript's name, by a pattern with one group."""
    return F.nullif(F.regexp_extract(acc, pattern, 1), F.lit(""))


def clean_header(acc: Column) -> Column:
    """A header up to its first space, without ( ) and commas."""
    return F.translate(F.split_part(acc, F.lit(" "), F.lit(1)), "(),", "")


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Label (lo,hi] of the bin that holds a value; null outside."""
    out = F.lit(None).cast("string")
    for lo, hi in reversed(list(zip(edges, edges[1:], strict=False))):
        out = F.when((value > lo) & (value <= hi), F.lit(f"({lo:g},{hi:g}]")).otherwise(out)
    return out
