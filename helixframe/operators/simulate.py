"""Generators of reads and transcripts. Every draw comes from a seed and the row's own key, so runs agree."""

from __future__ import annotations

import math
import random
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of per-base accuracy for mean error rates of 4, 7 and 12 percent. Fixed values.
LEVELS = {
    4: [0.9, 0.95, 0.96, 0.98, 0.99, 0.995],
    7: [0.85, 0.875, 0.9, 0.92, 0.96, 0.98, 0.99, 0.995],
    12: [0.75, 0.85, 0.875, 0.91, 0.95, 0.98],
}
#: Shares of deletions and substitutions among errors, the rest insertions, and how likely an insertion goes on. Fixed values.
DELETION, SUBSTITUTION, LONGER = 0.45, 0.35, 0.3


def _sign(error: float) -> str:
    return chr(33 + round(-10 * math.log10(error)))


def noisy(seq: str, accuracies: list[float], seed: str) -> tuple[str, str]:
    """(read, quality) of a sequence: each base is right with an accuracy drawn from the levels.

    The first right base after a deletion has the deleted base's quality; bases that an insertion goes on with have that of
    its going on.
    """
    r, bases, quals, lost = random.Random(seed), [], [], None
    for ch in seq:
        accuracy = r.choice(accuracies)
        made, signs = ch, _sign(lost or 1 - accuracy)
        if r.random() > accuracy:
            kind, signs = r.random(), _sign(1 - accuracy)
            if kind < DELETION:
                made, signs, lost = "", "", 1 - accuracy
            elif kind < DELETION + SUBSTITUTION:
                made = r.choice([b for b in "ACGT" if b != ch])
            else:
                made, signs = ch + r.choice("ACGT"), signs * 2
                while r.random() < LONGER:
                    made += r.choice("ACGT")
                    signs += _sign(1 - LONGER)
        else:
            lost = None
        bases.append(made)
        quals.append(signs)
    return "".join(bases), "".join(quals)


def simulate_reads(transcripts: DataFrame, error: int = 7, seed: int = 1) -> DataFrame:
    """acc, seq, qual of reads from (tx, seq, n): n noisy copies of each transcript, named <tx>_<i>."""
    levels = LEVELS[error]

    @F.pandas_udf(T.StructType([T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType())]))
    def run(acc: pd.Series, seq: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([noisy(s, levels, f"{seed}:{a}") for a, s in zip(acc, seq, strict=True)], columns=["seq", "qual"])

    copies = transcripts.filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)))
    named = copies.select(F.concat_ws("_", "tx", "i").alias("acc"), "seq")
    return named.withColumn("r", run("acc", "seq")).select("acc", "r.seq", "r.qual")


#: Read counts that the weighted model draws from, each the more often the smaller it is. Fixed values.
COUNTS = [*range(1, 11), *range(20, 101, 10)]


def abundances(transcripts: DataFrame, model: str = "constant", base: int = 1, seed: int = 1) -> DataFrame:
    """transcripts (tx, seq) with n, by a hash of the name.

    constant; exponential: 2 to the power of 0 to 7; weighted: one of COUNTS, n being as likely as int(100 / n); uniform: so
    that all together are about `base` for each transcript, each read choosing its transcript alike (its count is Poisson).
    """
    draw = F.pmod(F.xxhash64("tx", F.lit(seed)), F.lit(1 << 30))
    if model == "constant":
        n = F.lit(base)
    elif model == "exponential":
        n = F.lit(base) * F.call_function("shiftleft", F.lit(1), F.pmod(F.xxhash64("tx"), F.lit(8)).cast("int"))
    elif model == "weighted":
        drawn = [c for c in COUNTS for _ in range(int(100 / c))]
        n = F.element_at(F.array(*map(F.lit, drawn)), (draw % len(drawn)).cast("int") + 1)
    elif model == "uniform":
        below, term, total = F.lit(0), math.exp(-base), 0.0
        for i in range(1, 4 * base + 12):
            total += term
            below = below + (draw / float(1 << 30) >= total).cast("int")
            term *= base / i
        n = below
    else:
        raise ValueError(model)
    return transcripts.withColumn("n", n)


def isoforms(exons: list[str], least: int = 1) -> list[str]:
    """Distinct sequences of all exon subsets in order, the longest first."""
    made = ["".join(exons[i] for i in keep) for n in range(len(exons), least - 1, -1) for keep in combinations(range(len(exons)), n)]
    return sorted(dict.fromkeys(made), key=lambda s: (-len(s), s))


def isoform_pair(exons: list[str], kind: str, seed: int = 1) -> tuple[str, str]:
    """A transcript and its variant.

    'exon' drops the middle exon, 'snp' changes the middle base of the middle one; 'snp-near' and 'gap-near' change or drop a
    base at 75 to 124, or as far as a shorter transcript goes.
    """
    whole, mid, r = "".join(exons), len(exons) // 2, random.Random(seed)
    if kind == "exon":
        return whole, "".join(e for i, e in enumerate(exons) if i != mid)
    at = sum(map(len, exons[:mid])) + len(exons[mid]) // 2 if kind == "snp" else min(r.randint(75, 124), len(whole) - 1)
    new = "" if kind == "gap-near" else r.choice([b for b in "ACGT" if b != whole[at]])
    return whole, whole[:at] + new + whole[at + 1 :]


def mutated(seq: str, rate: float, seed: str) -> str:
    """A sequence in which bases are changed, dropped or added, each as likely, at a rate for each base."""
    r, out = random.Random(seed), []
    for ch in seq:
        x = r.random()
        if x >= rate:
            out.append(ch)
        elif x < rate / 3:
            out.append(r.choice([b for b in "ACGT" if b != ch]))
        elif x < 2 * rate / 3:
            out += [ch, r.choice("ACGT")]
    return "".join(out)


def gene_family(exons: list[str], members: int, rate: float, seed: int = 1) -> list[list[str]]:
    """Exons of the genes of a family: a binary tree, first in first out; of two children the first is the parent unchanged, the second mutated."""
    queue = [exons]
    for n in range(members - 1):
        parent = queue.pop(0)
        queue += [parent, [mutated(e, rate, f"{seed}:{n}:{i}") for i, e in enumerate(parent)]]
    return queue


def transcriptome(exons: DataFrame, chromosomes: DataFrame) -> DataFrame:
    """(tx, seq): slices of the chromosomes (chrom, seq) at the exons of each transcript, in order."""
    cut = exons.join(chromosomes, "chrom").select("tx", "exon_start", F.expr("substring(seq, exon_start + 1, exon_end - exon_start)").alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("exon_start", "part"))), lambda x: x["part"])
    return cut.groupBy("tx").agg(F.array_join(ordered, "").alias("seq"))
