"""Language identification by compression.

For each language a raw-content dictionary for zstandard is put together from a bounded sample of labelled
texts. A text is cut into pieces of 2 KB over its whole length; every piece is compressed with every
dictionary, and the language with the smallest sum wins. When the runner-up is within `margin` of the
winner the prediction counts as rejected (column accepted is false); it is returned all the same, as the
best guess, because a prediction is asked for wherever there are letters.

Bounds (parameters): DICT_BYTES of sample for a language, at most ALL_BYTES for all, which is what is sent to
the executors; slices of SLICE_BYTES are cut before anything comes to the driver. A language with less sample than that
has a shorter dictionary, down to a few letters.

Defined cases: null texts and texts without a letter (a character that Unicode calls one) give `und` and score 0; with no
labelled text every prediction is `und`; equal sums go to the language first in code-point order; rows without an
id are in no fold: never learned from, held_out false; rows with equal ids are predicted each on their own; ids and
other columns are carried as they are, columns named like those that predict() adds are replaced by them.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

DICT_BYTES = 131_072
ALL_BYTES = 33_554_432
SLICE_BYTES = 1024
PIECE_BYTES = 2048
LEVEL = 3
MARGIN = 0.02


def fold(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def sample(labelled: DataFrame, dict_bytes: int = DICT_BYTES, all_bytes: int = ALL_BYTES) -> dict[str, bytes]:
    """Dictionary content for each language of (id, text, lang).

    Rows are taken in the order of a hash of the id, about twice as many as fill a dictionary with one slice
    of SLICE_BYTES each; the share that this is of a language's rows comes from a count over all of them.
    """
    counts = labelled.groupBy("lang").agg(F.count("*").alias("rows"))
    langs = counts.count()
    size = min(dict_bytes, all_bytes // max(1, langs))
    want = 2 * (size // SLICE_BYTES) + 16
    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled.join(F.broadcast(counts) if langs < 10_000 else counts, "lang").filter(unit * F.col("rows") < want)
    low, n = F.lower("text"), F.length("text")
    piece = F.substring(low, F.when(n > 3 * SLICE_BYTES, F.floor(n / 3)).otherwise(0).cast("int") + 1, F.lit(SLICE_BYTES))
    got = rows.select("lang", piece.alias("slice"), unit.alias("unit")).toPandas()
    out = {}
    for lang, part in got.sort_values(["unit", "slice"]).groupby("lang", sort=True):
        slices, size_now = [], 0
        for text in part["slice"]:
            slices.append(text.encode("utf-8", "surrogatepass")[:SLICE_BYTES])
            size_now += len(slices[-1])
            if size_now >= size:
                break
        out[lang] = b"".join(slices)[:size]
    return {k: v for k, v in out.items() if v}


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Classifier:
    def __init__(self, contents: dict[str, bytes], margin: float = MARGIN):
        self.langs, self.margin = sorted(contents), margin
        self.tools = []
        for lang in self.langs:
            # The library takes no dictionary below 8 bytes; repeating a shorter one adds nothing to what it holds.
            content = contents[lang] * -(-8 // len(contents[lang]))
            given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(level=LEVEL)
            self.tools.append(zstandard.ZstdCompressor(dict_data=given, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def one(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not has_letter(text):
            return "und", 0.0, False
        data = text.lower().encode("utf-8", "surrogatepass")
        parts = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        sums = sorted((sum(len(tool.compress(p)) for p in parts), i) for i, tool in enumerate(self.tools))
        if len(sums) == 1:
            return self.langs[0], 1.0, True
        gap = (sums[1][0] - sums[0][0]) / max(1, sums[1][0])
        return self.langs[sums[0][1]], min(1.0, gap / (gap + self.margin)), gap >= self.margin


ADDED = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]


def predict(df: DataFrame, text: str, contents: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """df without its text, with lang_pred, score and accepted, which replace columns so named."""
    kept = df.select(*[c for c in shared.columns(df.drop(text, *[f.name for f in ADDED]))], F.col(text))
    schema = T.StructType([*kept.schema.fields[:-1], *ADDED])
    held = df.sparkSession.sparkContext.broadcast(contents)  # at most ALL_BYTES
    last = len(kept.columns) - 1

    def score(batches):
        tool = Classifier(held.value, margin)
        for batch in batches:
            for part in shared.slices(batch, last):
                found = [tool.one(t) for t in part.column(last).to_pylist()]
                made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], schema.names)

    return kept.mapInArrow(shared.tidy(score), schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, accepted."""
    docs = shared.read(spark, sf_dir, "documents")
    remainder = fold("doc_id", 4)
    learn = docs.filter((remainder != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang")
    rows = docs.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "text")
    return predict(rows, "text", sample(learn))
