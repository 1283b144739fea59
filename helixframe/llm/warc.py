"""Content-addressed web archive.

Two tables make an archive: `payloads` holds the bytes of every distinct payload once, under its SHA-256
digest; `headers` holds the exact header block of every record. A WARC record is put together from both by a
join on the digest. On reading, every payload's digest is computed again, and a payload that doesn't match its
address fails the read. All in DataFrame functions, written by Spark's own committer, so that any store works.

Of records with equal payloads of at least `min_bytes` bytes the one with the largest id is the response and
the others revisit it; records with smaller payloads are all responses.

Defined cases: null html is an empty payload; a null url is an empty target; line ends in a url become spaces;
rows with equal ids and payloads are all responses if their id is the largest; rows without an id are
responses if no row with an id shares the payload, else they revisit; an empty table gives an empty archive; other
columns are ignored. Only payloads that several rows have are shuffled on writing, merged before that. A record's header says in which of its payload's
parts it is put together, PART_RECORDS to a part, so a payload that a third of the pages share is joined in many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

PART_RECORDS = 4096
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Digits that number conversion to base 32 uses.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: eight groups of five hexadecimal digits, each four base-32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def record_id(ident: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(ident.cast("string"), F.lit("none")), F.lit(">"))


def build(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of an archive, not written yet."""
    payload = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(ident).alias("id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("address", F.sha2("payload", 256))
    thin = rows.select("id", "url", "address", F.length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("sha1"))
    heads = thin.groupBy("address").agg(F.max("id").alias("response"), F.ceil(F.count("*") / PART_RECORDS).alias("parts"))
    placed = thin.join(heads, "address").withColumn(
        "revisit", (F.col("size") >= min_bytes) & F.col("response").isNotNull() & ~F.coalesce(F.col("id") == F.col("response"), F.lit(False))
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\r\n]", " "), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("response"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("revisit"), F.lit("0")).otherwise(F.col("size").cast("string"))),
        F.lit("\r\n"),
    )
    headers = placed.select("address", F.pmod(F.xxhash64("id"), "parts").alias("part"), header.cast("binary").alias("header"))
    # Payloads that no other row has are written where they are; a bitmap of bounded size tells which those are.
    again = shared.sieve(thin.groupBy("address").agg(F.count("*").alias("n")).filter("n > 1"), "address")
    body = rows.select("address", "payload")
    alone = shared.sifted(body, "address", again, inside=False).withColumn("parts", F.lit(1).cast("long"))
    equal = shared.sifted(body, "address", again).groupBy("address").agg(F.first("payload").alias("payload"), F.ceil(F.count("*") / PART_RECORDS).alias("parts"))
    return headers, alone.unionByName(equal)


def write(pages: DataFrame, path: str, **settings) -> None:
    """Write an archive below path; each table is committed as a whole."""
    headers, payloads = build(pages, **settings)
    headers.write.parquet(f"{path}/headers")
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """(address, payload, parts) of an archive; a payload that isn't what its address says raises."""
    rows = spark.read.schema("address string, payload binary, parts bigint").parquet(f"{path}/payloads")
    return rows.withColumn("address", F.when(F.sha2("payload", 256) == F.col("address"), F.col("address")).otherwise(F.raise_error(F.lit("payload doesn't match its address"))))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive without payloads: header, address, part and what the header says."""
    rows = spark.read.schema("address string, part bigint, header binary").parquet(f"{path}/headers")
    text = F.decode("header", "utf-8")
    of = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return rows.select(
        "address", "part", "header",
        F.try_to_number(of(r"\r\nWARC-Record-ID: <urn:page:(-?\d+)>"), F.lit("S9999999999999999999")).cast("long").alias("page_id"),
        of(r"\r\nWARC-Type: (\w+)").alias("record_type"),
        of(r"\r\nWARC-Refers-To: <urn:page:(-?\d+)>").cast("long").alias("refers_to"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """Every record with its exact WARC bytes and its full payload (a revisit's is that of its response)."""
    stored = verified(spark, path).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    joined = headers(spark, path).join(stored, ["address", "part"])
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return joined.withColumn("record", F.concat("header", body, F.lit(b"\r\n\r\n")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page, from the records of the archive read back: page_id, payload_bytes, payload_digest, record_type, refers_to, record_bytes."""
    path = shared.shared_path(spark, "warc")
    write(shared.read(spark, sf_dir, "pages"), path)
    return records(spark, path).select(
        "page_id", F.length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"), "record_type", "refers_to",
        F.length("record").cast("long").alias("record_bytes"),
    )


_GROUPS = " || ".join(f"to_base(('0x' || substr(h, {1 + 5 * i}, 5))::bigint, 32, 4)" for i in range(8))
ORACLE = f"""
with p as (select page_id, url, coalesce(html, '') as html from pages),
h as (select page_id, url, html, sha1(html) as h, strlen(html)::bigint as payload_bytes, max(page_id) over (partition by html) as last from p),
r as (select *, last is not null and page_id is distinct from last as revisit from h)
select page_id, payload_bytes, translate({_GROUPS}, '{DIGITS}', '{BASE32}') as payload_digest,
  case when revisit then 'revisit' else 'response' end as record_type, case when revisit then last end as refers_to,
  strlen('WARC/1.1..WARC-Type: revisit..WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, 'none') || '>..WARC-Date: {DATE}..WARC-Target-URI: ' || coalesce(url, '')
    || '..WARC-Payload-Digest: sha1:' || repeat('.', 32) || case when revisit then '..WARC-Profile: {PROFILE}..WARC-Refers-To: <urn:page:' || last || '>' else '.' end
    || '..Content-Type: text/html; charset=utf-8..Content-Length: ' || case when revisit then 0 else payload_bytes end || '..' || '..' || '....')::bigint
    + case when revisit then 0 else payload_bytes end as record_bytes from r
"""
