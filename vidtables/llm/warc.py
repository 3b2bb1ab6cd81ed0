"""A content-addressed WARC archive in two tables.

`payloads` stores each distinct payload once, under its SHA-256; `records` has the exact bytes
of every record's headers, its digest and its place. Records are put together again by a join
on the digest, and a payload counts only if its bytes still have the digest it is stored under.

Of records with equal payloads of at least `smallest` bytes, the one with the largest id is a
response and all others are revisits that refer to it; smaller payloads are all responses. A
revisit's block is empty by the format, its payload digest and length are those of the full
payload. Headers are written and read back as WARC/1.1: names and values by lines, ended by an
empty line.

Null payloads count as empty, null URIs are left out of the headers. Rows without id get no
record, since a record needs one; ids are unique, and of repeated ids each row is a record with
the same WARC-Record-ID. Extra columns are left out. Empty tables give empty archives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vidtables.llm.scratch import WHILE_WRITING, Scratch, settings

END = "\r\n"
RECORD_ID = "<urn:record:%s>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def hashed(pages: DataFrame, id_col: str, payload_col: str, url_col: str) -> DataFrame:
    """id, url, payload (binary), sha256, sha1 and n_bytes of each row with an id."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    return rows.select("*", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"))


def classify(rows: DataFrame, holders: DataFrame, smallest: int) -> DataFrame:
    """Rows of hashed() with record_type and refers_to, given the holder of each sha256."""
    revisit = (F.col("n_bytes") >= smallest) & (F.col("id") != F.col("holder"))
    own = rows.select("id", "url", "sha256", "sha1", "n_bytes").join(holders.select("sha256", "holder"), "sha256")
    return own.select("*", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("holder")).alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def headers(date: str) -> Column:
    """The header block of a classified row."""
    response = F.col("record_type") == "response"
    block = F.when(response, F.col("n_bytes")).otherwise(F.lit(0)).cast("string")
    return F.concat(
        F.lit(f"WARC/1.1{END}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", F.format_string(RECORD_ID, F.col("id").cast("string"))),
        _header("WARC-Date", F.lit(date)),
        F.coalesce(_header("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]+", " ")), F.lit("")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _header("X-Payload-SHA256", F.col("sha256")),
        _header("X-Payload-Length", F.col("n_bytes").cast("string")),
        F.when(response, F.lit("")).otherwise(F.concat(_header("WARC-Refers-To", F.format_string(RECORD_ID, F.col("refers_to").cast("string"))), _header("WARC-Profile", F.lit(PROFILE)))),
        _header("Content-Type", F.lit("text/html")),
        _header("Content-Length", block),
        F.lit(END),
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", smallest: int = 1000, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes the tables `payloads` (sha256, payload, holder: the largest id that has it) and `records` under path.

    Payloads are shuffled once, one copy at most from each task; all else is done on digests. The
    holders are read from the written table, so that the rows of a page that is copied often meet
    their one holder in a plain join, which Spark splits.
    """
    spark, rows = pages.sparkSession, hashed(pages, id_col, payload_col, url_col)
    with settings(spark, WHILE_WRITING):
        rows.groupBy("sha256").agg(F.max("id").alias("holder"), F.first("payload").alias("payload")).write.parquet(f"{path}/payloads", compression="zstd")
        own = classify(rows, spark.read.parquet(f"{path}/payloads"), smallest)
        own.select(F.encode(headers(date), "UTF-8").alias("header"), "sha256").write.parquet(f"{path}/records", compression="zstd")


def read_archive(spark: SparkSession, path: str, whole: bool = True) -> DataFrame:
    """header, payload_bytes, payload_digest and verified of each record, and the payload unless whole is False.

    Length, SHA-1 and the check against the SHA-256 are taken from each stored payload once; without
    the payload only these go through the join.
    """
    payload = F.col("payload")
    held = [F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_digest"), (F.sha2(payload, 256) == F.col("sha256")).alias("verified")]
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", *[payload] * whole, *held)
    records = spark.read.parquet(f"{path}/records").join(payloads, "sha256", "left").drop("sha256")
    return records.withColumn("verified", F.coalesce("verified", F.lit(False)))


def record_bytes(archive: DataFrame) -> DataFrame:
    """The bytes of each record as a WARC file has them: header, block, and two line ends."""
    block = F.when(F.decode("header", "UTF-8").contains(f"WARC-Type: revisit{END}"), F.lit(b"")).otherwise(F.col("payload"))
    return archive.select(F.concat("header", block, F.lit((END * 2).encode())).alias("record"))


def field(name: str) -> Column:
    """A named field of the decoded header column `h`, null where it is missing."""
    found = F.regexp_extract("h", f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)
    return F.when(F.col("h").contains(f"{END}{name}: "), found)


def parse(archive: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified of each record read back."""
    ids = lambda name: F.regexp_extract(field(name), "^<urn:record:(.*)>$", 1).cast(id_type)
    rows = archive.select(F.decode("header", "UTF-8").alias("h"), "payload_bytes", "payload_digest", "verified")
    return rows.select(
        ids("WARC-Record-ID").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        field("WARC-Type").alias("record_type"),
        F.when(field("WARC-Refers-To").isNotNull(), ids("WARC-Refers-To")).alias("refers_to"),
        (F.col("verified") & (field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), "payload_digest"))).alias("verified"),
    )


def round_trip(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", smallest: int = 1000) -> DataFrame:
    """Writes an archive of pages to the shared folder, where it stays, and reads it back."""
    path = f"{Scratch(pages.sparkSession, 'warc').root}"
    write_archive(pages, path, id_col, payload_col, url_col, smallest)
    return parse(read_archive(pages.sparkSession, path, whole=False), pages.schema[id_col].dataType.simpleString())


ORACLE = """
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to, true AS verified FROM (
 SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages)
"""
