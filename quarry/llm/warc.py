"""A content-addressed archive of WARC records.

The archive is two tables in a folder. payloads has the bytes of each different payload once, under its SHA-256. headers has
a row for each record: the record's header and the HTTP header behind it, byte for byte, and the digest of its payload. Records are
made again by joining the two; what is read is measured and digested anew and held against the header.

Records of one payload of some size are one response, that of the largest id, and revisits that refer to it. A payload that
a third of all pages have is sent once a task before it is stored, and the joins have one row a digest on one side, so that Spark can split them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import folder, written

CRLF = "\r\n"
LEAST = 1000  # bytes of a payload that revisits may refer to
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "page_id long, payload_digest string, header string"


def named(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def field(name: str, value: Column) -> Column:
    """A header line, nothing where the value is null; line breaks in it become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, "[\\r\\n]+", " "), F.lit(CRLF)), F.lit(""))


def headers(pages: DataFrame, date: str, least: int = LEAST) -> DataFrame:
    """(page_id, payload_digest, header) of each row of pages (page_id, url, n, sha1, sha256)."""
    first = pages.groupBy(F.col("sha256").alias("same")).agg(F.max("page_id").alias("kept"))
    both = pages.join(first, F.col("sha256") == F.col("same"))
    revisit = (F.col("n") >= least) & ~F.col("page_id").eqNullSafe(F.col("kept"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    size = F.length(http) + F.when(revisit, 0).otherwise(F.col("n"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), field("WARC-Type", F.when(revisit, "revisit").otherwise("response")), field("WARC-Record-ID", named(F.col("page_id"))), field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), field("WARC-Refers-To", F.when(revisit, named(F.col("kept")))),
        field("WARC-Profile", F.when(revisit, F.lit(PROFILE))), field("Content-Type", F.lit("application/http; msgtype=response")), field("Content-Length", size.cast("string")), F.lit(CRLF),
    )
    return both.select("page_id", F.col("sha256").alias("payload_digest"), F.concat(warc, http).alias("header"))


def archive(pages: DataFrame, place: str, date: str = "1970-01-01T00:00:00Z", least: int = LEAST) -> None:
    """Write a record for each row of pages (page_id, url, html) into an archive: place/payloads and place/headers.

    The payload is html in UTF-8, a null one empty. Of equal payloads of at least least bytes the record of the largest page_id is the
    response and the others are revisits; rows that have payload and that page_id in common are all responses, and a null page_id is
    less than any other. A null url has no target line. Equal digests of unequal payloads stop the run. An empty table gives an empty archive.
    """
    data = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", data.alias("payload"))
    p = p.withColumns({"n": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "sha256": F.sha2("payload", 256)})
    other = F.xxhash64("payload")
    stored = p.groupBy("sha256").agg(F.first("payload").alias("payload"), F.min(F.struct("n", "sha1", other)).alias("a"), F.max(F.struct("n", "sha1", other)).alias("b"))
    sound = F.when(F.col("a") == F.col("b"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("sha256"))).cast("binary"))
    stored.select(F.col("sha256").alias("digest"), sound.alias("payload")).write.parquet(f"{place}/payloads")
    headers(written(p.drop("payload")), date, least).write.parquet(f"{place}/headers")


def told(name: str) -> Column:
    """The value of a header line, null where there is none. Only the WARC header is searched."""
    head = F.substring_index("header", CRLF + CRLF, 1)
    found = F.regexp_extract(head, f"\\r\\n{name}: ([^\\r\\n]*)", 1)
    return F.when(found != "", found)


def records(spark: SparkSession, place: str) -> DataFrame:
    """The records of an archive: page_id, record_type, target, declared digest and length, refers_to, header, payload (that of the response for a
    revisit) and fault: what contradicts the header or the digest, null for a sound record."""
    h, p = (spark.read.parquet(f"{place}/{x}") for x in ("headers", "payloads"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload"), "true": F.sha2("payload", 256)})
    number = lambda name: F.regexp_extract(told(name), "^<urn:page:(-?[0-9]+)>$", 1)
    id_of = lambda name: F.when(number(name) != "", number(name).cast("long"))
    both = h.drop("page_id").join(p, F.col("payload_digest") == F.col("digest"), "left")
    size = F.length("header") - F.length(F.substring_index("header", CRLF + CRLF, 1)) - 4  # of the HTTP header; both are ASCII from there
    length = size + F.when(told("WARC-Type") == "revisit", 0).otherwise(F.col("payload_bytes"))
    fault = F.when(F.col("digest").isNull(), "no payload").when(F.col("true") != F.col("digest"), "payload differs from its digest").when(~told("WARC-Payload-Digest").eqNullSafe(F.concat(F.lit("sha1:"), F.col("sha1"))), "header names another digest").when(
        told("Content-Length") != length.cast("string"), "header names another length")
    return both.select(id_of("WARC-Record-ID").alias("page_id"), told("WARC-Type").alias("record_type"), told("WARC-Target-URI").alias("target"), F.col("sha1").alias("payload_digest"), "payload_bytes", id_of("WARC-Refers-To").alias("refers_to"), "header", "payload", fault.alias("fault"))


def export(found: DataFrame, place: str, most: int = 20_000) -> None:
    """Write records as .warc.gz files of at most most records each. Payloads have to be UTF-8, as those of archive() are."""
    body = F.when(F.col("record_type") == "revisit", "").otherwise(F.col("payload").cast("string"))
    text = F.concat("header", body, F.lit(CRLF))  # the line separator is the other half of a record's end
    found.select(text.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", most).text(place)


def parsed(data: bytes):
    """(header with the HTTP header, payload) of each record of a WARC file, by the lengths that the headers name."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        n = next(int(x.split(b":", 1)[1]) for x in data[at:end].split(b"\r\n") if x.lower().startswith(b"content-length:"))
        block = data[end : end + n]
        http = block.index(b"\r\n\r\n") + 4 if b"\r\n\r\n" in block else 0
        yield data[at:end] + block[:http], block[http:]
        at = end + n + 4


def load(spark: SparkSession, place: str) -> DataFrame:
    """(header, payload) of the records of .warc.gz files; a file is one task's, whose size export() bounds."""
    import gzip

    import pyarrow as pa

    def scan(batches):
        for batch in batches:
            for x in batch.column(0):
                rows = list(parsed(gzip.decompress(x.as_buffer())))
                yield pa.record_batch([pa.array([h.decode() for h, _ in rows], pa.string()), pa.array([p for _, p in rows], pa.binary())], ["header", "payload"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(place).select("content")
    return files.mapInArrow(scan, "header string, payload binary")


def op11_warc_archive(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    place = folder(spark, "warc-")
    archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"), place)
    found = records(spark, place)
    sound = F.when(F.col("fault").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat(F.lit("unsound record: "), F.col("fault"))).cast("string"))
    return found.select("page_id", "payload_bytes", "payload_digest", sound.alias("record_type"), "refers_to")


def op11_sql() -> str:
    return """SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
    FROM (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS kept FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))"""
