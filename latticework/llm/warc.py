r"""WARC as a content-addressed archive.

Two Parquet tables make an archive. ``payloads`` holds the bytes of each distinct payload once, addressed by their
SHA-256 (checked whenever they are read); ``headers`` holds, for each record, its exact WARC and HTTP header bytes and
the address of its payload. A join on the address gives back the original records, byte for byte; both tables are bucketed by the
address, so the join moves no payload. Reading parses those bytes: header lines, then the block by its stated length, then the payload in it.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the largest id (ties: largest url, then last
of equal rows) is a response and the others are revisits of it; smaller ones are all responses.

Only addresses and headers are grouped and joined on hot payloads; payload bytes are combined per map task before the
one shuffle that stores them, and a join whose one side is a hot address is split by adaptive execution.

Edge cases: a very long payload is one cell (2 GB) and one record; a null html is the empty payload; a null url has no target header field; a null id has no id header field and
is less than any other; equal rows are records of their own (one response, the others revisits); an empty table gives
empty archives; extra columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import get_bucketed, put_bucketed, scratch, stored, table

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a digest of a multiple of 20 bits, given in hexadecimal; SHA-1 has 8 times 20."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(*parts: Column) -> Column:
    """A record id that follows from what the record is."""
    h = F.sha2(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("\0")) for p in parts)), 256)
    at = lambda i, n: F.substring(h, i, n)
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-8"), at(14, 3), F.lit("-8"), at(18, 3), F.lit("-"), at(21, 12), F.lit(">"))


def line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null. Line ends within a value are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def field(header: Column, name: str) -> Column:
    """The value of a header line, or null."""
    return F.nullif(F.regexp_extract(header, rf"\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


@dataclass(frozen=True)
class Archive:
    """Where the two tables of an archive lie, and in how many buckets."""

    path: str
    buckets: int

    @property
    def headers(self) -> str:
        return f"{self.path}/headers"

    @property
    def payloads(self) -> str:
        return f"{self.path}/payloads"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> Archive:
    """Write a record for each row."""
    archive = Archive(path, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha2("payload", 256).alias("address"))

    once = rows.select("address", "payload").groupBy("address").agg(F.first("payload").alias("payload"))
    put_bucketed(once, archive.payloads, "address", archive.buckets)

    facts = rows.select("id", "url", "address", base32(F.sha1("payload")).alias("sha1"), F.octet_length("payload").alias("size"))
    facts = facts.groupBy("id", "url", "address", "sha1", "size").count()
    facts = facts.select("id", "url", "address", "sha1", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("nth"))
    me = F.struct("id", "url", "nth")
    first = facts.groupBy("address").agg(F.max(me).alias("first"))
    records = facts.join(first, "address")

    revisit = (F.col("size") >= min_bytes) & ~me.eqNullSafe(F.col("first"))
    kind = F.when(revisit, "revisit").otherwise("response")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("size")), F.lit("\r\n"))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    other = lambda c: F.when(revisit, c)
    header = F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", urn(F.col("id"), F.col("url"), F.col("address"), F.col("nth"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Profile", other(F.lit(PROFILE))),
        line("WARC-Refers-To", other(urn(F.col("first.id"), F.col("first.url"), F.col("address"), F.col("first.nth")))),
        line("WARC-Refers-To-Target-URI", other(F.col("first.url"))),
        line("X-Row-ID", F.col("id")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", length),
        F.lit("\r\n"),
    )
    out = records.select("address", F.encode(header, "UTF-8").alias("header"), F.encode(http, "UTF-8").alias("http"))
    put_bucketed(out, archive.headers, "address", archive.buckets)
    return archive


def verified(spark: SparkSession, archive: Archive) -> DataFrame:
    """Payloads whose bytes have the digest they are addressed by; any other stops the job."""
    p = get_bucketed(spark, archive.payloads, "address string, payload binary", "address", archive.buckets)
    wrong = F.raise_error(F.concat(F.lit("damaged payload "), F.col("address")))
    return p.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(wrong))


def headers(spark: SparkSession, archive: Archive) -> DataFrame:
    h = get_bucketed(spark, archive.headers, "address string, header binary, http binary", "address", archive.buckets)
    return h.withColumn("type", field(F.decode("header", "UTF-8"), "WARC-Type"))


def reconstruct(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records: ``record`` (binary, whole) and the full ``payload`` that it holds or refers to."""
    h = headers(spark, archive).join(verified(spark, archive), "address")
    held = F.when(F.col("type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return h.select(F.concat("header", "http", held, F.encode(F.lit(END), "UTF-8")).alias("record"), "payload")


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records as ``reconstruct`` makes them, without the payloads that revisits refer to."""
    h, end = headers(spark, archive), F.encode(F.lit(END), "UTF-8")
    whole = h.filter("type = 'response'").join(verified(spark, archive), "address").select(F.concat("header", "http", "payload", end).alias("record"))
    return whole.unionAll(h.filter("type <> 'response'").select(F.concat("header", "http", end).alias("record")))


def parsed(found: DataFrame) -> DataFrame:
    """From the bytes of ``record``: ``head`` (WARC header, text) and ``payload``. A record whose parts don't have the lengths that it states stops the job."""
    upto = lambda c: F.substring_index(F.col(c).cast("string"), END, 1)
    size = lambda c: F.octet_length(c).cast("int")
    rows = found.withColumn("head", upto("record"))
    rows = rows.withColumn("length", field(F.concat("head", F.lit("\r\n")), "Content-Length").cast("int"))
    wrong = F.raise_error(F.concat(F.lit("record without its stated length: "), F.col("head"))).cast("binary")
    fits = size("record") == size("head") + F.col("length") + 2 * len(END)
    rows = rows.withColumn("block", F.when(fits, F.substring("record", size("head") + len(END) + 1, F.col("length"))).otherwise(wrong))
    http = size(upto("block")) + len(END)
    return rows.select(F.concat("head", F.lit("\r\n")).alias("head"), F.substring("block", http + 1, size("block") - http).alias("payload"))


def index(spark: SparkSession, archive: Archive) -> DataFrame:
    """Read the archive back: a row per record, from its bytes; a revisit's payload is that of the record it refers to."""
    rows = parsed(records(spark, archive))
    names = (("page_id", "X-Row-ID"), ("record_type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("refers", "WARC-Refers-To"), ("said", "WARC-Payload-Digest"))
    rows = rows.select(*(field(F.col("head"), n).alias(a) for a, n in names), F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    rows = stored(rows.withColumn("page_id", F.col("page_id").cast("long")), "records")  # short columns; read twice below
    wrong = F.raise_error(F.concat(F.lit("digest in header differs: "), F.col("said")))
    digest = F.when(F.col("said") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.col("payload_digest")).otherwise(wrong).alias("payload_digest")
    first = rows.filter("record_type = 'response'")
    held = first.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    again = rows.filter("record_type = 'revisit'").select("page_id", "record_type", "refers", "said").join(held, "refers")
    columns = ["page_id", "payload_bytes", digest, "record_type"]
    return first.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionAll(again.select(*columns, "refers_to"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, write(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as n, sha1(b) as h, max(page_id) over (partition by b) as first from p),
x as (select *,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4)::int * 5 + 1, 5))::int // (32 ** (3 - i % 4))::int) % 32)::int + 1, 1)), '') as digest from d)
select page_id, n::bigint as payload_bytes, digest as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from x
"""
