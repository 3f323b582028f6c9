"""WARC archives without repeated payloads, and their reading with revisits resolved.

Only headers (ids, lengths, digests) are shuffled by payload digest to choose
the response of each payload; the other records become revisits, which are made
from headers alone.  Payloads move once, to meet the choice.  Records are text
with declared lengths, written by Spark's own writer, so that a retried or lost
task leaves no half archive behind, on any file system that Spark knows.

Every record of a set of archives names the set's warcinfo record, a fresh
random id.  That line starts each record and, being drawn after the payloads
exist, stands nowhere else: Spark's text reader splits the archives at it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

CRLF = "\r\n"
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK"
#: Payloads of fewer bytes are always written out.
LEAST_BYTES = 1000


@dataclass(frozen=True)
class Archives:
    """A folder of archives and the id of its warcinfo record."""

    path: str
    info: str

    @property
    def start(self) -> str:
        """What every response and revisit begins with."""
        return f"{VERSION}{CRLF}WARC-Warcinfo-ID: <urn:uuid:{self.info}>{CRLF}"


def _urn(*parts: Column) -> Column:
    """A record id that depends on the parts alone."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _one_line(value: Column) -> Column:
    """Line breaks would end a header."""
    return F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat_ws(CRLF, *[F.concat(F.lit(f"{name}: "), value) for name, value in fields])


def headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, sha1, key, n): rows alike in id, url and payload are counted together.

    ``key`` is a SHA-256, so that two payloads of one SHA-1 stay apart.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    return (
        pages.select("page_id", "url", F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha1(html).alias("sha1"), F.unhex(F.sha2(html, 256)).alias("key"))
        .groupBy("page_id", "url", "payload_bytes", "sha1", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def resolve(found: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``found`` with the number of responses and revisits among its n rows, and the response's id and url.

    Of equal payloads of at least ``least_bytes`` the row with the largest
    page_id is the response, null ids last, then the largest url, then any one.
    """
    first = F.max(F.struct("page_id", "url"))
    tops = scratch.put("tops", found.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("key").alias("__key")).agg(first.alias("__top")))
    mine = F.col("page_id").eqNullSafe(F.col("__top.page_id")) & F.col("url").eqNullSafe(F.col("__top.url"))
    responses = F.when(F.col("__key").isNull(), F.col("n")).when(mine, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return (
        found.join(tops, F.col("key") == F.col("__key"), "left")
        .withColumn("responses", responses)
        .withColumn("revisits", F.col("n") - F.col("responses"))
        .withColumn("to_id", F.col("__top.page_id"))
        .withColumn("to_url", F.col("__top.url"))
        .drop("__key", "__top")
    )


def _record(start: str, kind: str, record_id: Column, more: list[tuple[str, Column]], head: Column, payload: Column | None, date: str) -> Column:
    """A record but for its very last line feed, which the writer adds."""
    block_bytes = F.octet_length(head) + (F.octet_length(payload) if payload is not None else F.lit(0))
    fields = _lines(
        ("WARC-Type", F.lit(kind)),
        ("WARC-Record-ID", record_id),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", _one_line(F.col("url"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("X-Page-ID", F.col("page_id").cast("string")),
        *more,
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", block_bytes.cast("string")),
    )
    parts = [F.lit(start), fields, F.lit(CRLF * 2), head, *([payload] if payload is not None else []), F.lit(CRLF + "\r")]
    return F.concat(*parts)


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str | None = None) -> Archives:
    """Writes one record per row of ``pages`` (page_id, url, html) under ``path``, with fresh headers.

    Null html is an empty payload; a null url or id leaves its header out; line
    breaks in urls are written as %0D and %0A.  Other columns are ignored.  An
    empty table gives archives with a warcinfo record only.  Records are never
    split: a page may be as long as a Spark string.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    archives = Archives(path, str(uuid.uuid4()))
    now = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    found = scratch.put("headers", headers(pages))
    known = scratch.put("resolved", resolve(found, scratch, least_bytes))
    info = F.lit(archives.info)
    record_id = lambda copy: _urn(info, F.col("page_id"), F.col("url"), F.hex("key"), copy)
    # Responses: the rows with payload that are wanted; among rows alike that are a response once, any one.
    wanted = known.where("responses > 0").select(F.col("page_id").alias("__id"), F.col("url").alias("__url"), F.col("key").alias("__key"), "sha1", "payload_bytes", "n", "responses")
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("payload"), F.unhex(F.sha2(html, 256)).alias("key"))
    same = F.col("page_id").eqNullSafe(F.col("__id")) & F.col("url").eqNullSafe(F.col("__url")) & (F.col("key") == F.col("__key"))
    bodies = rows.join(wanted, same)
    kept = ["page_id", "url", "key", "sha1", "payload_bytes"]
    plain = bodies.where("n = responses").select(*kept, "payload", F.monotonically_increasing_id().alias("copy"))
    if not wanted.where("n > responses").isEmpty():
        once = bodies.where("n > responses").groupBy(*kept).agg(F.first("payload").alias("payload")).withColumn("copy", F.lit(0).cast("bigint"))
        plain = plain.unionByName(once)
    head = F.concat(F.lit(f"{HTTP}{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    big = F.col("payload_bytes") >= least_bytes
    # A response that others refer to has an id that they can tell from its headers.
    response_id = F.when(big, record_id(F.lit("response"))).otherwise(record_id(F.concat(F.lit("small"), F.col("copy").cast("string"))))
    responses = plain.select(_record(archives.start, "response", response_id, [], head, F.col("payload"), now).alias("value"))
    # Revisits: headers only, as many as there are rows.
    again = known.where("revisits > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("revisits"))))
    target = _urn(info, F.col("to_id"), F.col("to_url"), F.hex("key"), F.lit("response"))
    refers = [
        ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", target),
        ("WARC-Refers-To-Target-URI", _one_line(F.col("to_url"))),
        ("WARC-Refers-To-Date", F.lit(now)),
    ]
    bare = F.lit(f"{HTTP}{CRLF}Content-Type: text/html; charset=utf-8{CRLF * 2}")
    revisits = again.select(_record(archives.start, "revisit", record_id(F.concat(F.lit("revisit"), F.col("copy").cast("string"))), refers, bare, None, now).alias("value"))
    about = f"software: layerloom{CRLF}format: WARC File Format 1.1{CRLF}"
    opening = (
        f"{VERSION}{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:{archives.info}>{CRLF}WARC-Date: {now}{CRLF}"
        f"Content-Type: application/warc-fields{CRLF}Content-Length: {len(about)}{CRLF}{CRLF}{about}{CRLF}\r"
    )
    first = spark.range(1).select(F.lit(opening).alias("value"))
    first.unionByName(responses).unionByName(revisits).write.mode("overwrite").option("lineSep", "\n").option("compression", "gzip").text(path)
    return archives


def open_archives(spark: SparkSession, path: str) -> Archives:
    """Archives that ``write_archives`` left under ``path``, by their warcinfo record."""
    line = spark.read.option("lineSep", f"{VERSION}{CRLF}").text(path).where(F.col("value").startswith("WARC-Type: warcinfo"))
    row = line.select(F.regexp_extract("value", r"WARC-Record-ID: <urn:uuid:([0-9a-f-]+)>", 1).alias("info")).first()
    if row is None:
        raise ValueError(f"no warcinfo record under {path}")
    return Archives(path, row["info"])


def read_records(spark: SparkSession, archives: Archives) -> DataFrame:
    """(type, record_id, refers_to_id, page_id, url, stated_digest, payload): one row per response and revisit.

    The payload of a response is what its Content-Length leaves after the HTTP
    headers, as binary; a revisit has none.
    """
    found = spark.read.option("lineSep", archives.start).text(archives.path).where(F.col("value").startswith("WARC-Type: re"))
    head = F.substring_index("value", CRLF * 2, 1)
    field = lambda name: F.col("fields")[name]
    parsed = found.withColumn("head", head).withColumn("fields", F.str_to_map("head", F.lit(CRLF), F.lit(": ")))
    raw = F.col("value").cast("binary")
    block = F.substring(raw, F.octet_length("head") + 5, field("Content-Length").cast("int"))
    http = F.octet_length(F.substring_index(F.expr("substring(value, length(head) + 5)"), CRLF * 2, 1)) + 4
    payload = F.substring(block, http + 1, field("Content-Length").cast("int"))
    return parsed.select(
        field("WARC-Type").alias("type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Refers-To").alias("refers_to_id"),
        field("X-Page-ID").cast("bigint").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
        F.when(field("WARC-Type") == "response", payload).alias("payload"),
    )


def read_pages(spark: SparkSession, archives: Archives) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits joined with the response they refer to.

    Lengths and digests are taken from the payloads read, not from headers; a
    revisit whose response is missing, or states another digest, has nulls.
    """
    scratch = Scratch(spark, "warc-read")
    seen = scratch.put(
        "seen",
        read_records(spark, archives).select(
            "type", "record_id", "refers_to_id", "page_id", "stated_digest",
            F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
        ),
    )
    originals = seen.where("type = 'response'")
    whole = originals.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("bigint").alias("refers_to"))
    targets = originals.select(F.col("record_id").alias("__rid"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes"), F.col("page_id").alias("__page"))
    revisits = (
        seen.where("type = 'revisit'").select("page_id", "refers_to_id", "stated_digest")
        .join(targets, (F.col("stated_digest") == F.col("__digest")) & (F.col("refers_to_id") == F.col("__rid")), "left")
        .select("page_id", F.col("__bytes").alias("payload_bytes"), F.col("__digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("__page").alias("refers_to"))
    )
    return whole.unionByName(revisits)
