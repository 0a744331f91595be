"""WARC derivatives: linked metadata and plain-text conversion records of responses."""

from __future__ import annotations

import gzip
import os
import uuid
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

#: What plain text drops whole: comments, scripts and styles; what is not closed goes on to the end of the page.
DROPPED = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
#: Then the head, which ends with its end tag or before the first tag of an element that no head can hold, as both </head> and <body> may be left out.
HEAD = r"(?is)<head\b.*?(?:</head\s*>|(?=<(?!(?:base|basefont|bgsound|head|link|meta|noframes|noscript|script|style|template|title)\b)[a-z])|\z)"
#: What is between a tag's name and its end: attributes, of which the first 64 may have a > in a quoted value, or anything but < and >.
REST = r"""(?:(?:[^<>=]*+=[ \t\r\n\f]*+(?:"[^"<]*+"|'[^'<]*+')?+){0,64}+[^<>]*+>|[^<>]*+>)"""
#: Tags that end a line, then all other tags; a < before anything but a letter, a slash, ! or ? is text.
BREAKS = r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|title|main|aside|pre|blockquote|hr)\b" + REST
TAGS = r"<[A-Za-z/!?]" + REST
#: Date of responses that have none, in RFC 3339 as WARC wants it.
DATE = "1970-01-01T00:00:00Z"


def decoded(text: Column) -> Column:
    """Character references become characters: decimal, hexadecimal and the names of HTML 4 (and apos), all ended by a semicolon; others stay."""
    names = F.create_map(*[F.lit(x) for name, code in sorted((name2codepoint | {"apos": 39}).items()) for x in (name, chr(code))])

    def one(part: Column, i: Column) -> Column:
        name = F.substring_index(part, ";", 1)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        digits = F.when(name.rlike("^#[0-9]{1,7}$"), F.conv(F.substring(name, F.lit(2), F.lit(7)), 10, 16)).when(name.rlike("^#[xX][0-9A-Fa-f]{1,6}$"), F.substring(name, F.lit(3), F.lit(6)))
        number = F.conv(digits, 16, 10).cast("int")
        valid = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        found = F.coalesce(char, F.when(name.rlike("^[A-Za-z][A-Za-z0-9]{1,9}$"), F.try_element_at(names, name)))
        return F.when((i > 0) & part.contains(";") & found.isNotNull(), F.concat(found, rest)).otherwise(F.when(i > 0, F.concat(F.lit("&"), part)).otherwise(part))

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&", -1), one), "")).otherwise(text)


def plain_text(html: Column) -> Column:
    """Text of a page: comments, scripts, styles and head go, block tags end lines, references are decoded, white space is joined.

    A head without end tag ends where the page's content begins. A > in a quoted attribute does not end its tag.

    Each pattern passes once over the page, however many tags are left open.
    """
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DROPPED, ""), HEAD, ""), BREAKS, "\n"), TAGS, "")
    text = F.regexp_replace(F.regexp_replace(decoded(text), "[ \u00a0\t\r\f]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def record_uuid(kind: str, *parts: Column) -> Column:
    """urn:uuid that follows from the parts, so that reruns give equal names (version 8 layout)."""
    h = F.sha2(F.concat_ws("\n", F.lit(kind), *parts), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-8"), cut[2], F.lit("-a"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def derivatives(responses: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html", headers_col: str | None = None, date_col: str | None = None) -> DataFrame:
    """Two records for each response: warc_type metadata and conversion, both linked to it.

    Columns: page_id, warc_type, record_id, refers_to (the response's record id), target_uri, warc_date,
    refers_to_date, source_digest (of the response's payload), source_headers (its HTTP headers, kept),
    content_type, block_digest, content_length (bytes of block), block.

    Dates (text in RFC 3339, or a timestamp, which is written in UTC with its fraction; one without zone counts as UTC) and
    HTTP headers are the table's where it has such columns; without them, DATE and no headers, as nothing is known. Record ids follow from page_id, uri, date and payload digest,
    so that reruns agree and captures differ. Repeated rows: the same capture met again, the same records again.
    Null or empty body: a conversion with an empty block. Null uri: target_uri is null, named as an empty one in
    ids. Null headers: none. Very long bodies: whole. Empty table: no rows. Other columns are not read.
    """
    date = F.lit(DATE)
    if date_col is not None:
        kind = responses.schema[date_col].dataType.typeName()
        utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.unix_micros(date_col) / F.lit(1_000_000).cast("decimal(20,0)")).cast("decimal(18,6)")) if kind == "timestamp" else F.col(date_col)
        said = F.concat(F.replace(utc.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z")) if kind.startswith("timestamp") else F.col(date_col).cast("string")
        date = F.coalesce(said, F.lit(DATE))
    head = F.lit("") if headers_col is None else F.coalesce(F.col(headers_col), F.lit(""))
    rows = responses.select(F.col(id_col).alias("page_id"), F.col(uri_col).alias("target_uri"), date.alias("warc_date"), head.alias("source_headers"), F.coalesce(F.col(body_col), F.lit("")).alias("body"))
    rows = rows.withColumn("source_digest", F.concat(F.lit("sha256:"), F.sha2("body", 256))).withColumn("text", plain_text(F.col("body")))
    uri = F.coalesce("target_uri", F.lit(""))
    rows = rows.withColumn("refers_to", record_uuid("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri, F.col("warc_date"), F.col("source_digest")))
    fields = F.concat(
        F.lit("sourceDigest: "), F.col("source_digest"), F.lit("\r\nsourceLength: "), F.octet_length("body").cast("string"),
        F.lit("\r\ntextLength: "), F.octet_length("text").cast("string"), F.lit("\r\ntitle: "),
        F.trim(F.regexp_replace(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title\s*>", 1), r"[ \t\r\n\f]+", " ")), F.lit("\r\n"),
    )
    kinds = F.explode(F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=UTF-8").alias("content_type"), F.col("text").alias("block")),
    ))
    each = rows.select("page_id", "target_uri", "warc_date", "source_headers", "source_digest", "refers_to", kinds.alias("r"))
    each = each.select("page_id", "target_uri", "warc_date", F.col("warc_date").alias("refers_to_date"), "source_headers", "source_digest", "refers_to", "r.*")
    record = F.when(F.col("warc_type") == "metadata", record_uuid("metadata", F.col("refers_to"))).otherwise(record_uuid("conversion", F.col("refers_to")))
    return each.select(
        "page_id", "warc_type", record.alias("record_id"), "refers_to", "target_uri", "warc_date", "refers_to_date", "source_digest", "source_headers", "content_type",
        F.concat(F.lit("sha256:"), F.sha2("block", 256)).alias("block_digest"), F.octet_length("block").cast("long").alias("content_length"), "block",
    )


def record_text(warc_type: str = "warc_type") -> Column:
    """A record of derivatives() as WARC/1.1 text, without the two line ends after it. Line ends in a field's value are written as in a URI."""
    plain = lambda c: F.replace(F.replace(F.col(c).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), plain(c), F.lit("\r\n")), F.lit(""))
    named = (
        ("WARC-Type", warc_type), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To-Target-URI", "target_uri"),
        ("WARC-Date", "warc_date"), ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "source_digest"),
    )
    kept = F.transform(F.filter(F.split("source_headers", "\r?\n"), lambda h: h != ""), lambda h: F.concat(F.lit("WARC-Source-Header: "), h, F.lit("\r\n")))
    more = (("Content-Type", "content_type"), ("Content-Length", "content_length"))
    return F.concat(F.lit("WARC/1.1\r\n"), *[line(*x) for x in named], F.array_join(kept, ""), *[line(*x) for x in more], F.lit("\r\n"), F.col("block"))


def warcinfo(name: str) -> bytes:
    """The record that a WARC file begins with."""
    block = b"software: brindle\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\n"
    return f"{head}Content-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block


def write_warc(records: DataFrame, path: str) -> DataFrame:
    """Write the records of derivatives() as WARC files in a folder, one for each partition, and return their index: (file, offset, length, record_id).

    Each record is a gzip member of its own, so that it can be read alone by its place; each file begins with a
    warcinfo record. Executors write through Arrow's file systems (a mounted folder, HDFS, S3, GCS), to a name of
    the attempt, so that a task run twice leaves no half file under a name that the index has. The index is
    written beside the files, as Parquet, when all of them are there.
    """
    spark = records.sparkSession
    ship(spark)
    where = path if "://" in path else "file://" + os.path.abspath(path)

    def work(batches):
        from pyarrow.fs import FileSystem

        fs, folder = FileSystem.from_uri(where)
        fs.create_dir(folder, recursive=True)
        name, at, rows, out = f"part-{uuid.uuid4().hex}.warc.gz", 0, [], None
        for batch in batches:
            for record_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                    first = gzip.compress(warcinfo(name) + b"\r\n\r\n", mtime=0)
                    at += out.write(first)
                member = gzip.compress(text.encode() + b"\r\n\r\n", mtime=0)
                rows.append((name, at, len(member), record_id))
                at += out.write(member)
        if out is not None:
            out.close()
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3])], ["file", "offset", "length", "record_id"])

    index = records.select("record_id", record_text().alias("text")).mapInArrow(work, "file string, offset long, length long, record_id string")
    index.write.parquet(f"{where}/index.parquet")
    return spark.read.parquet(f"{where}/index.parquet")
