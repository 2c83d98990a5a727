"""A content-addressed web archive: payload bytes once, exact record headers beside them, records rebuilt by joins.

An archive is two Parquet tables in the shared folder. ``payloads`` holds each distinct payload once under its SHA-256;
``headers`` holds a row for each record: the exact header of the WARC record that stands in the archive (``head``), for a
revisit also the header the record came with (``original``), and the payload's digest. Of records with equal payloads of
at least ``MIN_SHARED`` bytes the one of least id is a ``response``, the others are ``revisit`` records that refer to it;
smaller payloads are stored once too, but each of their records is a response.

How it runs: a digest's payload is reduced on the map side, so a payload that a third of all pages have is sent once by
each task; the deciding of responses shuffles ids and digests only. Equal digests are held against lengths and a second
hash when they meet (one payload stored for two different ones would be an error), and every payload read is hashed again.
``records`` and ``originals`` join headers with payloads on the digest, where Spark splits a hot digest.

``write_warc`` writes the records as WARC 1.1 files, which end each record with an empty line as Spark's text
writer ends a row; ``read_warc`` reads such files.

Defined cases: null html is an empty payload; a null url leaves out the target line, line breaks in urls are
percent-encoded there; a null id sorts after all others and reads back as null, so equal payloads without any id are all
responses; rows that repeat the least id are responses too, of one stored payload; an empty table gives an empty
archive; other columns are ignored.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doccensus.llm.shared import fresh_path

#: payloads below this size are never revisited
MIN_SHARED = 100
#: the pages carry no time of their own
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
#: records of one WARC file
PER_FILE = 20_000


@dataclass(frozen=True)
class Archive:
    headers: str
    payloads: str


def _line(name: str, value: Column) -> Column:
    """A header line; empty where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def _uri(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def _http_head(size: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), size.cast("string"), F.lit(EOL * 2))


def _head(kind: str, key: Column, url: Column, digest: Column, size: Column, refers: Column | None = None) -> Column:
    """WARC header, empty line and HTTP header of a record; the block of a revisit is its HTTP header alone."""
    http = _http_head(size)
    clean = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    block = F.length(http) if refers is not None else F.length(http) + size
    more = [] if refers is None else [_line("WARC-Refers-To", _uri(refers)), _line("WARC-Profile", F.lit(PROFILE))]
    return F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: {kind}{EOL}"), _line("WARC-Record-ID", _uri(key)), _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", clean),
        *more, _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")), F.lit(EOL), http,
    )


def write_archive(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", min_shared: int = MIN_SHARED) -> Archive:
    """Write one record for each page; returns where the two tables are."""
    spark = pages.sparkSession
    made = Archive(fresh_path(spark, "warc-headers"), fresh_path(spark, "warc-payloads"))
    given = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("payload"))
    hashed = given.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})

    check = F.xxhash64("payload")
    stored = hashed.groupBy("digest").agg(
        F.first("payload").alias("payload"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.min(check).alias("one"), F.max(check).alias("other")
    )
    same = (F.col("lo") == F.col("hi")) & (F.col("one") == F.col("other"))
    sure = F.when(same, F.col("digest")).otherwise(F.raise_error(F.concat(F.lit("different payloads under "), F.col("digest"))))
    stored.select(sure.alias("digest"), "payload").write.option("compression", "zstd").parquet(made.payloads)

    narrow = hashed.select("id", "url", "digest", "size")
    least = narrow.groupBy("digest").agg(F.min("id").alias("first"))
    revisit = (F.col("size") >= min_shared) & ~F.col("id").eqNullSafe(F.col("first"))
    response = _head("response", F.col("id"), F.col("url"), F.col("digest"), F.col("size"))
    again = _head("revisit", F.col("id"), F.col("url"), F.col("digest"), F.col("size"), F.col("first"))
    narrow.join(least, "digest").select(
        "id", F.when(revisit, again).otherwise(response).alias("head"), F.when(revisit, response).alias("original"), "digest"
    ).write.option("compression", "zstd").parquet(made.headers)
    return made


def field(head: Column, name: str) -> Column:
    """Value of a WARC header line, null where there is none."""
    return F.nullif(F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def _page(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")


def read_headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """id, kind, refers_to, digest, as the WARC headers of the archive say, and the headers."""
    return spark.read.parquet(archive.headers).select(
        _page(field(F.col("head"), "WARC-Record-ID")).alias("id"), field(F.col("head"), "WARC-Type").alias("kind"),
        _page(field(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
        F.regexp_extract(field(F.col("head"), "WARC-Payload-Digest"), "^sha256:([0-9a-f]{64})$", 1).alias("digest"), "head", "original",
    )


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """digest, payload, size; a payload that is not what its digest says is an error."""
    found = F.sha2("payload", 256)
    sure = F.when(found == F.col("digest"), found).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))))
    return spark.read.parquet(archive.payloads).select(sure.alias("digest"), "payload", F.octet_length("payload").cast("long").alias("size"))


def _joined(spark: SparkSession, archive: Archive, *columns: str) -> DataFrame:
    """Headers with what ``columns`` name of their payloads; a header without its payload is an error."""
    there = read_payloads(spark, archive).select("digest", "size", *columns)
    found = F.when(F.col("size").isNotNull(), F.col("size")).otherwise(F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))))
    return read_headers(spark, archive).join(there, "digest", "left").withColumn("size", found)


def summary(spark: SparkSession, archive: Archive) -> DataFrame:
    """id, kind, refers_to, digest, size of every record. Payloads are read and hashed once each; only sizes are joined."""
    return _joined(spark, archive).select("id", "kind", "refers_to", "digest", "size")


def records(spark: SparkSession, archive: Archive) -> DataFrame:
    """id, record: the bytes of every WARC record as archived, a revisit without its payload."""
    block = F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit(b""))
    return _joined(spark, archive, "payload").select("id", F.concat(F.encode("head", "UTF-8"), block, F.lit(b"\r\n\r\n")).alias("record"))


def originals(spark: SparkSession, archive: Archive) -> DataFrame:
    """id, record: the bytes of every record as it came, with the header it came with and its whole payload."""
    head = F.encode(F.coalesce("original", "head"), "UTF-8")
    return _joined(spark, archive, "payload").select("id", F.concat(head, "payload", F.lit(b"\r\n\r\n")).alias("record"))


def write_warc(spark: SparkSession, archive: Archive, path: str, per_file: int = PER_FILE) -> None:
    """The records as gzipped WARC files below ``path``."""
    lines = _joined(spark, archive, "payload").select(
        F.concat("head", F.when(F.col("kind") == "response", F.decode("payload", "UTF-8")).otherwise("")).alias("value")
    )
    lines.write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def _parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in files:
        for content in frame["content"]:
            data, at, rows = gzip.decompress(content), 0, []
            while at < len(data):
                end = data.index(b"\r\n\r\n", at) + 4
                lines = dict(x.split(b": ", 1) for x in data[at:end].split(b"\r\n")[1:] if x)
                stop = end + int(lines[b"Content-Length"])
                body = data.index(b"\r\n\r\n", end, stop) + 4
                rows.append((data[at:body].decode(), data[body:stop]))
                at = stop + 4
            yield pd.DataFrame(rows, columns=["head", "payload"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """head, payload of every record of gzipped WARC files; a file is read by one task."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInPandas(_parse, "head string, payload binary")
