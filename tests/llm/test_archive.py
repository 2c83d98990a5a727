"""The archive against what went in."""

import glob
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from doccensus.llm import archive
from doccensus.llm.shared import fresh_path

BIG = "<html>" + "shared page " * 20 + "</html>"
ROWS = [
    (5, "http://a/x", BIG), (3, "http://a/y", BIG), (9, None, BIG), (3, "http://a/y", BIG), (None, "http://a/z", BIG),
    (7, "http://a/small", "tiny"), (8, "http://a/small2", "tiny"), (10, "http://e/1", None), (11, "http://e/2", ""),
    (12, "http://n/\r\nX: y", "é" * 60 + "\r\n\r\nWARC/1.1\r\n"), (13, "u", "é" * 50), (14, "u", "é" * 50), (15, "u", "x" * 99), (16, "u", "x" * 99),
    (17, "long", "0123456789" * 200_000), (None, "v", "no id " * 30), (None, "w", "no id " * 30),
]
SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    clash = [F.lit(1).alias(x) for x in ("id", "digest", "payload", "size", "head", "kind", "first")]
    return spark.createDataFrame(ROWS, SCHEMA).select("*", *clash).repartition(4)


@pytest.fixture(scope="module")
def made(pages):
    return archive.write_archive(pages)


def _expected():
    out = []
    for page, _, html in ROWS:
        data = (html or "").encode()
        peers = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        first = min(peers, default=None)
        again = len(data) >= 100 and page != first
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_summary(spark, made):
    got = archive.summary(spark, made).select("id", "size", "digest", "kind", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == _expected()


def test_payloads_stand_once(spark, made):
    stored = archive.read_payloads(spark, made)
    assert stored.count() == len({h or "" for _, _, h in ROWS}) == stored.select("digest").distinct().count()


def test_originals_come_back_whole(spark, made):
    got = sorted(bytes(r["record"]) for r in archive.originals(spark, made).collect())
    assert len(got) == len(ROWS)
    want = sorted((h or "").encode() for _, _, h in ROWS)
    assert sorted(_split(x)[1] for x in got) == want
    assert all(b"WARC-Type: response" in _split(x)[0] for x in got)


def _split(record):
    """Header and payload, by the lengths that the record states."""
    end = record.index(b"\r\n\r\n") + 4
    length = int(dict(x.split(b": ", 1) for x in record[:end].split(b"\r\n")[1:] if x)[b"Content-Length"])
    assert record[end + length :] == b"\r\n\r\n"
    body = record.index(b"\r\n\r\n", end) + 4
    return record[:body], record[body : end + length]


def test_records_state_their_lengths(spark, made):
    for row in archive.records(spark, made).collect():
        head, payload = _split(bytes(row["record"]))
        if b"WARC-Type: revisit" in head:
            assert payload == b"" and b"WARC-Refers-To: <urn:page:" in head
        else:
            assert hashlib.sha256(payload).hexdigest().encode() in head


def test_files_round_trip(spark, made):
    path = fresh_path(spark, "warc-files")
    archive.write_warc(spark, made, path, per_file=4)
    files = glob.glob(f"{path.removeprefix('file:')}/*.gz")
    assert len(files) > 1 and all(gzip.open(f).read(8) == b"WARC/1.1" for f in files)
    want = sorted(bytes(r["record"]) for r in archive.records(spark, made).collect())
    got = sorted(r["head"].encode() + bytes(r["payload"]) + b"\r\n\r\n" for r in archive.read_warc(spark, path).collect())
    assert got == want


def test_damage_is_an_error(spark, made):
    other = archive.Archive(made.headers, fresh_path(spark, "warc-payloads"))
    spark.read.parquet(made.payloads).withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(other.payloads)
    with pytest.raises(Exception, match="damaged payload"):
        archive.summary(spark, other).collect()
    lost = archive.Archive(made.headers, fresh_path(spark, "warc-payloads"))
    spark.read.parquet(made.payloads).limit(2).write.parquet(lost.payloads)
    with pytest.raises(Exception, match="no payload"):
        archive.summary(spark, lost).collect()


def test_empty(spark):
    none = archive.write_archive(spark.createDataFrame([], SCHEMA))
    assert archive.summary(spark, none).count() == 0 and archive.originals(spark, none).count() == 0
