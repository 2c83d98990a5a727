"""Encoding, packing and token files against the tokenizers library and round trips."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from doccensus.llm import packing, token_files
from doccensus.llm.encoding import Encoder, default_vocabulary
from doccensus.llm.shared import fresh_path

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def coder():
    return Encoder(default_vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=list("ab'sré\n\t  .!,1—  \x1c"), max_size=40)), max_size=8))
def test_encoder_is_the_library(coder, plain, texts):
    assert [x.tolist() for x in coder.encode_all(texts)] == [plain(t) for t in texts]


def test_workers_keep_no_units(spark):
    """The Python workers that packed texts live on, without the units they learnt."""
    texts = spark.range(400).selectExpr("id AS doc_id", "concat('unit', id, ' of', id * 7) AS text").repartition(8)
    assert packing.pack_documents(texts).count() >= 400

    def known(batches):
        import sys

        for batch in batches:
            there = sys.modules.get("doccensus.llm.encoding")
            batch["id"] = sum(len(e._known) for e in there._ENCODERS.values()) if there else 0
            yield batch

    assert spark.range(64).repartition(32).mapInPandas(known, "id long").agg({"id": "max"}).first()[0] == 0


def test_encoder_forgets(coder, plain, monkeypatch):
    monkeypatch.setattr("doccensus.llm.encoding.MAX_UNITS", 3)
    texts = ["one two three", "four five six seven", "one two <|endoftext|>"] * 2
    assert [x.tolist() for t in texts for x in coder.encode_all([t])] == [plain(t) for t in texts]


def check_pieces(rows, expected, window):
    """Pieces make up the documents and the windows, each id once."""
    docs, windows = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"]
        docs.setdefault(r["doc_id"], []).append((r["start"], ids))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], len(ids)))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert 0 < at <= window
    got = sorted((k is None, k or 0, [i for _, p in sorted(v) for i in p]) for k, v in docs.items())
    assert got == sorted((k is None, k or 0, v) for k, v in expected)
    return [sum(n for _, n in p) for p in windows.values()]


@pytest.mark.parametrize("window", [16, 1024])
def test_packing(spark, plain, window):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = packing.pack_documents(docs, window).collect()
    expected = [(r["doc_id"], plain(r["text"]) + [0]) for r in docs.collect()]
    fill = check_pieces(rows, expected, window)
    # one task: only its last window has room
    assert sum(n < window for n in fill) <= 1


def test_sum_of_squares_takes_the_least():
    packer = packing.SumOfSquares(10, lambda pieces: None)
    draw = np.random.default_rng(0)
    for _ in range(400):
        size = int(draw.integers(1, 10))
        before = packer.counts.copy()

        def after(level):
            c = before.copy()
            if level:
                c[level] -= 1
            if level + size < 10:
                c[level + size] += 1
            return (c**2).sum()

        options = [0, *[h for h in range(1, 11 - size) if before[h] > 0]]
        best = min(after(h) for h in options)
        chosen = packer.level(size)
        assert after(chosen) == best and chosen == max(h for h in options if after(h) == best)
        packer.add(("d",), np.arange(size, dtype="<u4"))


def test_packing_odd_rows(odd, clashing, empty, plain):
    rows = packing.pack_documents(odd.dropDuplicates()).collect()
    check_pieces(rows, [(r["doc_id"], plain(r["text"]) + [0]) for r in odd.dropDuplicates().collect()], 1024)
    assert packing.pack_documents(clashing).count() >= odd.count()
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("width", [1, 7, 8, 13, 16, 17, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1001, dtype=np.uint64).astype("<u4")
    raw = token_files.pack_bits(ids, width)
    assert len(raw) == -(-1001 * width // 8)
    assert token_files.unpack_bits(raw, width, 1001).tolist() == ids.tolist()


def test_bit_width():
    assert [token_files.bit_width(n) for n in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


def test_shard_random_access(tmp_path):
    path = f"file://{tmp_path}/x.bin"
    writer, docs = token_files.ShardWriter(path, 13, block=64), []
    draw = np.random.default_rng(1)
    for k in range(200):
        docs.append((None if k == 0 else k, draw.integers(0, 8000, int(draw.integers(1, 90))).astype("<u4")))
        writer.add(*docs[-1])
    writer.close()
    shard = token_files.Shard(path)
    whole = np.concatenate([d for _, d in docs])
    for a, b in [(0, 1), (63, 65), (64, 64), (100, 3000), (0, len(whole)), (len(whole) - 1, len(whole))]:
        assert shard.ids(a, b).tolist() == whole[a:b].tolist()
    assert [shard.document(k).tolist() for k in (0, 7, 199)] == [docs[k][1].tolist() for k in (0, 7, 199)]
    assert [(i, x.tolist()) for i, _, x in shard.documents(group=100)] == [(i, x.tolist()) for i, x in docs]


def test_token_files(spark, odd, clashing, empty, plain):
    for frame in (spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(5), odd, clashing):
        rows = token_files.read_token_files(token_files.write_token_files(frame)).collect()
        rows.sort(key=lambda r: r["start"])
        given_ = [(r["doc_id"] if r["doc_id"] is not None else -1, plain(r["text"]) + [2]) for r in frame.collect()]
        got = [(r["doc_id"] if r["doc_id"] is not None else -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in rows]
        assert [x[0] for x in got] == sorted(x[0] for x in given_) and sorted(got) == sorted(given_)
        at = 0
        for r in rows:
            assert r["start"] == at
            at += r["n_tokens"]
    assert token_files.read_token_files(token_files.write_token_files(empty)).count() == 0


def test_each_shard_has_a_reader(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_token_files(docs)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    readers = token_files.read_token_files(manifest, digest=True).groupBy(F.spark_partition_id().alias("task")).count()
    assert manifest.count() > 2 and readers.count() == manifest.count()


def test_manifest_names_what_counts(spark, odd):
    folder = fresh_path(spark, "tokens")
    manifest = token_files.write_token_files(odd, folder)
    again = token_files.read_token_files(token_files.read_manifest(spark, folder), digest=True)
    assert manifest.count() >= 1
    for r in again.join(token_files.read_token_files(manifest).withColumnRenamed("n_tokens", "n"), ["doc_id", "start"]).collect():
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and r["n"] == r["n_tokens"]
