"""Token ids of a corpus in bit-packed files, written and read by tasks.

Documents are ordered by ``doc_id`` with a range partitioning; each task encodes its range and writes one shard.
A shard holds ids of ``width`` bits, the least that the vocabulary needs, in blocks of ``BLOCK`` ids that begin at
byte boundaries:

    magic "DCBP0001" | width, ids per block, number of ids, number of documents: 4 x u64
    blocks | byte offset of each block: u64 each | per document: doc_id i64, has doc_id u64, first id u64
    offsets of the two tables: 2 x u64

Bit i of the packed ids is bit i % 8 of byte i // 8. A block is found by its offset and unpacked with numpy alone,
so any range of ids is read without its neighbours. The manifest, a Parquet table, names the shards that count:
a repeated or speculative task leaves a file that no manifest row names.

Defined cases: a null or empty text is the end id alone; null ``doc_id`` comes first; equal ``doc_id`` are ordered
by the text's hash and text; an empty table gives an empty manifest; other columns are ignored. Files go through
``pyarrow.fs``, so any store it knows by URI will do.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doccensus.llm.encoding import default_vocabulary, encoder
from doccensus.llm.shared import fresh_path

MAGIC = b"DCBP0001"
BLOCK = 8192
HEAD = len(MAGIC) + 32
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_bytes long"
_ROW = np.dtype([("doc_id", "<i8"), ("known", "<u8"), ("first", "<u8")])


def bit_width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids as ``width`` bits each, lowest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, width: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, dtype=f"<u{width // 8}", count=n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, dtype=np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return (bits.astype("<u4") << np.arange(width, dtype="<u4")).sum(axis=1, dtype="<u4")


class ShardWriter:
    def __init__(self, path: str, width: int, block: int = BLOCK):
        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self._out = store.open_output_stream(inner)
        self.width, self.block, self.n_ids, self.bytes = width, block, 0, 0
        self._held: list[np.ndarray] = []
        self._held_ids, self._offsets, self._rows = 0, [], []
        # sizes are only known at the end, so they stand in the last 48 bytes; the head holds the fixed part
        self._write(MAGIC + np.array([width, block, 0, 0], dtype="<u8").tobytes())

    def _write(self, raw: bytes) -> None:
        self._out.write(raw)
        self.bytes += len(raw)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self._held) if self._held else np.empty(0, dtype="<u4")
        stop = len(ids) if last else len(ids) - len(ids) % self.block
        for at in range(0, stop, self.block):
            self._offsets.append(self.bytes)
            self._write(pack_bits(ids[at : min(stop, at + self.block)], self.width))
        self._held, self._held_ids = [ids[stop:]], len(ids) - stop

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self._rows.append((doc_id or 0, doc_id is not None, self.n_ids))
        self._held.append(ids)
        self._held_ids += len(ids)
        self.n_ids += len(ids)
        if self._held_ids >= 64 * self.block:
            self._flush(False)

    def close(self) -> None:
        self._flush(True)
        offsets_at = self.bytes
        self._write(np.array(self._offsets, dtype="<u8").tobytes())
        rows_at = self.bytes
        self._write(np.array(self._rows, dtype=_ROW).tobytes())
        self._write(np.array([self.n_ids, len(self._rows), offsets_at, rows_at], dtype="<u8").tobytes())
        self._out.close()


class Shard:
    """Random access to the ids and documents of one shard."""

    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path)
        self._file = store.open_input_file(inner)
        head = self._at(0, HEAD)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is not a shard of packed ids")
        self.width, self.block = (int(x) for x in np.frombuffer(head, dtype="<u8", offset=len(MAGIC), count=2))
        size = self._file.size()
        self.n_ids, n_docs, offsets_at, rows_at = (int(x) for x in np.frombuffer(self._at(size - 32, 32), dtype="<u8"))
        self._offsets = np.append(np.frombuffer(self._at(offsets_at, rows_at - offsets_at), dtype="<u8"), offsets_at).astype(np.int64)
        self.rows = np.frombuffer(self._at(rows_at, n_docs * _ROW.itemsize), dtype=_ROW)

    def _at(self, at: int, n: int) -> bytes:
        return self._file.read_at(n, at)

    def ids(self, first: int, stop: int) -> np.ndarray:
        """Ids ``first`` to ``stop``; reads only the blocks that hold them."""
        if stop <= first:
            return np.empty(0, dtype="<u4")
        a, b = first // self.block, (stop - 1) // self.block
        raw = self._at(self._offsets[a], self._offsets[b + 1] - self._offsets[a])
        parts = []
        for k in range(a, b + 1):
            n = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack_bits(raw[self._offsets[k] - self._offsets[a] : self._offsets[k + 1] - self._offsets[a]], self.width, n))
        return np.concatenate(parts)[first - a * self.block : stop - a * self.block]

    def document(self, k: int) -> np.ndarray:
        stop = int(self.rows["first"][k + 1]) if k + 1 < len(self.rows) else self.n_ids
        return self.ids(int(self.rows["first"][k]), stop)

    def documents(self, group: int = 1 << 19) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) of each document in order, unpacked in groups of whole documents."""
        first = np.append(self.rows["first"].astype(np.int64), self.n_ids)
        at = 0
        while at < len(self.rows):
            end = max(at + 1, int(np.searchsorted(first, first[at] + group, side="right")) - 1)
            ids = self.ids(int(first[at]), int(first[end]))
            for k in range(at, end):
                row = self.rows[k]
                yield int(row["doc_id"]) if row["known"] else None, int(first[k]), ids[first[k] - first[at] : first[k + 1] - first[at]]
            at = end


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = 2, block: int = BLOCK) -> DataFrame:
    """Writes the shards and the manifest; returns the manifest, with the ids before each shard as ``base``.

    Runs a job: the files are the result.
    """
    spark = docs.sparkSession
    target = folder or fresh_path(spark, "token-files")
    path = vocabulary or default_vocabulary()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, name, n_docs = None, "", 0
        number = TaskContext.get().partitionId()
        for rows in batches:
            coder = encoder(path)
            for doc_id, ids in zip(rows["doc_id"].astype("Int64"), coder.encode_all(rows["text"]), strict=True):
                if made is None:
                    name = f"{target}/ids/part-{number:06d}-{uuid.uuid4().hex}.bin"
                    made = ShardWriter(name, bit_width(max(coder.vocabulary, end_id + 1)), block)
                made.add(None if doc_id is pd.NA else int(doc_id), np.append(ids, np.uint32(end_id)).astype("<u4"))
                n_docs += 1
        if made is not None:
            made.close()
            yield pd.DataFrame({"shard": [number], "path": [name], "n_docs": [n_docs], "n_ids": [made.n_ids], "n_bytes": [made.bytes]})

    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("_tie"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "_tie")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie", "text")
        .drop("_tie")
    )
    ranged.mapInPandas(write, MANIFEST).write.parquet(f"{target}/manifest")
    return read_manifest(spark, target)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard in order; ``base``: ids of all shards before it."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard, not per document
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """Documents of the shards: doc_id, start, n_tokens and the ids, or with ``digest`` their unsigned CRC-32.

    A shard is read by one task, a group of documents at a time.
    """
    last = "ids_crc32 long" if digest else "ids binary"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shards in batches:
            for path, base in zip(shards["path"], shards["base"], strict=True):
                out: list[tuple] = []
                held = 0
                for doc_id, first, ids in Shard(path).documents():
                    raw = ids.astype("<u4").tobytes()
                    out.append((doc_id, base + first, len(ids), zlib.crc32(raw) if digest else raw))
                    held += 64 if digest else len(raw)
                    if held >= 1 << 22:
                        yield frame(out)
                        out, held = [], 0
                if out:
                    yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", last.split()[0]])
        made["doc_id"] = made["doc_id"].astype("Int64")
        return made

    # a shuffle of names only; the number is given, since a shuffle of a few bytes would else be merged to one task
    spread = manifest.select("shard", "path", "base").repartition(max(1, manifest.count()))
    return spread.mapInPandas(read, f"doc_id long, start long, n_tokens long, {last}")
