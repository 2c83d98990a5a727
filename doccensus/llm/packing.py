"""Packing of documents into windows of fixed length by the sum-of-squares rule.

Every task packs its own rows while they stream by, so there is no shuffle, and the padding is at most one partly
filled window per task. A document's full windows stand alone; its remainder goes to the fill level for which the
sum of squared counts of partly filled windows becomes least (ties: the fuller level; an empty window counts as
level 0). ``counts`` is the level array. When a task's rows end, the pieces of the windows that are still open are
laid end to end and cut at the window length, so only the last window of a task is not full.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each for itself; a null
``doc_id`` is kept; a text of any length is cut; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccensus.llm.encoding import default_vocabulary, encoder
from doccensus.llm.shared import tidy

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_LARGE = np.int64(1) << 60


class SumOfSquares:
    """Online packer of one stream of documents; ``emit`` gets the pieces of each window that is closed."""

    def __init__(self, window: int, emit: Callable[[list], None]):
        self.window, self._emit = window, emit
        self.counts = np.zeros(window, dtype=np.int64)  # partly filled windows at each level
        self._open: list[list[list]] = [[] for _ in range(window)]

    def level(self, size: int) -> int:
        """The level to place a remainder at; 0 opens a window."""
        counts, window = self.counts, self.window
        change = 1 - 2 * counts[: window - size + 1]
        change[: window - size] += 2 * counts[size:window] + 1
        change[counts[: window - size + 1] == 0] = _LARGE
        change[0] = 2 * counts[size] + 1
        return window - size - int(np.argmin(change[::-1]))

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        """``doc`` is carried along; pieces are (doc, start, ids)."""
        full = len(ids) - len(ids) % self.window
        for at in range(0, full, self.window):
            self._emit([(doc, at, ids[at : at + self.window])])
        size = len(ids) - full
        if not size:
            return
        level = self.level(size)
        if level:
            self.counts[level] -= 1
            pieces = self._open[level].pop()
        else:
            pieces = []
        pieces.append((doc, full, ids[full:].copy()))
        if level + size == self.window:
            self._emit(pieces)
        else:
            self.counts[level + size] += 1
            self._open[level + size].append(pieces)

    def finish(self) -> None:
        room, pieces = self.window, []
        for level in range(self.window - 1, 0, -1):
            for doc, start, ids in (p for bin_ in self._open[level] for p in bin_):
                while len(ids):
                    pieces.append((doc, start, ids[:room]))
                    start, ids, room = start + len(ids[:room]), ids[room:], room - len(ids[:room])
                    if not room:
                        self._emit(pieces)
                        room, pieces = self.window, []
        if pieces:
            self._emit(pieces)


def pack_documents(docs: DataFrame, window: int = 1024, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their ids (little-endian unsigned 32-bit) and their place in a sequence.

    ``sequence_id`` is unique over the table: the task's number times 2^40 plus the window's number in the task.
    """
    path = vocabulary or default_vocabulary()

    @tidy
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        number = TaskContext.get().partitionId() << 40

        def emit(pieces: list) -> None:
            nonlocal number
            offset = 0
            for (doc_id, tokens), start, ids in pieces:
                out.append((doc_id, start, len(ids), ids.tobytes(), tokens, number, offset))
                offset += len(ids)
            number += 1

        def taken() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            out.clear()
            return frame

        packer = SumOfSquares(window, emit)
        for rows in batches:
            for doc_id, ids in zip(rows["doc_id"].astype("Int64"), encoder(path).encode_all(rows["text"]), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                packer.add((doc_id, len(ids)), ids)
                if len(out) >= 2000:
                    yield taken()
        packer.finish()
        if out:
            yield taken()
        encoder(path).forget()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(pack, SCHEMA)
