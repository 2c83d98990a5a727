"""Token ids of whole texts with a public tokenizer, at the speed of a dictionary.

A byte-level BPE never merges across two kinds of places: where white space follows another character, and where
one of ``PUNCTUATION`` follows an ASCII letter. A text is therefore the concatenation of the units between those
places. Each distinct unit goes through the tokenizers library once per worker and is remembered; units are found,
told apart and put together with numpy, many texts at a time. Memory is bounded by ``MAX_UNITS`` and
``BATCH_BYTES``, apart from a single text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer

MAX_UNITS = 800_000
BATCH_BYTES = 2_000_000
PUNCTUATION = b".,!?;:%*&$#|"

_KIND = np.zeros(256, dtype=np.uint8)  # 1 white space, 2 punctuation, 4 ASCII letter, 8 control that engines judge differently
_KIND[list(b" \t\n\r")] = 1
_KIND[list(PUNCTUATION)] = 2
_KIND[list(range(65, 91)) + list(range(97, 123))] = 4
_KIND[[11, 12, 28, 29, 30, 31]] = 8
_VALUES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
_RATIO = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_RATIO), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _odd_places(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places of white space beyond blank, tab and line ends; such texts are encoded in one piece."""
    lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    lead = lead[lead + 2 < len(raw)]
    a, b, c = raw[lead], raw[lead + 1], raw[lead + 2]
    wide = (
        ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)))
        | ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E))))
        | ((a == 0xE2) & ((b == 0x80) | (b == 0x81)))
        | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    )
    return np.concatenate([lead[wide], np.flatnonzero(kind == 8)])


class Encoder:
    """Ids of texts as the tokenizers library gives them without special tokens."""

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self.vocabulary = self._tokenizer.get_vocab_size(with_added_tokens=True)
        #: bytes of text behind each id: the byte alphabet writes one character per byte
        self._id_bytes = np.array([len(self._tokenizer.id_to_token(i)) for i in range(self.vocabulary)])
        self.forget()

    def forget(self) -> None:
        """Drop the units, as at the end of a task: the worker lives on, and the next task may not need them."""
        self._known: dict[bytes, int] = {}
        self._flat = np.empty(1 << 16, dtype="<u4")
        self._start = np.zeros(1 << 16, dtype=np.int64)  # of unit i in _flat; ends where unit i + 1 starts

    def plain(self, text: str) -> np.ndarray:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _append(self, units: list[bytes], ids: np.ndarray, cuts: np.ndarray) -> None:
        n, used = len(self._known), int(self._start[len(self._known)])
        while n + len(units) + 1 > len(self._start):
            self._start = np.concatenate([self._start, np.zeros_like(self._start)])
        while used + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
        self._flat[used : used + len(ids)] = ids
        self._start[n + 1 : n + 1 + len(units)] = used + cuts
        self._known.update(zip(units, range(n, n + len(units)), strict=True))

    def _learn(self, units: list[bytes]) -> None:
        """Units that begin with white space and end without are encoded as one text and cut by byte counts."""
        joined = [u for u in units if u[0] in b" \t\n\r" and u[-1] not in b" \t\n\r"]
        single = [u for u in units if not (u[0] in b" \t\n\r" and u[-1] not in b" \t\n\r")]
        if joined:
            text = b"".join(joined).decode()
            ids = np.asarray(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.cumsum(np.fromiter(map(len, joined), dtype=np.int64, count=len(joined)))
            self._append(joined, ids, np.searchsorted(np.cumsum(self._id_bytes[ids]), ends, side="left") + 1)
        if single:
            got = [x.ids for x in self._tokenizer.encode_batch_fast([u.decode() for u in single], add_special_tokens=False)]
            self._append(single, np.array([i for x in got for i in x], dtype="<u4"), np.cumsum([len(x) for x in got]))

    def _batch(self, texts: list[bytes]) -> list[np.ndarray]:
        ends = np.cumsum([len(t) for t in texts])
        whole = b"".join(texts)
        if not whole:
            return [np.empty(0, dtype="<u4")] * len(texts)
        raw = np.frombuffer(whole, dtype=np.uint8)
        kind = _KIND[raw]
        space = kind == 1
        cut = np.zeros(len(raw) + 1, dtype=bool)
        cut[1:-1] = (space[1:] & ~space[:-1]) | ((kind[1:] == 2) & (kind[:-1] == 4))
        cut[0] = True
        cut[ends] = True
        at = np.flatnonzero(cut)
        sums = np.empty(len(raw) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_VALUES[raw] * _powers(_RATIO, len(raw)), out=sums[1:])
        prints = (sums[at[1:]] - sums[at[:-1]]) * _powers(_BACK, len(raw))[at[:-1]]
        _, first, which = np.unique(prints, return_index=True, return_inverse=True)
        units = [whole[a:b] for a, b in zip(at[first].tolist(), at[first + 1].tolist(), strict=True)]
        new = [u for u in units if u not in self._known]
        if len(self._known) + len(new) > MAX_UNITS:
            self.forget()
            new = units
        if new:
            self._learn(new)
        index = np.fromiter(map(self._known.__getitem__, units), dtype=np.int64, count=len(units))[which]
        starts = self._start[index]
        counts = self._start[index + 1] - starts
        after = np.cumsum(counts)
        ids = self._flat[np.repeat(starts - (after - counts), counts) + np.arange(after[-1])]
        doc_ends = np.concatenate([[0], after])[np.searchsorted(at, ends)]
        out = np.split(ids, doc_ends[:-1])
        for i in np.unique(np.searchsorted(ends, _odd_places(raw, kind), side="right")):
            out[i] = self.plain(texts[i].decode())
        return out

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text in turn, unsigned 32-bit; none for a null or empty text."""
        held, size = [], 0
        for text in texts:
            held.append(text.encode() if isinstance(text, str) else b"")
            size += len(held[-1])
            if size >= BATCH_BYTES:
                yield from self._batch(held)
                held, size = [], 0
        if held:
            yield from self._batch(held)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, loaded once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    """Where the byte-level vocabulary lies; the files are never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
