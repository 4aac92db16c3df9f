"""Words, their hashes and n-gram hashes of whole texts, as numpy arrays over Arrow buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
Hashes are 64 bits wide.  They come from one running sum over the buffer, so
no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Texts are worked on in pieces of whole documents of about this many bytes.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Separators that also part words from ASCII punctuation.
PUNCTUATION = SPACE.copy()
PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_table() -> np.ndarray:
    code = np.arange(256)
    code[65:91] += 32
    return mix((code + 1).astype(_U) * _U(_BASE))


_BYTES = _byte_table()
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK_BYTES * 2), base, dtype=_U)
        step[0] = 1
        have = _powers[key] = np.multiply.accumulate(step)
    return have[:n]


class Words:
    """Words of consecutive documents: byte offsets, owning document and hash."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, space: np.ndarray = SPACE):
        self.data, self.bounds, self.docs = data, bounds, len(bounds) - 1
        inside = ~space[data]
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & ~(before & ~first[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & ~(after & ~first[1:])) + 1
        #: of each document, the index of its first word; one more entry at the end
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.docs), self.count)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            total = np.zeros(len(self.data) + 1, _U)
            np.cumsum(_BYTES[self.data] * _power(_BASE, len(self.data)), out=total[1:])
            word = (total[self.end] - total[self.start]) * _power(_INVERSE, len(self.data))[self.start]
            self._hash = mix(word + (self.end - self.start).astype(_U))
        return self._hash

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes().lower()


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of a sequence of hashes, position by position."""
    total = np.zeros(len(parts[0]), _U)
    for k, x in enumerate(parts):
        total += mix(x + _U(k + 1)) * _U(_MULTIPLIERS[k % len(_MULTIPLIERS)] + 2 * (k // len(_MULTIPLIERS)))
    return mix(total)


def ngrams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every n-gram that lies within one document."""
    h, size = words.hash, len(words.start)
    if size < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(words.doc[: size - n + 1] == words.doc[n - 1:])
    return combine([h[at + k] for k in range(n)]), at


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, chunk: int = CHUNK_BYTES, space: np.ndarray = SPACE) -> Iterator[tuple[int, Words]]:
    """(index of the first row, words) of successive whole rows of about ``chunk`` bytes; ``space`` marks separators."""
    data, bounds = buffers(column)
    at, rows = 0, len(bounds) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + chunk, side="right")) - 1)
        yield at, Words(data[bounds[at]: bounds[to]], bounds[at: to + 1] - bounds[at], space)
        at = to


#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the maximal runs of ``inside`` bytes; ``bounds`` are the documents' offsets."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[bounds] = True
    padded = np.concatenate([[False], inside, [False]])
    start = np.flatnonzero(inside & (~padded[:-2] | edge[:-1]))
    end = np.flatnonzero(inside & (~padded[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(bounds, start, side="right") - 1


def dictionary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(code of each run, the distinct runs as binary); runs lie in order and do not overlap."""
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    kept = data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
