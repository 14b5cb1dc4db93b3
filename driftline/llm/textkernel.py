"""Vectorised word splitting and hashing over Arrow string columns.

Everything here runs inside a Python worker on one slice of a batch at a time
(about ``SLICE_BYTES`` of text, or one document when that is longer), so the
memory it needs follows the slice and not the partition.

Words are maximal runs of bytes other than space and U+0009..U+000D. Those
bytes never occur inside a multi-byte UTF-8 character, so splitting bytes gives
the same words as splitting code points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_WORD_BASE = np.uint64(0xD6E8FEB86659FD93 | 1)
_LANE_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SIZE_BASE = np.uint64(0xA0761D6478BD642F)
#: For k bytes of a lane of eight, the lowest k bytes.
_LANE_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Longer words are hashed one by one.
_LONG_WORD = 256


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser; h is changed in place and returned."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """The words of documents first..last-1 of a batch.

    buf: the documents' bytes; offsets: their limits in buf; start, end: the
    words' limits in buf; bounds: word index at which each document begins,
    with the total number of words last.
    """

    __slots__ = ("first", "last", "buf", "offsets", "start", "end", "bounds")

    def __init__(self, first: int, last: int, buf: np.ndarray, offsets: np.ndarray):
        self.first, self.last, self.buf, self.offsets = first, last, buf, offsets
        if len(buf) == 0:
            self.start = self.end = np.zeros(0, dtype=np.int64)
            self.bounds = np.zeros(last - first + 1, dtype=np.int64)
            return
        space = _SPACE[buf]
        limits = offsets[1:-1]
        limits = limits[(limits > 0) & (limits < len(buf))]
        begin = ~space
        begin[1:] &= space[:-1]
        begin[limits] = ~space[limits]
        finish = ~space
        finish[:-1] &= space[1:]
        finish[limits - 1] = ~space[limits - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        self.bounds = np.searchsorted(self.start, offsets, side="left")

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; lower: A-Z count as a-z.

        Eight bytes at a time go through a mixing step that is a bijection of
        them, so that no regular pattern of letters makes words collide.
        """
        if len(self.start) == 0:
            return np.zeros(0, dtype=np.uint64)
        padded = np.zeros(len(self.buf) + 8, dtype=np.uint8)
        padded[:-8] = _LOWER[self.buf] if lower else self.buf
        lanes = np.ndarray((len(self.buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
        size = self.end - self.start
        h = mix(size.astype(np.uint64) * _SIZE_BASE + _SIZE_BASE)
        h = mix((h ^ (lanes[self.start] & _LANE_MASK[np.minimum(size, 8)])) * _LANE_BASE)
        more, k = np.flatnonzero((size > 8) & (size <= _LONG_WORD)), 8
        while len(more):
            x = lanes[self.start[more] + k] & _LANE_MASK[np.minimum(size[more] - k, 8)]
            h[more] = mix((h[more] ^ x) * _LANE_BASE)
            k += 8
            more = more[size[more] > k]
        for i in np.flatnonzero(size > _LONG_WORD):
            h[i] = int.from_bytes(hashlib.blake2b(padded[self.start[i] : self.end[i]], digest_size=8).digest(), "little")
        return h

    def plain(self, i: int, lower: bool = False) -> bytes:
        """The words of the slice's i-th document, joined by one space."""
        text = self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()
        return b" ".join((text.lower() if lower else text).split())

    def digests(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Two signed 64-bit halves of a cryptographic digest of each document's words."""
        n = self.last - self.first
        both = b"".join(hashlib.blake2b(self.plain(i, lower), digest_size=16).digest() for i in range(n))
        halves = np.frombuffer(both, dtype=np.int64).reshape(n, 2)
        return np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a string column (null: empty), about limit bytes at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if at is not None and n else np.zeros(n + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield Words(i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair of hashes, in order."""
    out = a * _WORD_BASE
    out += b
    return mix(out)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, given the words' hashes; n is small."""
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = _joined(out, h[j : len(h) - n + 1 + j])
    return out


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values, in about log2(n) passes."""
    width, out = 1, x
    while 2 * width <= n:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    return out if width == n else np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, from hashes of 1, 2, 4, ... words; n may be large."""
    block, width, out, have = h, 1, None, 0
    while True:
        if n & width:
            if out is None:
                out = block
            else:
                m = len(block) - have
                out = _joined(out[:m], block[have:])
            have += width
        if have == n:
            return out[: len(h) - n + 1]
        block = _joined(block[: len(block) - width], block[width:])
        width *= 2


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flattened values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
