"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece (one match of the split pattern) is a row of live parts, at first its
bytes. A segment tree over positions holds, at each leaf, the rank of the pair
of that part and the next live part, packed with the position, so that the root
is the leftmost pair of least rank. A merge clears the leaf of the part that
goes, and sets the leaves of the two live neighbours: three updates of
logarithmic cost. Pieces of like length are merged together, one tree a row of
a numpy matrix; a long piece has a tree of its own.

Ranks come from a vocabulary file; ids are ranks. Nothing is trained here.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pieces of up to this many bytes are merged in matrices, longer ones one by one.
MATRIX_BYTES = 64
#: Pieces whose ids a worker keeps; it starts anew when there are more.
KEPT_PIECES = 1 << 18
#: Bytes of text encoded at a time.
CHUNK_BYTES = 1 << 20

_NONE = np.int64(1) << np.int64(62)


class Ranks:
    """A vocabulary: bytes of each id, and the id of each pair of ids that may merge."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for b, r in ranks.items():
            self.token[r] = b
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.whole = ranks
        keys, values = [], []
        for b, r in ranks.items():
            for i in range(1, len(b)):
                left, right = ranks.get(b[:i]), ranks.get(b[i:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    values.append(r)
        self.pair = dict(zip(keys, values))
        n = 1 << (4 * len(keys) + 15).bit_length()
        self._shift = np.uint64(64 - (n.bit_length() - 1))
        self._keys = np.full(n + 64, -1, dtype=np.int64)
        self._values = np.zeros(n + 64, dtype=np.int64)
        left = np.array(keys, dtype=np.int64)
        val = np.array(values, dtype=np.int64)
        at = self._place(left)
        while len(left):
            free = self._keys[at] == -1
            _, first = np.unique(at, return_index=True)
            mine = np.zeros(len(at), dtype=bool)
            mine[first] = True
            mine &= free
            self._keys[at[mine]] = left[mine]
            self._values[at[mine]] = val[mine]
            left, val, at = left[~mine], val[~mine], at[~mine] + 1
        lengths = np.array([len(t) for t in self.token], dtype=np.int64)
        self.length = lengths
        self.start = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(self.token), dtype=np.uint8)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of each pair, or -1 where it may not merge."""
        keys = (left << np.int64(32)) | right
        at = self._place(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            found = self._keys[at]
            hit = found == keys
            out[todo[hit]] = self._values[at[hit]]
            on = ~hit & (found != -1)
            todo, at, keys = todo[on], at[on] + 1, keys[on]
        return out


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    """Ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def _merge_matrix(pieces: list[bytes], width: int, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Flattened ids and number of ids of pieces of at most width bytes; width is a power of two."""
    n = len(pieces)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    here = np.arange(width)[None, :] < lengths[:, None]
    part = np.full((n, width), -1, dtype=np.int64)
    part[here] = ranks.byte[flat]
    cols = np.arange(width, dtype=np.int64)
    after = np.broadcast_to(cols + 1, (n, width)).copy()
    before = np.broadcast_to(cols - 1, (n, width)).copy()
    tree = np.full((n, 2 * width), _NONE, dtype=np.int64)
    row, col = np.nonzero(here[:, 1:])
    got = ranks.pair_ranks(part[row, col], part[row, col + 1])
    can = got >= 0
    tree[row[can], width + col[can]] = got[can] * width + col[can]
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    flat_tree = tree.reshape(-1)

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        base = rows * (2 * width)
        node = at + width
        flat_tree[base + node] = value
        while node[0] > 1:
            node = node >> 1
            flat_tree[base + node] = np.minimum(flat_tree[base + 2 * node], flat_tree[base + 2 * node + 1])

    live = np.flatnonzero(tree[:, 1] < _NONE)
    while len(live):
        best = tree[live, 1]
        i = best % width
        j = after[live, i]
        part[live, i] = best // width
        part[live, j] = -1
        k = after[live, j]
        after[live, i] = k
        put(live, j, np.full(len(live), _NONE))
        has = k < lengths[live]
        before[live[has], k[has]] = i[has]
        value = np.full(len(live), _NONE)
        got = ranks.pair_ranks(part[live[has], i[has]], part[live[has], k[has]])
        value[has] = np.where(got >= 0, got * width + i[has], _NONE)
        put(live, i, value)
        h = before[live, i]
        has = h >= 0
        if has.any():
            rows, h, i = live[has], h[has], i[has]
            got = ranks.pair_ranks(part[rows, h], part[rows, i])
            put(rows, h, np.where(got >= 0, got * width + h, _NONE))
        live = live[tree[live, 1] < _NONE]
    keep = part >= 0
    return part[keep], keep.sum(axis=1)


def _merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """The ids of one piece by a segment tree in a list."""
    n = len(piece)
    width = 1 << (n - 1).bit_length()
    none = 1 << 62
    part = [int(ranks.byte[b]) for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = ranks.pair
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = pair.get((part[i] << 32) | part[i + 1])
        if r is not None:
            tree[width + i] = r * width + i
    for v in range(width - 1, 0, -1):
        tree[v] = min(tree[2 * v], tree[2 * v + 1])

    def put(at: int, value: int) -> None:
        v = at + width
        tree[v] = value
        v >>= 1
        while v:
            a, b = tree[2 * v], tree[2 * v + 1]
            tree[v] = a if a < b else b
            v >>= 1

    while tree[1] < none:
        r, i = divmod(tree[1], width)
        j = after[i]
        part[i], part[j] = r, -1
        k = after[i] = after[j]
        put(j, none)
        value = none
        if k < n:
            before[k] = i
            x = pair.get((r << 32) | part[k])
            if x is not None:
                value = x * width + i
        put(i, value)
        h = before[i]
        if h >= 0:
            x = pair.get((part[h] << 32) | r)
            put(h, none if x is None else x * width + h)
    return [p for p in part if p >= 0]


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[list[int]]:
    """The ids of each piece; a piece that is itself a token is that token."""
    out: list[list[int]] = [[]] * len(pieces)
    by_width: dict[int, list[int]] = {}
    for i, p in enumerate(pieces):
        r = ranks.whole.get(p)
        if r is not None:
            out[i] = [r]
        elif len(p) > MATRIX_BYTES:
            out[i] = _merge_long(p, ranks)
        elif p:
            by_width.setdefault(1 << (len(p) - 1).bit_length(), []).append(i)
    for width, at in by_width.items():
        for lo in range(0, len(at), 1 << 13):
            some = at[lo : lo + (1 << 13)]
            flat, counts = _merge_matrix([pieces[i] for i in some], width, ranks)
            ends = np.cumsum(counts).tolist()
            flat = flat.tolist()
            begin = 0
            for i, end in zip(some, ends):
                out[i] = flat[begin:end]
                begin = end
    return out


class Encoder:
    """Text to ids. Keeps the ids of up to KEPT_PIECES pieces between calls."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        coded = encode_pieces([p.encode("utf-8") for p in pieces], self.ranks)
        n = len(self.place)
        if n + len(pieces) > len(self.start):
            grow = 1 << (n + len(pieces)).bit_length()
            self.start = np.concatenate([self.start, np.zeros(grow - len(self.start), dtype=np.int64)])
            self.count = np.concatenate([self.count, np.zeros(grow - len(self.count), dtype=np.int64)])
        counts = np.array([len(c) for c in coded], dtype=np.int64)
        total = int(counts.sum())
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros((1 << (self.used + total).bit_length()) - len(self.ids), dtype=np.int32)])
        self.ids[self.used : self.used + total] = np.fromiter((x for c in coded for x in c), dtype=np.int32, count=total)
        self.start[n : n + len(pieces)] = self.used + np.cumsum(counts) - counts
        self.count[n : n + len(pieces)] = counts
        self.used += total
        self.place.update(zip(pieces, range(n, n + len(pieces))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flattened ids and number of ids of each text."""
        pieces: list[str] = []
        bounds = [0]
        for t in texts:
            pieces += self.find(t)
            bounds.append(len(pieces))
        new = [p for p in dict.fromkeys(pieces) if p not in self.place]
        if len(new) + len(self.place) > KEPT_PIECES and self.place:
            self._clear()
            new = list(dict.fromkeys(pieces))
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        counts = self.count[at]
        ids = ragged(self.ids, self.start[at], counts)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(ends[np.array(bounds)])


@lru_cache(maxsize=4)
def worker_encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process, so that the pieces it keeps outlast a task."""
    return Encoder(load_ranks(path), pattern)


def ragged(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + count[i]] for all i, one after the other."""
    total = int(count.sum())
    if not total:
        return values[:0]
    offset = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return values[offset + np.arange(total)]


def decode_ids(ids: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Flattened bytes of ids and the number of bytes of each id."""
    if len(ids) and (ids.min() < 0 or ids.max() >= len(ranks.token)):
        raise ValueError("an id is not in the vocabulary")
    lengths = ranks.length[ids]
    return ragged(ranks.flat, ranks.start[ids], lengths), lengths


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """df with ids_col, the token ids of text_col as array<int>; null counts as empty.

    path: rank file, readable on every executor; pattern: what splits a text
    into pieces. decoded_col: also add the bytes that the ids decode to, made in
    the same pass from the ids alone. Other columns stay; ids_col and
    decoded_col replace columns of the same name. An empty text gets no ids.
    """
    new = [ids_col] + ([decoded_col] if decoded_col else [])
    kept = [f for f in df.schema.fields if f.name not in new]
    source = df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{text_col}`").alias("__text__"))
    shape = T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.BinaryType())] if decoded_col else [])])
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, encoder = load_ranks(path), worker_encoder(path, pattern)
        for batch in batches:
            column = batch.column(n_kept)
            lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK_BYTES, side="right")))
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                ids, counts = encoder.encode(texts)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                out = [batch.column(c).slice(lo, hi - lo) for c in range(n_kept)]
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())))
                if decoded_col:
                    data, sizes = decode_ids(ids, ranks)
                    at = np.concatenate([[0], np.cumsum(sizes)])[offsets].astype(np.int32)
                    out.append(pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]))
                yield pa.RecordBatch.from_arrays(out, names=[*(f.name for f in kept), *new])
                lo = hi

    return source.mapInArrow(run, shape)


def decode(df: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with decoded_col, the bytes of ids_col; null ids give null, no ids give no bytes."""
    kept = [f for f in df.schema.fields if f.name != decoded_col]
    source = df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(f"`{ids_col}`").cast("array<int>").alias("__ids__"))
    shape = T.StructType([*kept, T.StructField(decoded_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in batches:
            column = batch.column(len(kept))
            out = []
            for ids in column:
                out.append(None if ids.as_py() is None else decode_ids(ids.values.to_numpy(zero_copy_only=False).astype(np.int64), ranks)[0].tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(kept))), pa.array(out, pa.binary())], names=[*(f.name for f in kept), decoded_col])

    return source.mapInArrow(run, shape)
