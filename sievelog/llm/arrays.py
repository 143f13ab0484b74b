"""Numpy building blocks on Arrow text columns: slices of bounded bytes, words, and 64-bit hashes of byte spans.

Texts are never turned into Python strings here: an Arrow string column already is one byte buffer with offsets, and all
functions work on that pair ``(data, off)``, document ``d`` being ``data[off[d]:off[d + 1]]``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are looked at together; a longer document is looked at whole.
SLICE_BYTES = 2_000_000
#: The bytes between words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: ASCII upper case to lower case, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_LIBC = ctypes.CDLL(None)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: The first so many bytes of eight.
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit over all others."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows of ``batches`` in runs of at most ``limit`` bytes of text (or one row), with their bytes and offsets."""
    try:
        for batch in batches:
            data, off = utf8(batch.column(column))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
                yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
                at = to
    finally:
        trim()


def trim() -> None:
    """Gives the memory that a task has freed back to the system: a worker that waits for its next task doesn't hold it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each document (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def positions(starts: np.ndarray, lens: np.ndarray, step: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For spans that begin at ``starts``: every index inside them (``lens`` of them, ``step`` apart), its place in its span,
    and where each span's indices begin."""
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    return np.repeat(starts, lens) + (place if step == 1 else step * place), place, first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte strings ``data[starts:ends]``; equal strings have equal hashes wherever they stand.

    Every eight bytes go through a bijection of their own for their place in the string before they are added up, so no
    structure of a text survives into the sum (a polynomial modulo 2^64 gives Thue-Morse words equal hashes). Another
    ``seed`` gives 64 bits more.
    """
    lens = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    many = (lens + 7) >> 3
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).data, strides=(1,))
    if many.max() <= 1:
        out = np.where(many > 0, mixed(eights[starts] & _TAIL[lens] ^ mixed(np.uint64(seed) + _GOLD)), np.uint64(0))
    else:
        index, place, first = positions(starts, many, 8)
        rest = np.minimum(np.repeat(ends, many) - index, 8)
        parts = mixed(eights[index] & _TAIL[rest] ^ mixed(np.uint64(seed) + _GOLD * (place + 1).astype(np.uint64)))
        some = many > 0
        out = np.zeros(len(starts), np.uint64)
        out[some] = np.add.reduceat(parts, first[some])
    return mixed(out + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` successive items that lie in one document, and the first run of each document."""
    size = np.diff(first)
    per = np.maximum(size - n + 1, 0)
    begin = np.concatenate([[0], np.cumsum(per)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at, _, _ = positions(first[:-1], per)
    total = np.zeros(len(at), np.uint64)
    for i in range(n):
        total = (total + hashes[at + i]) * _GOLD + np.uint64(i + 1)
    return mixed(total), begin


def char_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Code points of each document."""
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.diff(begun[off])


# Compact payloads of number arrays


def packed(*arrays: np.ndarray, ordered: bool = True) -> bytes:
    """The arrays as bytes; the first is sorted if ``ordered`` and then kept as differences. Byte planes compress well."""
    parts = []
    for i, a in enumerate(arrays):
        a = np.ascontiguousarray(a)
        if i == 0 and ordered and len(a):
            a = np.concatenate([a[:1], np.diff(a)])
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        body = pa.compress(planes, codec="zstd", asbytes=True) if planes else b""
        head = np.array([len(a), len(body), len(planes)], np.int64).tobytes() + a.dtype.str.encode().ljust(4)
        parts += [head, body]
    return b"".join([bytes([len(arrays), ordered]), *parts])


def unpacked(blob: bytes) -> list[np.ndarray]:
    many, ordered = blob[0], blob[1]
    at, out = 2, []
    for i in range(many):
        n, size, raw = np.frombuffer(blob, np.int64, 3, at)
        dtype = np.dtype(blob[at + 24 : at + 28].decode().strip())
        at += 28
        planes = pa.decompress(blob[at : at + int(size)], decompressed_size=int(raw), codec="zstd", asbytes=True) if size else b""
        at += int(size)
        a = np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, int(n)).T.copy().reshape(-1).view(dtype)
        out.append(np.cumsum(a, dtype=dtype) if i == 0 and ordered and n else a)
    return out
