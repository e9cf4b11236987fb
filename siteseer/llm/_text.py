"""Vectorised text work over Arrow batches: words, hashes, packed columns.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; UTF-8 has those
bytes nowhere else, so bytes and code points agree.  Hashes are polynomials
mod 2**64 over the bytes of a word, taken from one prefix-sum array per chunk
and mixed, so a chunk of many documents costs a handful of array passes.
"""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import zstandard

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PLAIN = np.arange(256, dtype=np.uint8)
LOWER = PLAIN.copy()
LOWER[65:91] += 32

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U(0xD6E8FEB86659FD93)
#: Bytes of text worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept for the next call."""
    if not _tables or len(_tables[0]) < n:
        m = max(n, CHUNK + (1 << 17))
        up, down = np.full(m, _BASE, U), np.full(m, _INV, U)
        up[0] = down[0] = 1
        _tables[:] = [np.cumprod(up), np.cumprod(down)]
    return _tables[0][:n], _tables[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x ^ U(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def release() -> None:
    """Hands memory that is free in this worker back to the machine; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offs


def chunks(offs: np.ndarray, size: int = CHUNK):
    """Ranges of documents of about ``size`` bytes, at least one document each."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offs: np.ndarray, lut: np.ndarray = PLAIN, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the words' offsets by document (``len(offs)`` entries)."""
    base, end = int(offs[0]), int(offs[-1])
    b, o = buf[base:end], offs - base
    if not len(b):
        return np.zeros(0, U), np.zeros(len(offs), np.int64)
    on = ~SPACE[b]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    cut = o[(o > 0) & (o < len(b))]
    first[cut] = on[cut]
    last[cut - 1] = on[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(b) + 1)
    acc = np.zeros(len(b) + 1, U)
    np.cumsum((lut[b].astype(U) + U(1 + 977 * seed)) * up[: len(b)], out=acc[1:])
    h = mix((acc[ends] - acc[starts]) * down[starts] + (ends - starts).astype(U), seed)
    return h, np.searchsorted(starts, o)


def windows(h: np.ndarray, woffs: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words inside a document, and offsets by document."""
    n = np.maximum(np.diff(woffs) - (k - 1), 0)
    offs = np.concatenate([[0], np.cumsum(n)])
    if len(h) < k:
        return np.zeros(0, U), offs
    acc, c = np.zeros(len(h) - k + 1, U), 1
    for j in range(k):
        acc += h[j : len(h) - k + 1 + j] * U(c)
        c = c * int(_STEP) % (1 << 64)
    keep = np.repeat(woffs[:-1] - offs[:-1], n) + np.arange(offs[-1])
    return mix(acc[keep], seed + 1), offs


def doc_of(offs: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def pack(*cols: np.ndarray) -> bytes:
    """Columns of integers as one compressed blob, byte plane by byte plane."""
    parts = []
    for c in cols:
        c = np.ascontiguousarray(c)
        head = np.array([len(c), ord(c.dtype.kind), c.dtype.itemsize], np.int64).tobytes()
        parts.append(head + c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    while at < len(raw):
        n, kind, size = np.frombuffer(raw, np.int64, 3, at).tolist()
        at += 24
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"{chr(kind)}{size}").reshape(n))
        at += n * size
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    d = x.copy()
    d[1:] -= x[:-1]
    return d
