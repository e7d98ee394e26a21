"""Numpy helpers that work on the flat bytes of an Arrow text column."""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

U64 = np.uint64
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BLOCK = 1 << 18


@lru_cache(maxsize=1)
def _own_pool() -> None:
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # glibc's M_MMAP_THRESHOLD; elsewhere there is nothing to set
    except (AttributeError, OSError, TypeError):
        pass
    pa.set_memory_pool(pa.system_memory_pool())


def frugal() -> None:
    """Large arrays of this worker, Arrow's too, go back to the system as soon as they are freed, in place of being kept for its whole life; small ones now."""
    _own_pool()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column on end, and the n + 1 offsets; null counts as empty."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * M2
    x = (x ^ (x >> U64(27))) * M3
    return x ^ (x >> U64(31))


def gram_hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes (8 at least) that start at each position; len(buf) - k + 1 of them."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    raw = np.ascontiguousarray(buf)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        v = np.ndarray((b - a + k - 8,), U64, raw.data, a, (1,)).copy()
        h = v[: b - a] * M1
        for o in [*range(8, k - 8, 8), k - 8] if k > 8 else []:
            h = ((h ^ (h >> U64(29))) + v[o : o + b - a]) * M2
        out[a:b] = h ^ (h >> U64(32))
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values in a row; len(h) - w + 1 of them."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, h.dtype)
    out = np.empty(n, h.dtype)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        m, span = h[a : b + w - 1], 1
        while span < w:
            step = min(span, w - span)
            m = np.minimum(m[:-step], m[step:])
            span += step
        out[a:b] = m
    return out


_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.int64).astype(U64)
_POW = np.cumprod(np.full(BLOCK, M1 | U64(1), U64), dtype=U64)
_INV = np.cumprod(np.full(BLOCK, U64(pow(int(M1 | U64(1)), -1, 2**64)), U64), dtype=U64)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[start:end] for each span; spans must not overlap and must be in order."""
    if not len(start):
        return np.zeros(0, U64)
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        a = int(start[i])
        j = int(np.searchsorted(end, a + BLOCK, "right"))
        if j <= i:  # one span longer than a block: blocks are chained
            h = U64(0)
            for p in range(a, int(end[i]), BLOCK):
                q = min(int(end[i]), p + BLOCK)
                with np.errstate(over="ignore"):
                    h = mix(np.array([h * M3 + np.sum(_TABLE[buf[p:q]] * _POW[: q - p], dtype=U64)]))[0]
            out[i] = h ^ U64(int(end[i]) - a)
            i += 1
            continue
        b = int(end[j - 1])
        c = np.empty(b - a + 1, U64)
        c[0] = 0
        np.cumsum(_TABLE[buf[a:b]] * _POW[: b - a], dtype=U64, out=c[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((c[e] - c[s]) * _INV[np.minimum(s, BLOCK - 1)] + (e - s).astype(U64))
        i = j
    return out


def words_of(buf: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all maximal runs of word bytes that do not cross texts, and the n + 1 offsets into them by text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = is_word[buf]
    left = np.empty(n, bool)
    left[0], left[1:] = True, ~w[:-1]
    left[off[:-1][off[:-1] < n]] = True
    start = np.flatnonzero(w & left)
    right = np.empty(n, bool)
    right[-1], right[:-1] = True, ~w[1:]
    inner = off[1:-1]
    right[inner[inner > 0] - 1] = True
    end = np.flatnonzero(w & right) + 1
    return start, end, np.searchsorted(start, off)


def sequence_hashes(h: np.ndarray, w: int) -> np.ndarray:
    """A 64-bit hash of each w hashes in a row; len(h) - w + 1 of them."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n].copy()
    for o in range(1, w):
        out = (out ^ (out >> U64(31))) * M1 + h[o : o + n]
    return mix(out)


def gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of all spans on end."""
    done = np.r_[0, np.cumsum(length, dtype=np.int64)]
    out = np.empty(int(done[-1]), buf.dtype)
    i = 0
    while i < len(length):
        j = max(i + 1, int(np.searchsorted(done, done[i] + BLOCK, "right")) - 1)
        a, b = int(done[i]), int(done[j])
        out[a:b] = buf[np.arange(b - a) + np.repeat(start[i:j] - (done[i:j] - a), length[i:j])]
        i = j
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, compressed; unpack needs their types."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(data: bytes, *types) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes, at, out = np.frombuffer(raw, np.int64, len(types)), 8 * len(types), []
    for size, kind in zip(sizes, types, strict=True):
        out.append(np.frombuffer(raw, kind, size, at))
        at += int(size) * np.dtype(kind).itemsize
    return out


def six_bytes(h: np.ndarray) -> np.ndarray:
    """The low 48 bits of each hash; the high bits are in the bucket's number."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).ravel()


def from_six(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = b.reshape(-1, 6)
    return out.view("<u8").ravel()


def bucket_runs(sorted_hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The equal ranges of hashes (below 2^32 of them) that hold any, and where each starts in the sorted array, and its end."""
    bucket = ((sorted_hashes >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    return bucket[first], np.r_[first, len(bucket)]
