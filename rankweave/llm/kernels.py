"""Vectorised text kernels shared by the corpus operators.

Texts reach the Python side as Arrow string columns.  The kernels work on the
UTF-8 buffer of such a column as one ``uint8`` array, so that a whole batch is
split into words and hashed by a handful of numpy calls instead of by a Python
loop over words.  Memory is bounded by ``CHUNK`` bytes of text at a time,
whatever the length of a document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes of text for which temporary arrays exist at one time.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CODE = np.random.Generator(np.random.PCG64(20240131)).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit values over the whole range."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, CHUNK + 4096), base, dtype=np.uint64)
        steps[0] = 1
        held = np.multiply.accumulate(steps)
        _POWERS[base] = held
    return held[:n]


_INVERSE = pow(_BASE, -1, 1 << 64)


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_bounds(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word: a run of bytes that `apart` does not mark
    (by default: other than 0x20, 0x09-0x0D).

    A word never reaches over the border between two texts.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~apart[data]
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = solid[cuts]
    ends[cuts - 1] = solid[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of data[start:end] for every (start, end).

    A polynomial over random byte codes, read off prefix sums modulo 2**64, and
    finalised together with the length.
    """
    return hash_ranges(data, lower, [(starts, ends)])[0]


def hash_ranges(data: np.ndarray, lower: bool, ranges: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """``range_hash`` of several lists of ranges over one buffer."""
    n = len(data)
    codes = _CODE[_LOWER] if lower else _CODE
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(codes[data] * _powers(_BASE, n), out=sums[1:])
    back = _powers(_INVERSE, n + 1)
    return [mix64((sums[e] - sums[s]) * back[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) for s, e in ranges]


def _pieces(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut the buffer at white space into pieces of about CHUNK bytes."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + CHUNK)
        while to < n:
            seen = np.flatnonzero(_SPACE[data[to : to + 65536]])
            if len(seen):
                to += int(seen[0])
                break
            to = min(n, to + 65536)
        yield at, to
        at = to


def words(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the number of words of each text."""
    hashes, starts, ends = [], [], []
    for a, b in _pieces(data, offs):
        inside = offs[np.searchsorted(offs, a, "right") : np.searchsorted(offs, b, "left")] - a
        s, e = word_bounds(data[a:b], np.concatenate(([0], inside, [b - a])))
        hashes.append(range_hash(data[a:b], s, e, lower))
        starts.append(s + a)
        ends.append(e + a)
    if not hashes:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offs) - 1, np.int64)
    start = np.concatenate(starts)
    counts = np.diff(np.searchsorted(start, offs, "left"))
    return np.concatenate(hashes), start, np.concatenate(ends), counts


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values (k-grams that span texts included)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(_BASE)
        out += values[j : j + n]
    return mix64(out)


def release() -> None:
    """Give freed memory back, so that a worker's peak in one task doesn't stay for the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(data: np.ndarray, offs: np.ndarray, limit: int = 2 * CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes of text, one row at least."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


# -- compact blobs ---------------------------------------------------------
# Arrays travel through shuffles as zstd-compressed byte planes: the upper
# planes of sorted differences or of frequency-ordered ids are nearly constant.

_PACK = zstandard.ZstdCompressor(level=1, write_content_size=False)
_UNPACK = zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes; planes that don't shrink stay as they are."""
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if n else 1
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T)
    raw = [p.tobytes() for p in planes]
    parts = [small if len(small) < n else p for small, p in zip(map(_PACK.compress, raw), raw, strict=True)]
    return np.array([n, width, *map(len, parts)], dtype=np.uint32).tobytes() + b"".join(parts)


def unpack(blob: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The array at `at` and where the next one begins."""
    n, width = (int(x) for x in np.frombuffer(blob, np.uint32, 2, at))
    sizes = np.frombuffer(blob, np.uint32, width, at + 8)
    at += 8 + 4 * width
    out = np.zeros((8, n), np.uint8)
    for k, size in enumerate(map(int, sizes)):
        part = blob[at : at + size]
        out[k] = np.frombuffer(part if size == n else _UNPACK.decompress(part, max_output_size=max(n, 1)), np.uint8)
        at += size
    return np.ascontiguousarray(out.T).view(np.uint64).reshape(-1), at


def pack_all(*arrays: np.ndarray) -> bytes:
    return b"".join(map(pack, arrays))


def unpack_all(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        values, at = unpack(blob, at)
        out.append(values)
    return out


def deltas(values: np.ndarray) -> np.ndarray:
    """Differences of a non-decreasing array; undone by cumsum."""
    v = np.asarray(values, np.uint64)
    return np.diff(v, prepend=np.uint64(0))
