"""Vectorised views of Arrow text columns: bytes, words and their 64-bit hashes.

Hashes are polynomials modulo 2^64 over random byte values, finished by a bijective mixer; they are functions of the
bytes only, so all tasks and reruns agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes worked on at once; a longer document is a slice by itself.
SLICE = 2 << 20
#: Bytes 0x20 and 0x09 to 0x0D part words.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits each depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i up to ``n``."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]), SLICE + 1)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def release() -> None:
    """Gives what this worker no longer uses back to the system: it may sit beside the next stage's workers and their JVM."""
    if len(_powers[0]) > 2:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, with a release at the end of each task."""

    def released(stream):
        try:
            yield from run(stream)
        finally:
            release()

    return released


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of VALUES[data[t]] * BASE^t for i <= t < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums) - 1)[1][start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null as empty. Offsets are relative to the bytes."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, or one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, stop
        row = stop


def batches(stream, size: int = SLICE, text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for each slice of each Arrow batch."""
    for batch in stream:
        if not batch.num_rows:
            continue
        data, at = text_column(batch.column(text))
        for a, b in slices(at, size):
            yield batch.slice(a, b - a), data[at[a] : at[b]], at[a : b + 1] - at[a]


#: Letters and digits of ASCII, and every byte of other characters: the tokens of matching that ignores punctuation.
TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True


def words(data: np.ndarray, offsets: np.ndarray, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): bounds of the runs of bytes in ``part`` (default: not white space); row d has first[d]:first[d + 1]."""
    solid = ~SPACE[data] if part is None else part[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[0] = edge[-1] = True
    before = np.empty(len(data), bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    start = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    return span_hash(prefix_sums(LOWER[data] if lower else data), start, end)


def shingle_hashes(h: np.ndarray, first: np.ndarray, width: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): hashes of ``width`` consecutive words; row d has bounds[d]:bounds[d + 1], repeats kept.

    A row with fewer words, but some, has one hash of all of them if ``whole_if_short``.
    """
    n = np.diff(first)
    count = np.maximum(n - width + 1, 0)
    rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for i in range(width):
        rolled += h[i : len(h) - width + 1 + i] * U(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) if len(rolled) else U(0)
    rolled = mix(rolled)
    short = (n > 0) & (n < width) & whole_if_short
    count += short
    bounds = np.zeros(len(first), np.int64)
    np.cumsum(count, out=bounds[1:])
    row = np.repeat(np.arange(len(n)), count)
    at = first[row] + np.arange(bounds[-1]) - bounds[row]
    out = rolled[np.minimum(at, max(len(rolled) - 1, 0))] if len(rolled) else np.zeros(len(at), np.uint64)
    for d in np.flatnonzero(short):
        part = h[first[d] : first[d + 1]]
        k = np.array([pow(0xD1342543DE82EF95, 2 * i + 1, 1 << 64) for i in range(len(part))], np.uint64)
        out[bounds[d]] = mix(np.array([(part * k).sum() + U(len(part))], np.uint64))[0]
    return out, bounds
