"""Words of whole Arrow text columns as NumPy arrays: no Python object is made for a word.

A column's bytes lie one document after the other. Word bounds come from a byte table, word
hashes from prefix sums of a polynomial modulo 2**64, so the cost is a few vector passes over the
bytes. Hashes have 64 bits; two different words agree with a probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
SLICE_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers with well-spread bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    if len(_powers[0]) < n:
        n = max(1 << 16, n + n // 8)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def slices(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; a longer row is alone. Nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, offsets, data = text.buffers()
    if not len(text):
        return
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(text):
        hi = int(np.searchsorted(offs, offs[lo] + most, "right")) - 1
        hi = min(len(text), max(hi, lo + 1))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each document (one more entry than documents)."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = IS_WORD[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums whose differences identify byte ranges."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal bytes have equal hashes in every slice, task and run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p = prefix(buf)
    return mix64((p[ends] - p[starts]) * powers(len(buf) + 1)[1][starts] + (ends - starts).astype(np.uint64))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive hashes (len(h) - width + 1 of them), order included."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(h) + 1)
    p = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=p[1:])
    return mix64((p[width:] - p[:-width]) * down[:n] + np.uint64(width))


def inside(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the runs of `rolling` lie in one document; first: first word of each document, n: number of words."""
    m = n - width + 1
    if m <= 0:
        return np.zeros(0, bool)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return doc[:m] == doc[width - 1 :]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def take_ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all elements of the ranges, one range after the other, and the offsets of the ranges in that."""
    n = ends - starts
    offs = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=offs[1:])
    return np.repeat(starts - offs[:-1], n) + np.arange(offs[-1]), offs
