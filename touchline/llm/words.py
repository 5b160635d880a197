"""Words of whole Arrow batches at once: spans and 64-bit hashes without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64

#: Texts handled together, in bytes; a longer text is handled alone.
GROUP = 4 << 20

#: Bytes of words between white space.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Letters, digits and every byte of a multi-byte character.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_KEPT: list[tuple[np.ndarray, np.ndarray]] = []


def groups(batch: pa.RecordBatch, column: str = "body", size: int = GROUP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of consecutive rows of a binary column, about ``size`` bytes each."""
    col = batch.column(batch.schema.get_field_index(column))
    wide = pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(o, o[a] + size, "right")) - 1)
        b = min(b, len(col))
        yield a, b, d[o[a]:o[b]], o[a:b + 1] - o[a]
        a = b


def spans(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of ``chars`` bytes; runs never cross rows."""
    inside = chars[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = inside[start]
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def folded(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64; those of a group's size are kept."""
    if n <= GROUP and _KEPT:
        return _KEPT[0]
    made = tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n, GROUP), x))), dtype=np.uint64) for x in (_BASE, _INVERSE))
    if n <= GROUP:
        _KEPT.append(made)
    return made


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the bytes before each position, each byte's random value times its power of the base."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.take(_BYTE, data, out=sums[1:], mode="clip")
    with np.errstate(over="ignore"):
        sums[1:] *= _powers(len(data))[0][:len(data)]
        return np.cumsum(sums, out=sums)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each span: a polynomial over random byte values, mixed with the length; ``sums`` of the same data are used if given."""
    if not len(start):
        return np.empty(0, np.uint64)
    # A difference of prefix sums, times the inverse of its first power, is the span's polynomial.
    sums = prefix_sums(data) if sums is None else sums
    with np.errstate(over="ignore"):
        return mix64(((sums[end] - sums[start]) * _powers(len(data))[1][start]) ^ ((end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix64(out * np.uint64(3) + h[i:len(h) - n + 1 + i])
    return out
