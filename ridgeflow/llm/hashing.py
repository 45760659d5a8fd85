"""Vectorised hashes of byte spans: one running sum answers every span of a buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_SYMBOLS = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _grown(table: np.ndarray, factor: int, size: int) -> np.ndarray:
    steps = np.full(size - len(table), factor, np.uint64)
    steps[:1] *= table[-1]
    with np.errstate(over="ignore"):
        return np.concatenate([table, np.cumprod(steps, dtype=np.uint64)])


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < size:
        wanted = max(size, 1 << 16)
        _powers, _inverses = _grown(_powers, BASE, wanted), _grown(_inverses, _INVERSE, wanted)
    return _powers, _inverses


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads the bits of 64-bit values; another salt gives another hash."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def running_hash(data: np.ndarray) -> np.ndarray:
    """Running sums of the bytes of a buffer, weighted by powers of the base."""
    powers, _ = _tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_SYMBOLS[data] * powers[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) of the buffer; equal bytes give equal hashes."""
    _, inverses = _tables(len(sums))
    with np.errstate(over="ignore"):
        return mixed((sums[end] - sums[start]) * inverses[start])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; a null row is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row stands alone."""
    out, first = [], 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        out.append((first, last))
        first = last
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many ranges, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total, dtype=np.int64)
