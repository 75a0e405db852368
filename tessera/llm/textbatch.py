"""Vectorised views of Arrow string columns: bytes, word limits and rolling hashes in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)

#: Word characters are all bytes but space and \x09-\x0D; the same set as bytes.split().
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on a uint64 array."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(1 << 16, 1 << int(n).bit_length())
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size + 1, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers, _inverses


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row limits (n + 1) of a string column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, limits, data = column.buffers()
    at = np.frombuffer(limits, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_chunks(limits: np.ndarray, most: int):
    """Row ranges of about ``most`` bytes; a longer row stands alone."""
    n, start = len(limits) - 1, 0
    while start < n:
        end = int(np.searchsorted(limits, limits[start] + most, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of value(b) * BASE^pos over bytes i..j-1, modulo 2^64."""
    powers, _ = _power_tables(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit hash of each byte span; depends on content only."""
    _, inverses = _power_tables(len(prefix))
    return mix64((prefix[ends] - prefix[starts]) * inverses[starts])


def word_spans(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words; no word crosses a row."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[limits] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(limits, starts, side="right") - 1


def shingles(word_hashes: np.ndarray, rows: np.ndarray, size: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of all runs of ``size`` words.

    A row with fewer words, but at least one, has a single shingle of all its words.
    """
    counts = np.bincount(rows, minlength=n_rows)
    factors = mix64(np.arange(1, size + 1, dtype=np.uint64) * U64(_BASE)) | U64(1)
    n = len(word_hashes) - size + 1
    parts, at = [], []
    if n > 0:
        same = rows[:n] == rows[size - 1 :]
        total = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            total += word_hashes[k : k + n] * factors[k]
        parts.append(mix64(total[same]))
        at.append(rows[:n][same])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.zeros(n_rows + 1, dtype=np.int64)
        np.cumsum(counts, out=first[1:])
        total = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            total[has] += word_hashes[first[short[has]] + k] * factors[k]
        parts.append(mix64(total + counts[short].astype(np.uint64)))
        at.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(parts), np.concatenate(at)
    if len(parts) > 1:
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def sequence_prefix(values: np.ndarray) -> np.ndarray:
    """As ``prefix_hashes``, of a sequence of 64-bit values in place of bytes; ``span_hashes`` takes either."""
    powers, _ = _power_tables(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((mix64(values) | U64(1)) * powers[: len(values)], out=out[1:])
    return out
