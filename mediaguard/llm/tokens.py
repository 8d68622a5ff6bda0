"""Words of whole Arrow batches of texts as 64-bit hashes, without a Python object per word."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_PLAIN = _BLANK.copy()  # ASCII punctuation parts words too
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_TERM = np.zeros(256, bool)  # all of ASCII but letters and digits parts terms
_TERM[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True
GAPS = {"space": _BLANK, "plain": _PLAIN, "term": _TERM}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 2 ** 63, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit numbers; another seed gives another order."""
    h = h ^ np.uint64((seed * 0xD6E8FEB86659FD93) % (1 << 64))
    for _ in range(2):  # in place: arrays of their own size are not made anew at each step
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _power(which: str, base: int, n: int) -> np.ndarray:
    if len(_powers[which]) < n:
        row = np.full(max(n, BLOCK + 1), base, np.uint64)
        row[0] = 1
        _powers[which] = np.cumprod(row)
    return _powers[which][:n]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string array; nulls are empty."""
    texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], width)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def words(texts: pa.Array, plain: bool = False, gaps: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, row) of each word, ASCII capitals lowered; bytes count from the row's start.
    ``plain`` parts words at ASCII punctuation as well, ``gaps`` names what parts them.

    Works on blocks of rows; a text above a block is cut between words.
    """
    h, first, _, rows = spans(texts, plain, gaps)
    return h, first - _buffers(texts)[1][rows], rows


def spans(texts: pa.Array, plain: bool = False, gaps: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, row) of each word; bytes count in the array's buffer."""
    data, at = _buffers(texts)
    blank = GAPS[gaps or ("plain" if plain else "space")]
    found = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    row = 0
    while row < len(at) - 1:
        last = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1)
        start, end = int(at[row]), int(at[last])
        while start < end:
            stop = min(end, start + BLOCK)
            if stop < end:
                gaps = np.flatnonzero(blank[data[start:stop]])
                if len(gaps):
                    stop = start + int(gaps[-1]) + 1
                else:  # one word longer than a block
                    more = np.flatnonzero(blank[data[stop:end]])
                    stop = stop + int(more[0]) + 1 if len(more) else end
            h, first, last_at = _block(data[start:stop], at[row:last + 1] - start, blank)
            rows = np.searchsorted(at[row:last + 1], first + start, "right") - 1 + row
            found.append((h, first + start, last_at + start, rows))
            start = stop
        row = last
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _block(data: np.ndarray, edges: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    full = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[edges[(edges >= 0) & (edges <= len(data))]] = True
    first = full.copy()
    first[1:] &= ~full[:-1] | edge[1:-1]
    last = full
    last[:-1] &= ~full[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power("up", _STEP, len(data)), out=sums[1:])
    return mix((sums[b] - sums[a]) * _power("down", _BACK, len(data) + 1)[a]), a, b


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` rows begins among sorted row numbers; one more for the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def windows(h: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first-word places of all runs of ``size`` words inside one row."""
    if len(h) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(_STEP) + h[i:i + n]
    at = np.flatnonzero(rows[:n] == rows[size - 1:])
    return mix(out[at], size), at


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column from one array per row."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 2 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes in a string column, or one row."""
    for b in batches:
        at = _buffers(b[column])[1]
        row = 0
        while row < b.num_rows:
            last = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
            yield b.slice(row, last - row)
            row = last
