"""Words of whole texts, located and hashed for a whole Arrow batch at a time.

A word is a run of bytes other than ASCII white space (space, \\t, \\n, \\v, \\f, \\r), which
is the same as ``[^\\x20\\x09-\\x0D]+`` over code points. All work is numpy over the batch's own
UTF-8 buffer, in blocks of about ``STEP`` bytes, so memory does not grow with the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Lower case, ASCII punctuation as white space.
PLAIN = np.where((LOWER >= 0x80) | np.isin(LOWER, np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)), LOWER, 0x20).astype(np.uint8)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        both = []
        for base in (_BASE, _BASE_INV):
            step = np.full(size, base)
            step[0] = 1
            both.append(np.cumprod(step, dtype=np.uint64))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def row_blocks(offsets: np.ndarray, step: int = STEP) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``step`` bytes; one longer text is a range of its own."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + step, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def _cut(data: np.ndarray, low: int) -> int:
    """Where a piece that starts at ``low`` ends: after white space, so that no word is cut."""
    high = low + STEP
    if high >= len(data):
        return len(data)
    space = np.flatnonzero(WHITE[data[max(low, high - 4096) : high]])
    if len(space):
        return max(low, high - 4096) + int(space[-1]) + 1
    while high < len(data):
        space = np.flatnonzero(WHITE[data[high : high + 4096]])
        if len(space):
            return high + int(space[0]) + 1
        high += 4096
    return len(data)


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hashes, bounds): row r has the words bounds[r] to bounds[r + 1].

    ``table`` (LOWER or PLAIN) replaces bytes beforehand.
    """
    starts, ends, hashes, low = [], [], [], 0
    firsts = offsets[:-1]
    while low < len(data):
        high = _cut(data, low)
        part = data[low:high]
        if table is not None:
            part = table[part]
        solid = ~WHITE[part]
        new = np.zeros(len(part) + 1, bool)
        inside = firsts[(firsts >= low) & (firsts < high)] - low
        new[inside] = True
        new[-1] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | new[1:-1]
        over = solid.copy()
        over[:-1] &= ~solid[1:] | new[1:-1]
        b, e = np.flatnonzero(begin), np.flatnonzero(over) + 1
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTER[part] * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64)))
        starts.append(b + low)
        ends.append(e + low)
        low = high
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    begun = np.concatenate(starts)
    return begun, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(begun, offsets)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` words in order; entry i covers i to i + width - 1, row ends ignored."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + hashes[k : k + n])
    return out


def inside_rows(bounds: np.ndarray, width: int, n: int) -> np.ndarray:
    """Of the ``n`` windows, which lie in one row."""
    ok = np.ones(n, bool)
    for k in range(1, width):
        edge = bounds[1:-1] - k
        ok[edge[(edge >= 0) & (edge < n)]] = False
    return ok


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` from bounds[r] to bounds[r + 1]."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
