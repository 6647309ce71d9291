"""Hashes of words and byte strings, in numpy over blocks of texts inside a task.

A block holds the UTF-8 bytes of some texts end to end. Its hashes are polynomials over
the bytes, taken modulo 2**64 from one running sum for all positions, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_power_table: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    if bits not in _power_table:
        _power_table.clear()
        out = []
        for x in (_BASE, _INVERSE):
            steps = np.full(1 << bits, x, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=np.uint64))
        _power_table[bits] = (out[0], out[1])
    return _power_table[bits]


def text_blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of blocks; null texts are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def running_sum(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums for ``span_hashes``: of the bytes before each position, and the factor that shifts them to it."""
    n = len(data)
    power, inverse = _powers(max(20, int(n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return sums, inverse


def span_hashes(sums: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total, inverse = sums
    return mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words_in(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words of a block, A-Z lower-cased if asked, and the first word of each row (and the end)."""
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATES[data]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, span_hashes(running_sum(data), starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its ``width``-word shingles); fewer words make one shingle, none make an empty set."""
    for row, end, data, offsets in text_blocks(texts):
        _, _, hashes, first = words_in(data, offsets, lower=True)
        n = len(hashes)
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total[: max(0, n - k)] += hashes[k:] * _WEIGHTS[k % len(_WEIGHTS)] * np.uint64(2 * (k // len(_WEIGHTS)) + 1)
        total = mixed(total)
        for i in range(end - row):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                yield row + i, np.unique(total[a : b - width + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(a, b):
                    short = mixed(short * _WEIGHTS[1] + hashes[k : k + 1])
                yield row + i, short
            else:
                yield row + i, np.zeros(0, np.uint64)
