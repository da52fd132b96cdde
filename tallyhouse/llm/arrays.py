"""Whole texts as byte arrays: words and their hashes for many documents at once.

Lengths are never cut: a block holds as many documents as fit its byte limit, a longer document is a block
of its own, and inside a block the byte arrays are walked in windows that end at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
WINDOW_BYTES = 1 << 21

_WORD_TABLE = np.random.Generator(np.random.PCG64(20240601)).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: byte codes with A-Z lowered; blanks count nothing
_CODES = _WORD_TABLE.copy()
_CODES[np.arange(65, 91)] = _WORD_TABLE[np.arange(97, 123)]
_CODES[BLANKS] = 0
_EXACT_CODES = _WORD_TABLE.copy()
_EXACT_CODES[BLANKS] = 0


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, count: int) -> np.ndarray:
    """base ** 0 ... base ** (count - 1), modulo 2 ** 64."""
    out = np.full(count, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


_POWERS = powers(_BASE, WINDOW_BYTES)
_INVERSE_POWERS = powers(_BASE_INVERSE, WINDOW_BYTES)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets; a null text is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (whole[ends[0] : ends[-1]], ends - ends[0]) if len(ends) else (whole[:0], np.zeros(1, np.int64))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past row, bytes, offsets) of runs of documents of about `limit` bytes."""
    data, offsets = text_bytes(column)
    first, count = 0, len(column)
    while first < count:
        past = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        past = min(count, max(first + 1, past))
        yield first, past, data[offsets[first] : offsets[past]], offsets[first : past + 1] - offsets[first]
        first = past


def _windows(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Windows of at most `limit` bytes that end behind white space, wherever there is any."""
    at = 0
    while at < len(data):
        end = min(len(data), at + limit)
        while end < len(data):
            blank = np.flatnonzero(BLANKS[data[max(at, end - 4096) : end]])
            if len(blank):
                end = max(at, end - 4096) + int(blank[-1]) + 1
                break
            end = min(len(data), end + 4096)
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word and the number of its document, in text order."""
    codes = _CODES if lower else _EXACT_CODES
    hashes, owners = [], []
    for at, end in _windows(data, WINDOW_BYTES):
        part = data[at:end]
        inside = ~BLANKS[part]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        # a document starts a new word even behind a word
        edges = offsets[(offsets > at) & (offsets < end)] - at
        starts[edges] = inside[edges]
        ends = np.zeros(len(part) + 1, bool)
        ends[1:-1] = inside[:-1] & ~inside[1:]
        ends[edges] |= inside[edges - 1]
        ends[-1:] = inside[-1:]
        first, past = np.flatnonzero(starts), np.flatnonzero(ends)
        if not len(first):
            continue
        up, down = (_POWERS, _INVERSE_POWERS) if len(part) <= len(_POWERS) else (
            powers(_BASE, len(part)), powers(_BASE_INVERSE, len(part)))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes[part] * up[: len(part)], out=sums[1:])
        words = (sums[past] - sums[first]) * down[first]
        hashes.append(mix(words + (past - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        owners.append(np.searchsorted(offsets, first + at, "right") - 1)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def shingle_hashes(words: np.ndarray, owners: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every window of `width` words that lies in one document, and that document."""
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(words) - width + 1
    out = np.zeros(count, np.uint64)
    for k, factor in enumerate(powers(0xC2B2AE3D27D4EB4F, width + 1)[1:]):
        out += mix(words[k : k + count] + np.uint64(k)) * factor
    whole = owners[:count] == owners[width - 1 :]
    return mix(out[whole]), owners[:count][whole]
