"""Suffix sorting in two stages, for the substrings of many segments at once.

Only suffixes that are smaller than their successor are sorted directly, by eight bytes a round. All others are induced:
going through the sorted buckets in rising order of the first byte, the suffix before each sorted one falls into place
behind those already induced in its own bucket. Equal neighbours are then found by comparing common prefixes.
"""

from __future__ import annotations

import numpy as np


def layout(segments: list[bytes], starts: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes raised by one behind each other, each segment closed by zeros, with for every place: the end of its
    segment, whether a window starts there, and whether its suffix takes part.

    `starts` counts the windows of each segment; a segment has `width` - 1 bytes more.
    """
    pad = 8
    size = sum(map(len, segments)) + pad * len(segments) + width + pad
    data = np.zeros(size, np.uint8)
    ends, window = np.zeros(size, np.int64), np.zeros(size, bool)
    at = 0
    for segment, count in zip(segments, starts, strict=True):
        stop = at + len(segment)
        data[at:stop] = np.frombuffer(segment, np.uint8)
        data[at:stop] += 1
        ends[at : stop + pad] = stop
        window[at : at + count] = True
        at = stop + pad
    return data, ends, window, _smaller_than_next(data)


def _smaller_than_next(data: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one a byte further on; the zeros behind a segment decide its end."""
    step = np.zeros(len(data), np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    # the next place at or behind each one where the byte changes
    change = np.where(step != 0, np.arange(len(data)), len(data) - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]
    return step[change] > 0


def _word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that sorts like them."""
    whole = np.ndarray(len(data) - 7, ">u8", data, 0, (1,))
    return whole[np.minimum(at, len(whole) - 1)].astype(np.uint64)


def direct_sort(data: np.ndarray, ends: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The given suffixes in order of their first `width` bytes."""
    order = at[np.argsort(_word(data, at), kind="stable")]
    key = _word(data, order)
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(order) else np.zeros(0, np.int64)
    active = np.arange(len(order))
    for depth in range(8, width, 8):
        # places still tied with a neighbour
        mine = group[active]
        tied = np.zeros(len(active), bool)
        same = mine[1:] == mine[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        active, mine = active[tied], mine[tied]
        if not len(active):
            break
        place = order[active]
        key = np.where(place + depth < ends[place], _word(data, place + depth), 0)
        heads = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
        sizes = np.diff(np.append(heads, len(mine)))
        mixed = np.repeat(np.minimum.reduceat(key, heads) != np.maximum.reduceat(key, heads), sizes)
        if not mixed.any():
            continue
        some = np.flatnonzero(mixed)
        inner = np.lexsort((key[some], mine[some]))
        order[active[some]] = place[some][inner]
        key[some] = key[some][inner]
        # a new group starts wherever the key changes inside an old one; numbers stay in rising order
        fresh = np.zeros(len(order), np.int64)
        fresh[active[1:]] = (mine[1:] == mine[:-1]) & (key[1:] != key[:-1])
        group = group + np.cumsum(fresh)
    return order


def sort_suffixes(data: np.ndarray, ends: np.ndarray, window: np.ndarray, smaller: np.ndarray, width: int) -> np.ndarray:
    """The places where windows start, in order of the `width` bytes there."""
    inside = np.arange(len(data)) < ends
    # a window's chain of successors is followed to the next directly sorted one, or to the end of its segment
    stop = np.where(smaller | ~inside, np.arange(len(data)), len(data) - 1)
    stop = np.minimum.accumulate(stop[::-1])[::-1]
    last = np.flatnonzero(window & ~np.append(window[1:], False))
    taken = window.copy()
    reach = np.zeros(len(data) + 1, np.int64)
    np.add.at(reach, last, 1)
    np.add.at(reach, np.minimum(stop[last], len(data) - 1) + 1, -1)
    taken |= np.cumsum(reach[:-1]) > 0
    closing = taken & ~inside  # the empty suffix behind a segment, smallest of all
    direct = np.flatnonzero(taken & smaller & inside)
    induced = taken & ~smaller & inside
    sorted_direct = direct_sort(data, ends, direct, width)
    bounds = np.searchsorted(data[sorted_direct], np.arange(258)) if len(sorted_direct) else np.zeros(258, np.int64)
    waiting: dict[int, list[np.ndarray]] = {}

    def pass_on(placed: np.ndarray, above: int) -> None:
        """Queue the induced predecessors of placed suffixes with a larger first byte, in order."""
        before = placed - 1
        before = before[(before >= 0)]
        before = before[induced[before] & (data[before] > above)]
        letters = data[before]
        ranked = np.argsort(letters, kind="stable")
        before, letters = before[ranked], letters[ranked]
        for head, past in _runs(letters):
            waiting.setdefault(int(letters[head]), []).append(before[head:past])

    out = []
    pass_on(np.flatnonzero(closing), 0)
    for letter in range(1, 257):
        parts = []
        current = np.concatenate(waiting.pop(letter)) if letter in waiting else np.zeros(0, np.int64)
        while len(current):
            parts.append(current)
            before = current - 1
            before = before[before >= 0]
            current = before[induced[before] & (data[before] == letter)]
        parts.append(sorted_direct[bounds[letter] : bounds[letter + 1]])
        placed = np.concatenate(parts)
        if len(placed):
            pass_on(placed, letter)
            out.append(placed)
    ranked = np.concatenate(out) if out else np.zeros(0, np.int64)
    return ranked[window[ranked]]


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    if not len(values):
        return []
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return list(zip(heads.tolist(), np.append(heads, len(values))[1:].tolist(), strict=True))


def equal_neighbours(data: np.ndarray, ranked: np.ndarray, width: int) -> np.ndarray:
    """For each sorted window but the last, whether the common prefix with the next one reaches `width`."""
    equal = np.zeros(max(len(ranked) - 1, 0), bool)
    left = np.arange(len(equal))
    for depth in [*range(0, width - 7, 8), width - 8]:
        left = left[_word(data, ranked[left] + depth) == _word(data, ranked[left + 1] + depth)]
    equal[left] = True
    return equal


def repeated_windows(segments: list[bytes], starts: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of windows in sorted order, whether each repeats, whether it is the first of its equals, bytes)."""
    data, ends, window, smaller = layout(segments, starts, width)
    ranked = sort_suffixes(data, ends, window, smaller, width)
    equal = equal_neighbours(data, ranked, width)
    repeats, first = np.zeros(len(ranked), bool), np.ones(len(ranked), bool)
    repeats[:-1] |= equal
    repeats[1:] |= equal
    first[1:] = ~equal
    return ranked, repeats, first, data
