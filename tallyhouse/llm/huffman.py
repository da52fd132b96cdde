"""Canonical, length-limited Huffman codes over whole numbers: building, packing and table-driven decoding.

A code is its lengths alone: of the symbols in order of (length, symbol) each takes the next free code word. Ids are
packed one after the other; at every `BLOCK_IDS` ids the bit offset is noted, so that blocks decode independently.
Decoding walks all wanted blocks in step: one look into a table of 2 ** (longest code) entries gives the id and
the length of the code word in front.
"""

from __future__ import annotations

import numpy as np

LONGEST = 18
BLOCK_IDS = 1024
#: a window of 32 bits is read at a whole byte, so up to seven of its bits lie before the code word
WINDOW_ROOM = 32 - 7


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Bits per symbol, 0 for those that never occur; optimal among codes with no word above `longest` bits.

    Package-merge: each level is the sorted list of all leaves and of the pairs of the level before. The leaves
    in the part taken of a level are a prefix of the rarest symbols, and each of these gets one bit more.
    """
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    longest = max(longest, int(len(used) - 1).bit_length())
    if longest > WINDOW_ROOM:
        raise ValueError(f"{len(used)} symbols need more than {WINDOW_ROOM} bits")
    ranked = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[ranked].astype(np.int64)
    level, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(longest - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([leaves, level[0:even:2] + level[1:even:2]])
        order = np.argsort(both, kind="stable")
        is_leaf.append(order < len(leaves))
        level = both[order]
    taken, bits = 2 * len(leaves) - 2, np.zeros(len(leaves), np.uint8)
    for flags in reversed(is_leaf):
        rare = int(flags[:taken].sum())
        bits[:rare] += 1
        taken = 2 * (taken - rare)
    lengths[ranked] = bits
    return lengths


class Code:
    """Code words and decoding table of given lengths."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        used = np.flatnonzero(lengths)
        ordered = used[np.argsort(lengths[used], kind="stable")]
        bits = self.lengths[ordered]
        self.longest = int(bits[-1]) if len(bits) else 1
        spans = 1 << (self.longest - bits)
        self.words = np.zeros(len(lengths), np.uint64)
        self.words[ordered] = ((np.cumsum(spans) - spans) >> (self.longest - bits)).astype(np.uint64)
        entries = np.repeat((ordered << 5 | bits).astype(np.uint32), spans)
        self.table = np.ones(1 << self.longest, np.uint32)
        self.table[: len(entries)] = entries

    def pack(self, ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[bytes, np.ndarray]:
        """The bit stream and the bit offset of every block."""
        bits = self.lengths[ids]
        ends = np.cumsum(bits)
        starts = ends - bits
        if not len(ids):
            return b"", starts
        words = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
        aligned = self.words[ids] << (64 - bits).astype(np.uint64)
        at, inside = starts >> 6, (starts & 63).astype(np.uint64)
        heads = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[heads]] = np.bitwise_or.reduceat(aligned >> inside, heads)
        over = np.flatnonzero((starts & 63) + bits > 64)
        words[at[over] + 1] |= aligned[over] << (np.uint64(64) - inside[over])
        return words.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], starts[::block]

    def unpack(self, stream: bytes, offsets: np.ndarray, count: int, block: int = BLOCK_IDS) -> np.ndarray:
        """`count` ids from the blocks at `offsets`; all blocks but the last are full."""
        if not count:
            return np.zeros(0, np.uint32)
        # the last block is walked to its full length and cut afterwards
        data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(block * self.longest // 8 + 8, np.uint8)])
        windows = np.zeros(len(data) - 3, np.uint32)
        for k in range(4):
            windows |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(24 - 8 * k)
        at, shift = offsets.astype(np.int64), np.uint32(32 - self.longest)
        found = np.empty((min(block, count), len(offsets)), np.uint32)
        for step in range(len(found)):
            window = windows[at >> 3] << (at & 7).astype(np.uint32)
            entry = self.table[window >> shift]
            found[step] = entry >> np.uint32(5)
            at += entry & np.uint32(31)
        return found.T.ravel()[:count]
