"""Text features for the small classifiers: letter-class trigrams, hashed words and repetition.

Only the text is read. All features are counts or shares over the whole text.
"""

from __future__ import annotations

import numpy as np

from tallyhouse.llm.arrays import mix, shingle_hashes, word_hashes

CLASSES = 16
TRIGRAMS = CLASSES**3
WORD_BUCKETS = 1 << 13
SHARES = 4

_CLASS = np.full(256, 15, np.uint16)
_CLASS[0x80:] = 5
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(65, 91)]] = 3
_CLASS[[*range(48, 58)]] = 4
_CLASS[[0x20, 0x09]] = 0
_CLASS[[0x0A, 0x0B, 0x0C, 0x0D]] = 1
for _number, _letters in enumerate((".", ",", "!", "|", "#", "*", "$", "%&", "<>"), 6):
    _CLASS[[ord(c) for c in _letters]] = _number


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, TRIGRAMS) counts of three letter classes in a row, white space around the text included."""
    count = len(offsets) - 1
    out = np.zeros((count, TRIGRAMS), np.float32)
    step = 1 << 21
    for doc in range(count):
        first, past = int(offsets[doc]), int(offsets[doc + 1])
        for at in range(first, past, step):
            part = _CLASS[data[max(first, at - 2) : min(past, at + step)]]
            part = np.concatenate([[0] * (2 if at == first else 0), part, [0] if at + step >= past else []]).astype(np.uint16)
            codes = (part[:-2] * CLASSES + part[1:-1]) * CLASSES + part[2:]
            out[doc] += np.bincount(codes, minlength=TRIGRAMS)
    return out


def shares(words: np.ndarray, owners: np.ndarray, count: int) -> np.ndarray:
    """(documents, SHARES): words equal to the one before, repeated words, repeated word triples, emptiness."""
    out = np.zeros((count, SHARES), np.float32)
    total = np.maximum(np.bincount(owners, minlength=count), 1)
    if len(words) > 1:
        same = (words[1:] == words[:-1]) & (owners[1:] == owners[:-1])
        out[:, 0] = np.bincount(owners[1:][same], minlength=count) / total
    for k, (values, whose) in enumerate(((words, owners), shingle_hashes(words, owners, 3)), 1):
        # document and 40 bits of the hash in one number, so that one plain sort brings equals together
        keys = np.sort((whose.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
        again = keys[1:][keys[1:] == keys[:-1]] >> np.uint64(40)
        out[:, k] = np.bincount(again.astype(np.int64), minlength=count) / total
    out[:, 3] = np.bincount(owners, minlength=count) == 0
    return out


def word_buckets(words: np.ndarray) -> np.ndarray:
    return (mix(words + np.uint64(99)) >> np.uint64(64 - 13)).astype(np.int64)


def presence(words: np.ndarray, owners: np.ndarray, count: int, buckets: np.ndarray) -> np.ndarray:
    """(documents, buckets) 1 where a text has a word of the given bucket; `buckets` is sorted."""
    found = word_buckets(words)
    at = np.searchsorted(buckets, found)
    hit = at < len(buckets)
    hit[hit] = buckets[at[hit]] == found[hit]
    out = np.zeros((count, len(buckets)), np.float32)
    out[owners[hit], at[hit]] = 1
    return out


def style(data: np.ndarray, offsets: np.ndarray, hashed: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """(documents, TRIGRAMS + SHARES): damped trigram counts of unit length, and the shares."""
    words, owners = hashed or word_hashes(data, offsets, lower=False)
    damped = np.log1p(trigram_counts(data, offsets))
    damped /= np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-9)
    return np.hstack([damped, shares(words, owners, len(offsets) - 1)])


def style_and_words(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray | None = None) -> np.ndarray:
    """Style features and the presence of hashed words, all of them or the sorted positions `kept`."""
    hashed = word_hashes(data, offsets, lower=False)
    before = TRIGRAMS + SHARES
    if kept is None:
        kept = np.arange(before + WORD_BUCKETS)
    split = np.searchsorted(kept, before)
    words = presence(*hashed, len(offsets) - 1, kept[split:] - before)
    return np.hstack([style(data, offsets, hashed)[:, kept[:split]], words])
