"""Periodic runs of words by a dictionary of basic factors.

For every power of two the dictionary names each stretch of that many words: two stretches have one name if and
only if they are equal, and a stretch that occurs once has none. A name is made of the names of the two halves.
Per length, the next occurrence of each named stretch is read from the same sort. Where it follows within twice
the length, and the one after it at the same distance, the three form an arithmetic progression that proposes its
difference as a period. That difference is always the smallest period of what the three cover, since a smaller one
would have shown an earlier occurrence. Proposals are extended both ways by comparing names from long to short, and
equal runs found from several lengths are merged.

No run is missed: one with smallest period q and at least 4 q words holds, at its first word, three occurrences at
distance q of the stretch whose length is the least power of two not below q.

A block holds whole documents of about `BLOCK_WORDS` words; equal words of different documents get different
names, so nothing crosses documents. Work and memory per document of n words are in O(n log n) at worst, and a
length at which no stretch recurs ends it. Every document is its own row of work; there is no shuffle.

Cases: a null or empty text has no words, no runs and an empty collapsed text; repeated rows are treated alike; a
document of any length is handled whole; an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import bound, words

LEAST_WORDS = 6
LEAST_PERIODS = 4
BLOCK_WORDS = 1 << 18

RUNS = "array<struct<start: long, length: long, period: long>>"


def _named(keys: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per place a name of its key, -1 for none or a single one, and the distance to the next place with that key, or 0.

    `at` are the places in rising order, `keys` their keys.
    """
    names, gaps = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    order = np.argsort(keys, kind="stable")
    ranked, places = keys[order], at[order]
    same = ranked[1:] == ranked[:-1]
    again = np.zeros(len(keys), bool)
    again[1:] |= same
    again[:-1] |= same
    heads = np.ones(len(keys), bool)
    heads[1:] = ~same
    names[places[again]] = np.cumsum(heads & again)[again] - 1
    gaps[places[:-1][same]] = (places[1:] - places[:-1])[same]
    return names, gaps


def _dictionary(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Names and gaps for stretches of 1, 2, 4 ... words, as long as any recurs."""
    size, length = len(symbols), 1
    names, gaps = _named(symbols, np.arange(size), size)
    while (names >= 0).any():
        yield names, gaps
        places = size - 2 * length + 1
        if places <= 0:
            return
        first, second = names[:places], names[length : length + places]
        at = np.flatnonzero((first >= 0) & (second >= 0))
        names, gaps = _named(first[at] * size + second[at], at, places)
        length *= 2


def _proposals(gaps: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and differences of progressions, without those that go on from the word before."""
    near = np.flatnonzero((gaps > 0) & (gaps <= 2 * length))
    near = near[gaps[near + gaps[near]] == gaps[near]]
    if not len(near):
        return near, near
    gap = gaps[near]
    head = np.ones(len(near), bool)
    head[1:] = (near[1:] != near[:-1] + 1) | (gap[1:] != gap[:-1])
    return near[head], gap[head]


def _equal_ahead(levels: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many words from `one` on equal those from the later `other` on."""
    length = np.zeros_like(one)
    for level in range(len(levels) - 1, -1, -1):
        names = levels[level]
        fits = np.flatnonzero(other + length < len(names))
        left = names[one[fits] + length[fits]]
        length[fits[(left >= 0) & (left == names[other[fits] + length[fits]])]] += 1 << level
    return length


def _equal_behind(levels: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many words before `one` equal those before the later `other`."""
    length = np.zeros_like(one)
    for level in range(len(levels) - 1, -1, -1):
        names = levels[level]
        fits = np.flatnonzero(one - length >= 1 << level)
        left = names[one[fits] - length[fits] - (1 << level)]
        length[fits[(left >= 0) & (left == names[other[fits] - length[fits] - (1 << level)])]] += 1 << level
    return length


def find_runs(symbols: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    levels, starts, periods = [], [], []
    for level, (names, gaps) in enumerate(_dictionary(symbols)):
        levels.append(names)
        start, period = _proposals(gaps, 1 << level)
        starts.append(start)
        periods.append(period)
    if not levels:
        return np.zeros((0, 3), np.int64)
    start, period = np.concatenate(starts), np.concatenate(periods)
    before = _equal_behind(levels, start, start + period)
    length = before + period + _equal_ahead(levels, start, start + period)
    runs = np.stack([start - before, period, length], axis=1)
    runs = np.unique(runs[length >= np.maximum(least_words, least_periods * period)], axis=0)
    return runs[:, [0, 2, 1]]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("words")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        first = 0
        while first < batch.num_rows:
            past = int(np.searchsorted(offsets, offsets[first] + BLOCK_WORDS, "right")) - 1
            past = min(batch.num_rows, max(first + 1, past))
            yield _block(batch.column("doc_id").slice(first, past - first),
                         lists.values.slice(offsets[first], offsets[past] - offsets[first]), offsets[first : past + 1] - offsets[first])
            first = past


def _block(ids: pa.Array, values: pa.Array, offsets: np.ndarray) -> pa.RecordBatch:
    coded = values.dictionary_encode()
    owners = np.repeat(np.arange(len(ids)), np.diff(offsets))
    symbols = owners * max(1, len(coded.dictionary)) + coded.indices.to_numpy().astype(np.int64)
    runs = find_runs(symbols)
    start, length, period = runs.T
    # each run covers what follows its first period
    depth = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(depth, start + period, 1)
    np.add.at(depth, start + length, -1)
    kept = np.cumsum(depth[:-1]) == 0
    counted = np.concatenate([[0], np.cumsum(kept)])
    left = pa.ListArray.from_arrays(pa.array(counted[offsets], pa.int32()), values.filter(pa.array(kept)))
    owner = owners[start]
    fields = [pa.array(start - offsets[owner]), pa.array(length), pa.array(period)]
    listed = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(len(ids) + 1)), pa.int32()),
        pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([ids, listed, pc.binary_join(left, " ")], names=["doc_id", "runs", "collapsed"])


def runs_of(numbered: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) for rows (doc_id long, words array<string>)."""
    return numbered.select("doc_id", "words").mapInArrow(_found, f"doc_id long, runs {RUNS}, collapsed string")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """The runs of every text, and the text with each run cut to its first period."""
    return runs_of(docs.select(docs["doc_id"].cast("long").alias("doc_id"), words(docs["text"]).alias("words")))


def with_loops(doc_id: Column, found: Column) -> Column:
    """The words, where every tenth document (by a hash of its id) goes round in a loop from some word on."""
    number = F.crc32(doc_id.cast("string"))
    spread = F.floor(number / 10)

    def looped(w: Column) -> Column:
        count = F.greatest(F.size(w), F.lit(1))
        at = (spread % count).cast("int")
        period = (1 + F.floor((count - at) / (3 + spread % 8))).cast("int")
        turns = F.ceil((count - at) / period).cast("int")
        loop = F.slice(F.flatten(F.array_repeat(F.slice(w, at + 1, period), turns)), F.lit(1), count - at)
        return F.when((F.size(w) > 0) & (number % 10 == 0), F.concat(F.slice(w, F.lit(1), at), loop)).otherwise(w)

    return bound(found, looped)


def digest_rows(docs: DataFrame) -> DataFrame:
    """Number of runs, the longest one and digests of all runs and of the collapsed words, after `with_loops`."""
    numbered = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                           with_loops(docs["doc_id"], words(docs["text"])).alias("words"))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    spelt = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = runs_of(numbered).withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.back")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.short")).alias("exponent_milli"),
        F.sha2(F.array_join(spelt, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
