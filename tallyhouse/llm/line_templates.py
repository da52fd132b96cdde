"""Line dedup by a log-template tree.

Each line goes down a tree of fixed depth: its number of words, then its first `LEAD` words, where a word that
holds a digit is a variable field. At a leaf, a word at a position is constant if at least `min_texts` different
texts have it there, and otherwise variable; the line with its variable fields blanked is its template, if at least
half of its words are constant. A template found in at least `min_texts` different texts is boilerplate: its lines are
dropped everywhere but in the text that has it first (smallest document id).

A whole line, equal word by word, is boilerplate at far fewer texts, the more words it has the fewer (`WHOLE`). Texts
whose 5-word shingles have a Jaccard similarity of 0.8 or more count as one there: near copies are a matter of whole
documents. The similarity is an estimate from the `SKETCH` smallest shingle hashes, exact for texts with no more;
only texts with a line in question are sketched. At `min_texts` texts nothing is compared, as for templates.

Counting is over different texts, so exact copies of one document never make its lines boilerplate. All
counts are partial aggregates before a shuffle; no leaf and no template is gathered in one task, and of a line only
the sketches of fewer than `min_texts` texts. Whole lines and leaves are told apart by 64-bit hashes of their words.

Texts are not shuffled to be looked at: bitmaps of `FILTER_BITS` bits pick lines, sketches and documents where they lie,
and an exact join follows. A bitmap that fills up lets more through and loses nothing.

Cases: null texts stay null; lines without a word are never dropped; a line repeated in one text counts once there;
null ids come after all others; texts equal to the first holder keep their lines as well; an empty table gives an
empty table; other columns pass through, and `n_chars`, if there is one, is counted anew where lines went.
Texts are told apart by a 128-bit digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.arrays import blocks, mix, word_hashes
from tallyhouse.llm.common import bound, cut, free_name, own, words
from tallyhouse.llm.jaccard import PERCENT, shingle_sets

LEAD = 3
MIN_TEXTS = 20
#: (words, texts): a whole line of so many words is boilerplate in so many texts that are no near copies
WHOLE = ((50, 2), (8, 3), (4, 8))
SKETCH = 128
FILTER_BITS = 1 << 24
FIELD = "<*>"


def _masked(word: Column) -> Column:
    return F.when(word.rlike("[0-9]"), F.lit(FIELD)).otherwise(word)


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter(
        F.col("text").isNotNull())


def _recurring(rows: DataFrame, by: str, min_texts: int) -> DataFrame:
    """Values of `by` found in at least `min_texts` different texts."""
    return rows.select(by, "key").distinct().groupBy(by).count().filter(F.col("count") >= min_texts).select(by)


def _line_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, first byte) of every line."""
    breaks = np.flatnonzero(data == 0x0A)
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, owner))
    owner, starts = owner[order], starts[order]
    return owner, np.arange(len(owner)) - np.searchsorted(owner, owner), starts


def _grouped(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, and the line, first word and number of words of every line with a word."""
    found, line = word_hashes(data, edges, lower=False)
    first = np.flatnonzero(np.diff(line, prepend=-1))
    return found, line[first], first, np.diff(np.append(first, len(line)))


def _sequence_hashes(found: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(first):
        return np.zeros(0, np.uint64)
    place = np.arange(len(found)) - np.repeat(first, counts)
    hashes = np.add.reduceat(mix(found + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
    return mix(hashes + counts.astype(np.uint64))


def _leaf_hashes(data: np.ndarray, edges: np.ndarray, found: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A leaf stands for the number of words and the first `LEAD` of them, those with a digit all alike."""
    leaf = mix(counts.astype(np.uint64))
    if not len(first):
        return leaf
    # a word that changes where its digits do holds one
    plain, _ = word_hashes(np.where((data >= 0x30) & (data <= 0x39), np.uint8(0x61), data), edges, lower=False)
    for k in range(LEAD):
        at = np.minimum(first + k, len(found) - 1)
        word = np.where(plain[at] == found[at], found[at], np.uint64(0))
        leaf = np.where(counts > k, mix(leaf * np.uint64(0x9FB21C651E98DF25) + word), leaf)
    return leaf


def line_leaves(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, leaf, first byte, past byte) of every line with a word."""
    owner, number, starts = _line_starts(data, offsets)
    edges = np.append(starts, len(data))
    found, rows, first, counts = _grouped(data, edges)
    last = np.append(owner[1:] != owner[:-1], True)  # the last line of a text has no line feed
    return owner[rows], number[rows], _leaf_hashes(data, edges, found, first, counts), starts[rows], (edges[1:] - ~last)[rows]


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line number, hash of the word sequence, words, leaf) of every line with a word."""
    owner, number, starts = _line_starts(data, offsets)
    edges = np.append(starts, len(data))
    found, rows, first, counts = _grouped(data, edges)
    return owner[rows], number[rows], _sequence_hashes(found, first, counts), counts, _leaf_hashes(data, edges, found, first, counts)


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, _, data, offsets in blocks(batch.column(2)):
            owner, number, hashes, counts, leaf = line_hashes(data, offsets)
            at = pa.array(owner + first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()),
                 pa.array(hashes.view(np.int64)), pa.array(counts, pa.int32()), pa.array(leaf.view(np.int64))],
                names=["key", "doc_id", "pos", "line", "size", "leaf"])


def _held_lines(wanted: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines whose leaves are in the filter, and some others."""
    for batch in batches:
        for first, _, data, offsets in blocks(batch.column(2)):
            owner, number, leaf, start, past = line_leaves(data, offsets)
            at = (leaf % np.uint64(FILTER_BITS)).astype(np.int64)
            held = np.flatnonzero((wanted[at >> 6] >> (at & 63)) & 1 == 1)
            text = data.tobytes()
            lines = [text[a:b] for a, b in zip(start[held].tolist(), past[held].tolist(), strict=True)]
            rows = pa.array(owner[held] + first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(number[held], pa.int32()),
                 pa.array(leaf[held].view(np.int64)), pa.array(lines, pa.binary()).cast(pa.string())],
                names=["key", "doc_id", "pos", "leaf", "line"])


def _bits_of(rows: DataFrame, number: Column, size: int) -> np.ndarray:
    """A bitmap of `size` bits, in words of 64, with those of all numbers set."""
    at = F.pmod(number, F.lit(size))
    bits = rows.select((at / 64).cast("long").alias("word"), F.expr("1L").alias("one"), (at % 64).cast("int").alias("bit"))
    bits = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toPandas()
    found = np.zeros(size // 64, np.int64)
    found[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64)
    return found


def _filter_of(rows: DataFrame, number: Column) -> Broadcast[np.ndarray]:
    """A bitmap of `FILTER_BITS` bits for all tasks, so that texts need no shuffle to be picked."""
    return rows.sparkSession.sparkContext.broadcast(_bits_of(rows, number, FILTER_BITS))


def _number(key: Column) -> Column:
    return F.conv(F.substring(F.hex(key), 1, 12), 16, 10).cast("long")


def _maybe_in(keys: DataFrame, key: Column) -> Column:
    """Whether a bitmap of the keys has the bit of `key`: true for every one of them, and for few others while there is room."""
    size = 1 << 16
    room = 16 * keys.count()
    while size < min(room, FILTER_BITS):
        size *= 2
    bitmap = F.lit(_bits_of(keys, _number(F.col("key")), size).astype("<i8").tobytes())
    at = F.pmod(_number(key), F.lit(size))
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (F.floor(byte / F.pow(F.lit(2), at % 8)) % 2) == 1


def _sketches_of(wanted: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of the texts whose keys are in the filter, and of some others."""
    for batch in batches:
        at = np.array([int.from_bytes(key[:6], "big") % FILTER_BITS for key in batch.column(0).to_pylist()], np.int64)
        batch = batch.filter(pa.array((wanted[at >> 6] >> (at & 63)) & 1 == 1))
        for first, past, data, offsets in blocks(batch.column(1)):
            found = [one[:SKETCH].astype(np.uint64).tobytes() for one in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, past - first), pa.array(found, pa.binary())], names=["key", "sketch"])


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sketches, sorted and distinct, stand for texts of the threshold's similarity."""
    both = np.union1d(a, b)[:SKETCH]
    shared = np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()
    return 100 * int(shared) >= PERCENT * len(both)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of which enough texts are no near copy of a text before them that counts."""
    for batch in batches:
        kept = []
        for line, least, sketches in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            counted: list[np.ndarray] = []
            for sketch in (np.frombuffer(one, np.uint64) for one in sketches):
                if len(counted) < least and not any(near(sketch, other) for other in counted):
                    counted.append(sketch)
            if len(counted) >= least:
                kept.append(line)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["line"])


def _whole_lines(texts: DataFrame, lines: DataFrame, min_texts: int) -> DataFrame:
    """(key, pos) of the lines to drop as repeated whole lines."""
    lines = lines.filter(F.col("size") >= min(size for size, _ in WHOLE)).drop("leaf")
    digest = F.xxhash64("key")
    again = lines.groupBy("line").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).filter("low <> high").select("line")
    lines = cut(lines.join(again, "line"))
    holders = lines.groupBy("line", "key").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"))
    least = F.lit(min_texts)
    for size, count in sorted(WHOLE):
        least = F.when(F.col("size") >= size, F.lit(min(count, min_texts))).otherwise(least)
    counted = holders.groupBy("line").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min(
        F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first"))
    counted = cut(counted.select("line", "n", least.alias("least"), F.col("first.key").alias("holder")).filter("n >= least"))
    few = holders.join(counted.filter(F.col("n") < min_texts).select("line", "least"), "line").select("line", "least", "key", "doc_id")
    few = cut(few)
    # the copies of one text are cut to one row before the shuffle
    wanted = _filter_of(few, _number(F.col("key")))
    sketches = texts.select("key", "text").mapInArrow(lambda batches: _sketches_of(wanted.value, batches), "key binary, sketch binary")
    sketches = sketches.groupBy("key").agg(F.first("sketch").alias("sketch"))
    gathered = few.join(sketches, "key").groupBy("line").agg(F.max("least").alias("least"), F.sort_array(F.collect_list(
        F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "sketch"))).alias("held"))
    apart = gathered.select("line", "least", F.transform("held", lambda h: h["sketch"]).alias("held")).mapInArrow(_apart, "line long")
    known = counted.select("line", "holder")
    boilerplate = known.join(counted.filter(F.col("n") >= min_texts).select("line").union(apart), "line", "left_semi")
    return lines.join(boilerplate, "line").filter("key <> holder").select("key", "pos")


def dropped_lines(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(key, positions): the line numbers to drop from each different text."""
    texts = _ids(docs).select(_key(F.col("text")).alias("key"), "doc_id", "text")
    # every text is split into lines once; what the lines are told apart by is written
    split = cut(texts.select("key", "doc_id", "text").mapInArrow(
        _lines_of, "key binary, doc_id long, pos int, line long, size int, leaf long"))
    whole = _whole_lines(texts, split, min_texts)
    leaves = split.select("leaf", "key").distinct()
    frequent = cut(leaves.groupBy("leaf").count().filter(F.col("count") >= min_texts).select("leaf"))
    # texts stay where they are: a map picks their lines of frequent leaves
    wanted = _filter_of(frequent, F.col("leaf"))
    held = texts.select("key", "doc_id", "text").mapInArrow(
        lambda batches: _held_lines(wanted.value, batches), "key binary, doc_id long, pos int, leaf long, line string")
    lines = cut(held.join(frequent, "leaf").select(
        "key", "doc_id", "pos", "leaf", F.transform(words(F.col("line")), _masked).alias("w")))
    fields = lines.select("key", "leaf", F.posexplode("w").alias("at", "word"))
    constant = fields.distinct().groupBy("leaf", "at", "word").count().filter(F.col("count") >= min_texts)
    spelt = lines.distinct().select("key", "doc_id", "pos", "leaf", F.posexplode("w").alias("at", "word"))
    spelt = spelt.join(constant.withColumn("field", F.col("word")), ["leaf", "at", "word"], "left")
    shaped = spelt.groupBy("key", "doc_id", "pos", "leaf").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("field", F.lit(FIELD)).alias("field")))).alias("w"))
    shaped = shaped.select("key", "doc_id", "pos", "leaf", F.transform("w", lambda w: w["field"]).alias("template"))
    shaped = shaped.filter(2 * F.size(F.filter("template", lambda w: w != FIELD)) >= F.size("template"))
    # read three times
    shaped = cut(shaped.select("key", "doc_id", "pos", F.xxhash64("leaf", "template").alias("template")))
    boilerplate = _recurring(shaped, "template", min_texts)
    first = shaped.groupBy("template").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("first")).select("template", F.col("first.key").alias("holder"))
    gone = shaped.join(boilerplate, "template").join(first, "template").filter("key <> holder")
    gone = gone.select("key", "pos").union(whole)
    return gone.groupBy("key").agg(F.collect_set("pos").alias("positions"))


def drop_lines(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """The input columns with `text` freed of boilerplate lines, and `_n_dropped` (led by more underscores if taken)."""
    gone = cut(dropped_lines(docs, min_texts))
    packed = docs.select(F.struct(*[own(docs, c) for c in docs.columns]).alias("_row"), docs["text"].cast("string").alias("_text"))
    # only rows whose text may lose lines are shuffled; the others, those without a text among them, stay where they are
    hit = F.coalesce(_maybe_in(gone, _key(F.col("_text"))), F.lit(False))
    moved = packed.filter(hit).withColumn("_key", _key(F.col("_text"))).join(
        gone.select(F.col("key").alias("_key"), F.col("positions").alias("_positions")), "_key", "left").drop("_key")
    joined = moved.unionByName(packed.filter(~hit).withColumn("_positions", F.lit(None).cast("array<int>")))
    rest = bound(F.split("_text", "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_positions")), lambda i: F.get(lines, i)), "\n"))
    text = F.when(F.col("_positions").isNull(), F.col("_text")).otherwise(rest)
    out = joined.withColumn("_new", text)
    columns = []
    for name in docs.columns:
        value = F.col("_row")[name]
        if name == "text":
            value = F.col("_new")
        elif name == "n_chars":
            value = F.when(F.col("_positions").isNull(), value).otherwise(F.char_length("_new").cast(docs.schema[name].dataType))
        columns.append(value.alias(name))
    return out.select(*columns, F.coalesce(F.size("_positions"), F.lit(0)).cast("long").alias(free_name(docs, "_n_dropped")))


def without_boilerplate(docs: DataFrame, min_texts: int = MIN_TEXTS) -> DataFrame:
    """The pipeline's form: documents that consisted of boilerplate alone go."""
    out = drop_lines(docs, min_texts)
    left = out.filter((own(out, out.columns[-1]) == 0) | (F.size(words(out["text"])) > 0))
    return left.select(*[own(left, c) for c in docs.columns])
