"""Suffix-array dedup: every byte that lies in a long string found twice goes.

1. Segments. Every window of `WIDTH` bytes is filed under the smallest hash of the short strings in it; consecutive
   windows with the same hash form a segment. Equal windows, wherever they are, have the same hash, so only segments whose hash
   occurs again can repeat; all other text never moves. Exact copies of a text are one text with a count.
2. The segments that are left go to shards by their hash. In a shard equal segments are one, the suffixes are sorted in
   two stages (`suffixes`), and neighbours with a common prefix of `WIDTH` bytes are repeated windows. Sorting holds
   some hundred bytes for each byte of a shard.
3. The segments of a hash with more than `SPLIT` of them are one for each content; equal ones are repeated whole. If more than
   `SPLIT` contents are left, their windows are filed anew under ever longer strings, and those that meet no others go. What is still
   too much when strings are nearly windows is dealt at random to several shards of its own; windows that none of them has
   found repeated, and one of each kind that was, then meet by a 128-bit digest of the window.
4. The windows found are merged into spans of their text, and the spans cut out of it.

Cases: null and empty texts, and texts shorter than a window, lose nothing; overlapping repeats inside one document count;
repeated rows are exact copies, whose every window is repeated; null ids pass through; texts of any length are
read whole; an empty table gives no row. Texts are told apart by their MD5 digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.arrays import mix, powers, text_bytes
from tallyhouse.llm.common import cut
from tallyhouse.llm.suffixes import repeated_windows

WIDTH = 400
GRAM = 32
#: bytes whose windows are filed together; longer texts take several turns
TURN = 1 << 20
#: most windows of one segment
MOST_WINDOWS = 4096
SPLIT = 2000
#: windows may be filed anew as long as they are so many bytes longer than the string they are filed under
LEAST_SLACK = 16
SHARD_BYTES = 2_000_000

_TABLE = mix(np.arange(1, 257, dtype=np.uint64))
_UP, _DOWN = powers(0x9E3779B97F4A7C15 | 5, TURN + 4096), powers(pow(0x9E3779B97F4A7C15 | 5, -1, 1 << 64), TURN + 4096)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each place."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _UP[: len(data)], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * _DOWN[: len(data) - gram + 1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` values in a row."""
    count = len(values) - width + 1
    size = -(-len(values) // width) * width
    padded = np.full(size, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, 1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def segments_of(data: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> list[tuple[int, int, int, bool]]:
    """(hash, first window, last window, whether the hash occurs again in the segment) of one text."""
    out = []
    span = width - gram + 1
    for at in range(0, len(data) - width + 1, TURN):
        hashed = gram_hashes(data[at : at + TURN + width - 1], gram)
        place = np.arange(len(hashed), dtype=np.uint64)
        short = hashed & np.uint64(~((1 << 24) - 1) & (2**64 - 1))
        left = (sliding_min(short | place, span) & np.uint64((1 << 24) - 1)).astype(np.int64)
        right = np.uint64((1 << 24) - 1) - (sliding_min(short | (np.uint64((1 << 24) - 1) - place), span) & np.uint64((1 << 24) - 1))
        anchor = hashed[left]
        heads = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        tails = np.append(heads[1:], len(anchor)) - 1
        again = left[heads] != right[tails].astype(np.int64)
        for name, first, last, twice in zip(anchor[heads].view(np.int64).tolist(), heads.tolist(), tails.tolist(), again.tolist(), strict=True):
            for lo in range(first, last + 1, MOST_WINDOWS):
                out.append((name, at + lo, at + min(last, lo + MOST_WINDOWS - 1), twice or last - first >= MOST_WINDOWS))
    return out


def _digest(text: bytes) -> tuple[int, int]:
    found = hashlib.md5(text).digest()
    return int.from_bytes(found[:8], "little", signed=True), int.from_bytes(found[8:], "little", signed=True)


def _texts(column: pa.Array) -> Iterator[memoryview]:
    data, offsets = text_bytes(column)
    whole = memoryview(np.ascontiguousarray(data))
    for k in range(len(column)):
        yield whole[offsets[k] : offsets[k + 1]]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(t), *_digest(t), hashlib.sha256(t).hexdigest()) for t in _texts(batch.column(1))]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())],
            names=["doc_id", "n_bytes", "d1", "d2", "sha"])


def _segments(width: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()
    for batch in batches:
        rows = []
        for text in _texts(batch.column(0)):
            if len(text) >= width and (digest := _digest(text)) not in seen:
                seen.add(digest)
                rows += [(name, *digest, lo, hi, twice) for name, lo, hi, twice in segments_of(np.frombuffer(text, np.uint8), width, gram)]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.bool_())], names=["name", "d1", "d2", "lo", "hi", "twice"])


def _distinct_texts(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different texts of one task that are long enough, with their digests."""
    seen = set()
    for batch in batches:
        kept, digests = [], []
        for k, text in enumerate(_texts(batch.column(0))):
            if len(text) >= width and (digest := _digest(text)) not in seen:
                seen.add(digest)
                kept.append(k)
                digests.append(digest)
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
             batch.column(0).take(pa.array(kept, pa.int64()))], names=["d1", "d2", "text"])


CUT = "shard long, hot boolean, d1 long, d2 long, lo long, windows long, bytes binary"


def _cut_segments(width: int, shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted segment of each text (d1, d2, text, wanted)."""
    names = [f.split()[0] for f in CUT.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        rows, held = [], 0
        for k, text in enumerate(_texts(batch.column(2))):
            d1, d2 = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            for wanted in batch.column(3)[k].as_py():
                lo, hi, parts = wanted["lo"], wanted["hi"], wanted["parts"]
                salt = 0 if parts == 1 else (d1 ^ lo * 0x9E3779B1) % parts
                spread = int(mix(np.array([wanted["name"] + salt], np.int64))[0])
                # a part of a split hash shares its shard with no other
                shard = spread % shards if parts == 1 else -1 - (spread >> 1)
                rows.append((shard, parts > 1, d1, d2, lo, hi - lo + 1, bytes(text[lo : hi + width])))
                held += len(rows[-1][-1])
            if held > 4_000_000:
                yield out(rows)
                rows, held = [], 0
        yield out(rows)


PIECES = "name long, twice boolean, d1 long, d2 long, lo long, windows long, digest binary, bytes binary"


def _pieces(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of (name, twice, d1, d2, lo, windows, bytes) with the digest of the bytes."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    types = [pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.binary(), pa.binary()]

    def out() -> pa.RecordBatch:
        columns = list(zip(*kept, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    kept, held = [], 0
    for row in rows:
        kept.append((*row[:-1], hashlib.md5(row[-1]).digest(), row[-1]))
        held += len(row[-1])
        if held > 4_000_000:
            yield out()
            kept, held = [], 0
    yield out()


def _hot_segments(width: int, gram: int, hot: frozenset[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of split hashes of each text."""
    def rows() -> Iterator[tuple]:
        seen = set()
        for batch in batches:
            for text in _texts(batch.column(0)):
                if len(text) >= width and (digest := _digest(text)) not in seen:
                    seen.add(digest)
                    for name, lo, hi, twice in segments_of(np.frombuffer(text, np.uint8), width, gram):
                        if name in hot:
                            yield name, twice, *digest, lo, hi - lo + 1, bytes(text[lo : hi + width])

    return _pieces(rows())


def _filed_anew(width: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of segments (d1, d2, lo, bytes), filed under strings of `gram` bytes."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for d1, d2, base, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for name, lo, hi, twice in segments_of(np.frombuffer(data, np.uint8), width, gram):
                    yield name, twice, d1, d2, base + lo, hi - lo + 1, data[lo : hi + width]

    return _pieces(rows())


def _split_hot(pieces: DataFrame, width: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Of the segments of split hashes: runs of repeated windows, and one segment of each content whose windows are to be
    sorted (name, parts, d1, d2, lo, windows, digest, bytes); equal windows have the same name."""
    runs, left = [], []
    while True:
        pieces = cut(pieces)
        contents = cut(pieces.groupBy("name", "digest").agg(
            F.min(F.struct("d1", "d2", "lo")).alias("a"), F.max(F.struct("d1", "d2", "lo")).alias("b"),
            F.max("twice").alias("twice"), F.first("windows").alias("windows"), F.first("bytes").alias("bytes")))
        equal = contents.filter("a <> b").select("name", "digest")
        runs.append(pieces.select("name", "digest", "d1", "d2", "lo", (F.col("lo") + F.col("windows") - 1).alias("hi")).join(
            equal, ["name", "digest"], "left_semi").select("d1", "d2", "lo", "hi"))
        names = contents.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice")).filter("n > 1 OR twice")
        names = cut(names.select("name", F.ceil(F.col("n") / SPLIT).cast("long").alias("parts")))
        met = contents.join(names, "name").select("name", "parts", "a.*", "windows", "digest", "bytes")
        slack = (width - gram) // 4
        if slack < LEAST_SLACK or not names.filter("parts > 1").limit(1).count():
            left.append(met)
            break
        left.append(met.filter("parts = 1"))
        gram = width - slack
        pieces = met.filter("parts > 1").select("d1", "d2", "lo", "bytes").mapInArrow(partial(_filed_anew, width, gram), PIECES)
    return reduce(DataFrame.union, runs), reduce(DataFrame.union, left)


def _sorted_shard(width: int, table: pa.Table) -> pa.Table:
    """Runs of repeated windows (d1, d2, lo, hi), and for split hashes the windows that must meet others."""
    copies: dict[bytes, dict[tuple[int, int, int], bool]] = {}
    for hot, d1, d2, lo, data in zip(*[table[c].to_pylist() for c in ("hot", "d1", "d2", "lo", "bytes")], strict=True):
        copies.setdefault(data, {})[d1, d2, lo] = hot
    texts, keys = list(copies), [list(found) for found in copies.values()]
    ranked, repeats, first, _ = repeated_windows(texts, [len(t) - width + 1 for t in texts], width)
    begins = np.cumsum([0, *[len(t) + 8 for t in texts]])[:-1]
    owner = np.searchsorted(begins, ranked, "right") - 1
    repeats |= np.array([len(found) > 1 for found in keys])[owner]
    found = np.sort(ranked[repeats])
    heads = np.flatnonzero(np.diff(found, prepend=-2) != 1)
    whose = np.searchsorted(begins, found[heads], "right") - 1
    los, his = found[heads] - begins[whose], found[np.append(heads[1:], len(found))[: len(heads)] - 1] - begins[whose]
    runs = [(d1, d2, base + lo, base + hi) for segment, lo, hi in zip(whose.tolist(), los.tolist(), his.tolist(), strict=True)
            for d1, d2, base in keys[segment]]
    # of a split hash one row for each different window, as columns
    picked = first & np.array([any(found.values()) for found in copies.values()])[owner]
    segments = owner[picked]
    at = ranked[picked] - begins[segments]
    digests = bytearray()
    for segment, place in zip(segments.tolist(), at.tolist(), strict=True):
        digests += hashlib.md5(texts[segment][place : place + width]).digest()
    one = np.array([found[0] for found in keys], np.int64)[segments]
    names = ["d1", "d2", "lo", "hi", "met", "digest"]
    columns = list(zip(*runs, strict=True)) or [[]] * 4
    certain = pa.table([*[pa.array(c, pa.int64()) for c in columns], pa.array([True] * len(runs), pa.bool_()),
                        pa.nulls(len(runs), pa.binary())], names=names)
    loose = pa.table([pa.array(one[:, 0]), pa.array(one[:, 1]), pa.array(one[:, 2] + at), pa.array(one[:, 2] + at), pa.array(repeats[picked]),
                      pa.Array.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(bytes(digests))]).cast(pa.binary())], names=names)
    return pa.concat_tables([certain, loose])


def _merged(windows: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Maximal byte spans covered by runs of windows."""
    spans: list[tuple[int, int]] = []
    for lo, hi in sorted(windows):
        if spans and lo <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], hi + width)
        else:
            spans.append((lo, hi + width))
    return spans


def _cleaned(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d1, d2, spans, kept digest) of texts (d1, d2, text, runs)."""
    names = ["d1", "d2", "spans", "kept"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        spans, kept = [], []
        for text, runs in zip(_texts(batch.column(2)), batch.column(3), strict=True):
            found = _merged([(r["lo"], r["hi"]) for r in runs.as_py()], width)
            digest, at = hashlib.sha256(), 0
            for start, stop in found:
                digest.update(text[at:start])
                at = stop
            digest.update(text[at:])
            spans.append([{"start": a, "stop": b} for a, b in found])
            kept.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(kept, pa.string())], names=names)


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, the byte spans to remove, and the SHA-256 of what stays."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    described = cut(plain.mapInArrow(_described, "doc_id long, n_bytes long, d1 long, d2 long, sha string"))
    text = plain.select("text").filter(F.octet_length("text") >= width)
    segments = cut(text.mapInArrow(lambda batches: _segments(width, gram, batches),
                                   "name long, d1 long, d2 long, lo long, hi long, twice boolean"))
    place = F.struct("d1", "d2", "lo")
    names = segments.groupBy("name").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"))
    names = cut(names.filter((F.col("a") != F.col("b")) | F.col("twice")).select("name", F.ceil(F.col("n") / SPLIT).cast("long").alias("parts")))
    # at most one of `SPLIT` segments: eight bytes for some megabyte of text
    hot = frozenset(r[0] for r in names.filter("parts > 1").select("name").collect())
    cold = segments.join(names.filter("parts = 1"), "name")
    wanted = cold.select("d1", "d2", F.struct("name", "lo", "hi", "parts").alias("segment")).groupBy("d1", "d2").agg(
        F.collect_set("segment").alias("wanted"))
    wanted = cut(wanted)
    size = wanted.agg(F.coalesce(F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda s, w: s + w["hi"] - w["lo"] + width)), F.lit(0))).first()[0]
    if hot:
        whole, left = _split_hot(text.mapInArrow(partial(_hot_segments, width, gram, hot), PIECES), width, gram)
        size += left.agg(F.coalesce(F.sum(F.col("windows") + width), F.lit(0))).first()[0]
    shards = max(1, -(-size // SHARD_BYTES))
    distinct = text.mapInArrow(lambda batches: _distinct_texts(width, batches), "d1 long, d2 long, text string")
    pieces = distinct.join(wanted, ["d1", "d2"]).select("d1", "d2", "text", "wanted").mapInArrow(
        lambda batches: _cut_segments(width, shards, batches), CUT)
    if hot:
        part = F.xxhash64("name", F.pmod(F.xxhash64("digest"), "parts"))
        # a part of a split hash shares its shard with no other
        shard = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("name"), F.lit(shards))).otherwise(-1 - F.shiftrightunsigned(part, 1))
        pieces = pieces.union(left.select(shard.alias("shard"), (F.col("parts") > 1).alias("hot"), "d1", "d2", "lo", "windows", "bytes"))
    found = cut(pieces.groupBy("shard").applyInArrow(
        lambda table: _sorted_shard(width, table), "d1 long, d2 long, lo long, hi long, met boolean, digest binary"))
    runs = found.filter("digest IS NULL").select("d1", "d2", "lo", "hi")
    loose = found.filter("digest IS NOT NULL")
    several = loose.groupBy("digest").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a <> b").select("digest")
    runs = runs.union(loose.filter("NOT met").join(several, "digest", "left_semi").select("d1", "d2", "lo", "hi"))
    if hot:
        runs = runs.union(whole)
    runs = runs.groupBy("d1", "d2").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    cleaned = distinct.join(runs, ["d1", "d2"]).select("d1", "d2", "text", "runs").mapInArrow(
        lambda batches: _cleaned(width, batches), "d1 long, d2 long, spans array<struct<start:long,stop:long>>, kept string")
    cleaned = cut(cleaned.dropDuplicates(["d1", "d2"]))
    copies = described.filter(F.col("n_bytes") >= width).groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    fate = copies.join(cleaned, ["d1", "d2"], "full")
    out = described.join(fate, ["d1", "d2"], "left")
    copied = F.col("n").isNotNull()
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    return out.select("doc_id", "n_bytes", F.when(copied, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
                      F.when(copied, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def digest_rows(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    found = repeated_spans(docs, width)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
