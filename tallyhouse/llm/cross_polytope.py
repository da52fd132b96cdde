"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets.

Vectors are only compared under one label. Equal vectors (same label and components) are one class with a weight. Each
vector is rotated by sign flips and Hadamard transforms, `TABLES` times independently; the hash of a rotation is the
index and sign of the largest coordinate in each half of the rotated vector. A vector is stored in its own bucket and looked up in the
`PROBES` next likely ones (the runner-up coordinates), so a pair meets if either lies in a probed bucket of the other.
Two halves are hashed for up to `FILL` vectors of a label a bucket; for more, halves of a second rotation are added (`parts_for`).

What meets is told by sketches: `CODES` coordinates of another rotation in steps of 3 bits, which also name a vector. A task gets the sketches of whole
buckets in packed bytes; sketches whose distance is within four deviations of that at the threshold are connected, so no pair is written. The
vectors of a connected group then come together once, and all its pairs are verified by their cosine in double precision, a block
of `BLOCK` classes against another: the links are those of the whole group, whether or not two of its vectors shared a bucket.
Vectors that met nothing are left out before they are sent, by a map of `MAP_BITS` bits at most.

Memory: a task holds the packed entries of its buckets, or two blocks and `ROWS` of their products. A group of g classes costs g squared
cosines, and its vectors are sent g / `BLOCK` times.

Cases: null vectors, zero vectors and vectors with null or non-finite components, or with a null label, link with nothing;
vectors of different lengths never link; null ids come after all others as representatives; repeated rows are
equal vectors; ties go to the smallest id; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.arrays import mix
from tallyhouse.llm.common import cut
from tallyhouse.llm.components import components

THRESHOLD = 0.93
TABLES = 12
PROBES = 3
SEED = 17
#: coordinates in a sketch, and a step of a code in mean deviations of a coordinate
CODES = 32
STEP = 0.65
#: vectors of a label a bucket (of all that the parts can tell apart) from which one more part is hashed
FILL = 8
MOST_PARTS = 4
#: entries that a task of buckets gets, and pairs of sketches compared at a time
PART_ENTRIES = 1 << 18
PAIRS = 1 << 18
#: pairs in one bucket from which sketches meet by leaders, and the squared distance of a sketch from the leader that stands for it
CROWD = 1 << 22
NEAR = 8
#: classes of a group that are verified together, and rows of a block multiplied at a time
BLOCK = 8192
ROWS = 512
#: classes of small groups that one task verifies
BUNDLE = 2048
#: bits of the map of connected names
MAP_BITS = 1 << 26
#: vectors that are rotated at a time
CACHED = 256
#: rounding of a product against the plain sum
ROUNDING = 1e-12

#: 24 bits of a bucket, the last of them for probes, and a sketch
ENTRY = np.dtype([("bucket", "<u2"), ("more", "u1"), ("low", "<u8"), ("high", "<u4")])


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    # coordinates first, so that each addition runs along all rows
    x, step = np.ascontiguousarray(x.T), 1
    while step < width:
        pairs, x = x.reshape(-1, 2, step, rows), np.empty((width, rows))
        out = x.reshape(pairs.shape)
        np.add(pairs[:, 0], pairs[:, 1], out=out[:, 0])
        np.subtract(pairs[:, 0], pairs[:, 1], out=out[:, 1])
        step *= 2
    return (x / np.sqrt(width)).T


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Three rounds of random signs and a Hadamard transform, after padding to a power of two."""
    width = max(2, 1 << (x.shape[1] - 1).bit_length())
    x = np.hstack([x, np.zeros((len(x), width - x.shape[1]))])
    rng = np.random.Generator(np.random.PCG64([SEED, table]))
    signs = [rng.choice([-1.0, 1.0], width) for _ in range(3)]
    for at in range(0, len(x), CACHED):
        part = x[at : at + CACHED]
        for sign in signs:
            part = hadamard(part * sign)
        x[at : at + CACHED] = part
    return x


def parts_for(rows: int, width: int) -> int:
    """Halves to hash for labels of up to `rows` vectors: 2, and more where buckets would hold over `FILL`."""
    vertices, parts = max(2, 1 << (width - 1).bit_length()), 2
    while parts < MOST_PARTS and rows > FILL * vertices**parts:
        parts += 1
    return parts


def hashes(x: np.ndarray, table: int, parts: int = 2) -> np.ndarray:
    """(rows, 1 + PROBES) bucket numbers of unit vectors, the own bucket first.

    Each half of the rotated vector gives one cross-polytope vertex; a probe replaces one of them by its runner-up,
    the one that is closest behind first.
    """
    halves = []
    for turn in range((parts + 1) // 2):
        turned = rotated(x, table + turn * TABLES)
        half = turned.shape[1] // 2
        halves += [turned[:, :half], turned[:, half:]]
    wide, rows = 2 * half, np.arange(len(x))
    best, next_, loss = [], [], []
    for part in halves[:parts]:
        vertices = np.hstack([part, -part])
        order, value = [], []
        for _ in range(min(3, wide)):
            order.append(vertices.argmax(1))
            value.append(vertices[rows, order[-1]])
            vertices[rows, order[-1]] = -np.inf
        best.append(order[0])
        next_.append(np.stack(order[1:], 1))
        loss.append(np.stack([value[0] - v for v in value[1:]], 1))
    own = np.zeros(len(x), np.int64)
    for vertex in best:
        own = own * wide + vertex
    others = np.hstack([own[:, None] + (n - b[:, None]) * wide ** (parts - 1 - k) for k, (b, n) in enumerate(zip(best, next_, strict=True))])
    order = np.argsort(np.hstack(loss), axis=1, kind="stable")[:, :PROBES]
    return np.hstack([own[:, None], np.take_along_axis(others, order, 1)])


def sketches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the first `CODES` coordinates of a further rotation, bit by bit in numbers of 64 and 32 bits."""
    turned = rotated(np.hstack([x, np.zeros((len(x), max(0, 64 - x.shape[1])))]), MOST_PARTS * TABLES)
    codes = np.clip(np.floor(turned[:, :CODES] * (np.sqrt(turned.shape[1]) / STEP)) + 4, 0, 7).astype(np.uint8)
    packed = np.packbits(np.hstack([codes >> bit & 1 for bit in range(3)]), axis=1)
    return packed[:, :8].copy().view("<u8").ravel(), packed[:, 8:].copy().view("<u4").ravel()


def unpacked(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(rows, `CODES`) codes of sketches."""
    packed = np.hstack([low[:, None].view(np.uint8), high[:, None].view(np.uint8)])
    bits = np.unpackbits(packed, axis=1).reshape(len(low), 3, CODES)
    return (bits[:, 0] | bits[:, 1] << 1 | bits[:, 2] << 2).view(np.int8)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of codes, eight squares of a byte summed at a time."""
    apart = a - b
    square = np.ascontiguousarray(apart * apart).view(np.uint64)
    square = ((square & np.uint64(0x00FF00FF00FF00FF)) + (square >> np.uint64(8) & np.uint64(0x00FF00FF00FF00FF))).sum(1)
    return square * np.uint64(0x0001000100010001) >> np.uint64(48)


def reach(threshold: float) -> int:
    """Squared distance of the sketches of two vectors at the threshold, but for four deviations (a sum of `CODES` squares)."""
    mean, spread = CODES * ((2 - 2 * threshold) / STEP**2 + 1 / 6), 2 / (9 * CODES)
    return int(mean * (1 - spread + 4 * np.sqrt(spread)) ** 3)


def _unit(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) by vector length."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat, starts = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        x = flat[starts[rows][:, None] + np.arange(int(length))].astype(np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _names(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers of sketches."""
    return mix(low + mix(high) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def _places(batch: pa.RecordBatch, rows: np.ndarray, width: int) -> np.ndarray:
    return mix(batch.column("place").to_numpy()[rows].view(np.uint64) + np.uint64(width))


def _packed(part: np.ndarray, out: np.ndarray) -> pa.RecordBatch:
    """(part, entries) with the bytes of the rows of `out` by their part."""
    order = np.argsort(part, kind="stable")
    part, out = part[order], out[order]
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    ends = (np.r_[starts, len(part)] * (out.nbytes // len(out))).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.BinaryArray.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])], names=["part", "entries"])


def _entries(most: int, groups: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, entries): the sketch of each vector in its own bucket and in the probed ones, packed by the task that gets the bucket.

    Parts below 0 get names and keys.
    """
    for batch in batches:
        first = np.unique(batch.column("key").to_numpy(), return_index=True)[1]
        batch = batch.take(pa.array(first))
        for rows, x in _unit(batch.column("embedding")):
            place = _places(batch, rows, x.shape[1])
            low, high = sketches(x)
            parts = parts_for(most, x.shape[1])
            shared = np.stack([_names(low, high), batch.column("key").to_numpy()[rows]], 1)
            yield _packed(-1 - (shared[:, 0] & 0x7FFFFFFF) % groups, shared)
            for table in range(TABLES):
                found = hashes(x, table, parts).astype(np.uint64)
                count = found.shape[1]
                bucket = mix(mix(found + mix(np.array([table]))) + place[:, None])
                out = np.empty(found.size, ENTRY)
                placed = ((bucket & np.uint64(0xFFFFFE)) | (np.arange(count) > 0).astype(np.uint64)).ravel()
                out["bucket"], out["more"] = placed & np.uint64(0xFFFF), placed >> np.uint64(16)
                out["low"], out["high"] = np.repeat(low, count), np.repeat(high, count)
                yield _packed(((bucket >> np.uint64(32)) % np.uint64(groups)).astype(np.int64).ravel(), out)


def _least(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """The smallest node of the component of each of `count` nodes under the links (a, b)."""
    label = np.arange(count)
    while len(a):
        at, to = label[a], label[b]
        apart = at != to
        a, b, at, to = a[apart], b[apart], at[apart], to[apart]
        np.minimum.at(label, np.maximum(at, to), np.minimum(at, to))
        while (label[label] != label).any():
            label = label[label]
    return label


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes as (a, b), one for each node but the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _least(at[: len(a)], at[len(a) :], len(nodes))
    loose = root != np.arange(len(nodes))
    return nodes[loose], nodes[root[loose]]


def _near_sketches(limit: int, bucket: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) rows that meet within `limit`, of entries in the order of `bucket`: all such pairs, or in a crowded bucket what connects them."""
    own = bucket & np.uint32(1) == 0
    edges = np.flatnonzero(np.r_[True, bucket[1:] >> np.uint32(1) != bucket[:-1] >> np.uint32(1), True])
    size = np.diff(edges)
    stored = np.add.reduceat(own.astype(np.int64), edges[:-1])
    crowded = stored * size > CROWD
    for k in np.flatnonzero(crowded):
        # each stored sketch is near a leader; what is within reach of it is at most as far again from the leader
        here = slice(int(edges[k]), int(edges[k + 1]))
        open_ = own[here].copy()
        while open_.any():
            leader = here.start + int(open_.argmax())
            far = distances(codes[here], codes[leader])
            hit = here.start + np.flatnonzero(far <= (limit**0.5 + NEAR**0.5) ** 2)
            open_ &= far > NEAR
            yield np.full(len(hit), leader), hit
    # own entries come first in a bucket: each meets all behind it
    rows = np.flatnonzero(own & np.repeat(~crowded, size))
    behind = np.repeat(edges[1:], size)[rows] - rows - 1
    total = np.cumsum(behind)
    at = 0
    while at < len(rows):
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        a = np.repeat(rows[at:to], behind[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(total[at:to] - behind[at:to] - before, behind[at:to])
        hit = distances(codes[a], codes[b]) <= limit
        yield a[hit], b[hit]
        at = to


def _connected(limit: int, table: pa.Table) -> pa.Table:
    """(a, b) names of vectors that connect what meets in the buckets of a task; a name of different vectors meets a node of its own."""
    if table["part"][0].as_py() < 0:
        pairs = np.unique(np.frombuffer(b"".join(table["entries"].to_pylist()), np.int64).reshape(-1, 2), axis=0)[:, 0]
        shared = np.unique(pairs[1:][pairs[1:] == pairs[:-1]])
        return pa.table({"a": shared, "b": ~shared})
    entries = np.frombuffer(b"".join(table["entries"].to_pylist()), ENTRY)
    # equal entries side by side: the same vector in other rows
    bucket = entries["bucket"] | entries["more"].astype(np.uint32) << np.uint32(16)
    order = np.argsort(bucket.astype(np.uint64) << np.uint64(40) | entries["low"] >> np.uint64(24))
    bucket, low, high = bucket[order], entries["low"][order], entries["high"][order]
    other = np.r_[True, (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
    bucket, low, high = bucket[other], low[other], high[other]
    found = []
    for a, b in _near_sketches(limit, bucket, unpacked(low, high)):
        found.append(_spanning(_names(low[a], high[a]), _names(low[b], high[b])))
    a, b = _spanning(*(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1)))
    return pa.table({"a": a, "b": b})


def _classes(seen: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors with their names, equal ones of a batch once, of those whose bit is set in `seen`."""
    for batch in batches:
        _, first, at = np.unique(batch.column("key").to_numpy(), return_index=True, return_inverse=True)
        batch = batch.take(pa.array(first))
        names, weight = np.zeros(len(first), np.int64), np.bincount(at)
        for rows, x in _unit(batch.column("embedding")):
            names[rows] = _names(*sketches(x))
        bit = names & (8 * len(seen) - 1)
        found = pa.RecordBatch.from_arrays([
            pa.array(names), pa.array(weight), *(batch.column(c) for c in ("key", "label", "embedding"))],
            names=["name", "weight", "key", "label", "embedding"])
        yield found.filter(pa.array(seen[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1))


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of x, row of y) whose cosine reaches the threshold."""
    for at in range(0, len(x), ROWS):
        cosine = x[at : at + ROWS] @ y.T
        hit = cosine >= threshold
        a, b = np.nonzero(np.abs(cosine - threshold) < ROUNDING)
        hit[a, b] = np.einsum("ij,ij->i", x[at + a], y[b]) >= threshold
        a, b = np.nonzero(hit)
        yield at + a, b


def _verified(threshold: float, table: pa.Table) -> pa.Table:
    """(a, b, far): (class, itself, weight of what it links with here), and (class, class, 0) that connect the linked ones."""
    table = table.combine_chunks()
    key, weight, own = (table[c].to_numpy() for c in ("key", "weight", "own"))
    group = np.stack([table[c].to_numpy() for c in ("root", "first", "last")] + [table["label"].combine_chunks().dictionary_encode().indices.to_numpy()])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rows, x in _unit(table["embedding"].combine_chunks()):
        here = group[:, rows]
        order = np.lexsort([key[rows], *here])
        rows, x, here = rows[order], x[order], here[:, order]
        edges = np.flatnonzero(np.r_[True, (here[:, 1:] != here[:, :-1]).any(0), True])
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            part = rows[low:high]
            node, first = np.unique(key[part], return_index=True)
            if len(node) < 2:
                continue
            heavy = np.add.reduceat(weight[part], first)
            y, side = x[low:high][first], own[part][first]
            both = here[1, low] == here[2, low]
            left = np.arange(len(node)) if both else np.flatnonzero(side == here[1, low])
            right = left if both else np.flatnonzero(side != here[1, low])
            far, kept = np.zeros(len(node), np.int64), [(np.zeros(0, np.int64),) * 2]
            for a, b in _linked(y[left], y[right], threshold):
                a, b = left[a], right[b]
                a, b = a[a != b], b[a != b]
                np.add.at(far, a, heavy[b])
                if not both:
                    np.add.at(far, b, heavy[a])
                kept.append(_spanning(a, b))
            a, b = _spanning(*(np.concatenate([k[i] for k in kept]) for i in (0, 1)))
            met = far > 0
            out += [(node[met], node[met], far[met]), (node[a], node[b], np.zeros(len(a), np.int64))]
    return pa.table({name: np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k, name in enumerate(("a", "b", "far"))})


def _may_link(rows: DataFrame) -> tuple[DataFrame, Column]:
    """vec_id, label and embedding (as doubles, or floats as they are), and whether a vector may link."""
    kind = rows.schema["embedding"].dataType.simpleString()
    own = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["label"], rows["embedding"].cast(
        "array<float>" if kind == "array<float>" else "array<double>").alias("embedding"))
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return own, F.col("label").isNotNull() & F.coalesce(good, F.lit(False))


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the vectors that may link."""
    own, good = _may_link(rows)
    return own.filter(good)


def connected(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(name, root) of the vectors (key, place, embedding) that meet another one in a bucket with a sketch in reach."""
    sizes = vectors.groupBy("place").count().agg(F.max("count"), F.sum("count")).first()
    most, total = sizes[0] or 0, sizes[1] or 0
    groups = max(32, total * TABLES * (1 + PROBES) // PART_ENTRIES)
    packed = vectors.select("key", "place", "embedding").mapInArrow(lambda batches: _entries(most, groups, batches), "part long, entries binary")
    limit = reach(threshold)
    met = cut(packed.groupBy("part").applyInArrow(lambda table: _connected(limit, table), "a long, b long"))
    return components(met).withColumnRenamed("node", "name")


def _map(names: DataFrame) -> np.ndarray:
    """A bit map of the last bits of the names, 16 bits a name or `MAP_BITS` in all."""
    bits = 1 << 15
    while bits < min(MAP_BITS, 16 * names.count()):
        bits *= 2
    # Spark counts the bits of its maps of 4 KB from 1
    at = F.pmod("name", F.lit(bits)) + 1
    seen = np.zeros(bits // 8, np.uint8)
    for number, found in names.groupBy(F.bitmap_bucket_number(at)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at))).collect():
        seen[(number - 1) * 4096 : number * 4096] = np.frombuffer(found, np.uint8)
    return seen


def links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, far) of the vectors (key, place, label, embedding), see `_verified`."""
    types = {name: vectors.schema[name].dataType.simpleString() for name in ("label", "embedding")}
    groups = connected(vectors, threshold)
    seen = _map(groups)
    named = vectors.select("key", "place", "label", "embedding").mapInArrow(
        lambda batches: _classes(seen, batches), f"name long, weight long, key long, label {types['label']}, embedding {types['embedding']}")
    members = cut(named.join(groups, "name").drop("name"))
    sizes = members.select("root", "key").distinct().groupBy("root").count()
    blocks = sizes.filter(F.col("count") > BLOCK).select("root", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    bundles = max(32, members.count() // BUNDLE)
    placed = members.join(blocks, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("key"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("first", F.least("own", "other")).withColumn("last", F.greatest("own", "other")).withColumn(
        "part", F.when(F.col("blocks") > 1, F.xxhash64("root", "first", "last")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bundles))))
    return cut(placed.select("part", "root", "first", "last", "own", "key", "weight", "label", "embedding").groupBy("part").applyInArrow(
        lambda table: _verified(threshold, table), "a long, b long, far long"))


def near_copies(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    most = F.lit(int(np.iinfo(np.int64).max))
    keyed = usable(rows).withColumn("key", F.xxhash64("label", F.col("embedding").cast("array<double>"))).withColumn("place", F.xxhash64("label"))
    found = links(keyed.drop("vec_id"), threshold)
    degree = found.filter("far > 0").groupBy("a").agg(F.sum("far").alias("far")).withColumnRenamed("a", "key")
    classes = keyed.groupBy("key").agg(F.min(F.coalesce("vec_id", most)).alias("rep"), F.count(F.lit(1)).alias("weight"))
    roots = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "key")
    least = roots.join(classes.select("key", "rep"), "key").groupBy("root").agg(F.min("rep").alias("least"))
    named = classes.join(degree, "key", "left").join(roots.join(least, "root").drop("root"), "key", "left").select(
        "key", (F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.nullif(F.coalesce("least", "rep"), most).alias("component_id"))
    linked = keyed.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    plain, good = _may_link(rows)
    alone = plain.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
