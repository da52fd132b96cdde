"""N-gram Jaccard join with filters under several global token orders.

A document is the set of its word shingles; two link if their Jaccard similarity is at least `PERCENT` / 100. The join is
exact for the 64-bit shingle hashes and never lists the pairs of a group of copies.

1. Documents with equal sets are one class (128-bit digest of the set).
2. A shingle that only one class has cannot be shared. Shingles are counted in parts of the hash space, as packed
   arrays; a class goes on only if enough of its shingles to reach the threshold are shared by some other class.
3. Classes whose first token under one of several hash orders agrees are compared with the first class of that group:
   one comparison per class and order. The links found give preliminary components, which hold most copies.
4. For the rest, prefixes are taken under several global orders, rarest shingle first with different tie orders: two
   similar sets share a token in the prefix of every order. Only pairs of different preliminary components are formed,
   and only those whose parity signs leave the threshold within reach: the signs of two sets differ in at most as many bits
   as the sets differ in tokens. A pair is formed at the first token its prefixes share and not again while they go on sharing
   tokens. The pairs of all orders are intersected, and what is left is verified on the whole sets.
5. Components of all verified links are the groups.

Cases: null, empty and wordless texts have no shingle and link with nothing; a text with fewer words than a shingle is
one shingle, its whole word sequence; repeated rows are exact copies and share a class; null ids come after all others
as group representatives; texts of any length are read whole; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.arrays import blocks, mix, shingle_hashes, word_hashes
from tallyhouse.llm.common import cut, own
from tallyhouse.llm.components import components

WIDTH = 5
PERCENT = 80
#: shingles counted together in one task
PART_TOKENS = 3_000_000
FIRST_ORDERS = 4
PREFIX_ORDERS = 2
#: longs of parity signs a set
SIGNS = 8
#: tokens before each one of a prefix that tell whether a pair has met already
EARLIER = 4
NO_ID = np.iinfo(np.int64).max


def needed(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least overlap that a set of `size` tokens has with any set it links with."""
    return -(-size * percent // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, owners = word_hashes(data, offsets)
    count = len(offsets) - 1
    shingles, whose = shingle_hashes(words, owners, width)
    order = np.lexsort((shingles, whose))
    shingles, whose = shingles[order], whose[order]
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (whose[1:] != whose[:-1])
    shingles, whose = shingles[fresh], whose[fresh]
    edges = np.searchsorted(whose, np.arange(count + 1))
    sets = [shingles[edges[k] : edges[k + 1]] for k in range(count)]
    sizes = np.bincount(owners, minlength=count)
    starts = np.searchsorted(owners, np.arange(count))
    for k in np.flatnonzero((sizes > 0) & (sizes < width)):
        value = mix(np.array([sizes[k]], np.uint64))
        for word in words[starts[k] : starts[k] + sizes[k]]:
            value = mix(value * np.uint64(0x9FB21C651E98DF25) + word)
        sets[k] = value
    return sets


def set_digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits that only depend on the set, as two signed longs."""
    with np.errstate(over="ignore"):
        a = mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(found))
        b = mix(found + np.uint64(0x3C79AC492BA7B653)).sum(dtype=np.uint64)
    return tuple(int(v) for v in mix(np.array([a, b], np.uint64)).view(np.int64))


def _sets_of(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, past, data, offsets in blocks(batch.column(column)):
        yield from zip(range(first, past), shingle_sets(data, offsets, width), strict=True)


def describe(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles and the digest (c1, c2) of each document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(found), *set_digest(found)) for _, found in _sets_of(batch, 1, width)]
            columns = zip(*rows, strict=True) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_shingles", "c1", "c2"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(first, past) of each run of equal values."""
    heads = np.flatnonzero(np.diff(values, prepend=-1))
    return list(zip(heads.tolist(), np.append(heads, len(values))[1:].tolist(), strict=True)) if len(values) else []


def _packed_tokens(parts: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part of the hash space and block of texts: class, number of tokens, and 40 bits of each token."""
    seen: set[tuple[int, int]] = set()
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def out() -> pa.RecordBatch:
        tokens = np.concatenate([found for _, found in held])
        owner = np.repeat(np.arange(len(held)), [len(found) for _, found in held])
        classes = np.array([c for c, _ in held], np.int64)
        part = (tokens % np.uint64(parts)).astype(np.int64)
        kept = (tokens // np.uint64(parts)) & np.uint64((1 << 40) - 1)
        order = np.argsort(part, kind="stable")
        part, kept, owner = part[order], kept[order], owner[order]
        rows = []
        for first, past in _runs(part):
            mine = owner[first:past]
            heads = np.flatnonzero(np.diff(mine, prepend=-1))
            counts = np.diff(np.append(heads, len(mine))).astype(np.uint32)
            values = kept[first:past]
            rows.append({"part": int(part[first]), "classes": classes[mine[heads]].tobytes(), "counts": counts.tobytes(),
                         "low": values.astype(np.uint32).tobytes(), "high": (values >> np.uint64(32)).astype(np.uint8).tobytes()})
        return pa.RecordBatch.from_pylist(rows, schema=PACKED)

    for batch in batches:
        for _, found in _sets_of(batch, 1, width):
            digest = set_digest(found)
            if not len(found) or digest in seen:
                continue
            seen.add(digest)
            held.append((digest[0], found))
            size += len(found)
            if size >= PART_TOKENS // 3:
                yield out()
                held, size = [], 0
    if held:
        yield out()


PACKED = pa.schema([("part", pa.int64()), ("classes", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def _shared_counts(buckets: int, table: pa.Table) -> pa.Table:
    """How many tokens of this part each class shares with another class, packed by bucket of classes."""
    classes = np.concatenate([np.frombuffer(b, np.int64) for b in table["classes"].to_pylist()])
    counts = np.concatenate([np.frombuffer(b, np.uint32) for b in table["counts"].to_pylist()])
    low = np.concatenate([np.frombuffer(b, np.uint32) for b in table["low"].to_pylist()])
    high = np.concatenate([np.frombuffer(b, np.uint8) for b in table["high"].to_pylist()])
    names, number = np.unique(classes, return_inverse=True)
    owner = np.repeat(number.astype(np.uint32), counts)
    tokens = (high.astype(np.uint64) << np.uint64(32)) | low
    order = np.argsort(tokens)
    tokens, owner = tokens[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    # a token is shared if a group of equal tokens has different owners
    shared = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
    mine = owner[np.repeat(shared, np.diff(np.append(heads, len(tokens))))]
    found = np.bincount(mine, minlength=len(names))
    at = np.flatnonzero(found)
    bucket = names[at].view(np.uint64) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    at, bucket = at[order], bucket[order].astype(np.int64)
    rows = [{"bucket": int(bucket[a]), "classes": names[at[a:b]].tobytes(), "counts": found[at[a:b]].astype(np.uint32).tobytes()}
            for a, b in _runs(bucket)]
    return pa.Table.from_pylist(rows, schema=pa.schema([("bucket", pa.int64()), ("classes", pa.binary()), ("counts", pa.binary())]))


def _summed(table: pa.Table) -> pa.Table:
    classes = np.concatenate([np.frombuffer(b, np.int64) for b in table["classes"].to_pylist()])
    counts = np.concatenate([np.frombuffer(b, np.uint32) for b in table["counts"].to_pylist()])
    names, number = np.unique(classes, return_inverse=True)
    return pa.table({"c1": names, "n_shared": np.bincount(number, counts).astype(np.int64)})


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id, F.lit(int(NO_ID)))


def _survivors(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """c1 and the representative's key of the classes that share enough tokens with others to link."""
    total = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_TOKENS))
    packed = docs.mapInArrow(lambda batches: _packed_tokens(parts, width, batches),
                             "part long, classes binary, counts binary, low binary, high binary")
    shared = packed.groupBy("part").applyInArrow(
        lambda table: _shared_counts(parts, table), "bucket long, classes binary, counts binary")
    summed = shared.groupBy("bucket").applyInArrow(_summed, "c1 long, n_shared long")
    return cut(classes.join(summed, "c1").filter(F.col("n_shared") * 100 >= F.col("n_shingles") * percent)
               .select("c1", "c2", "n_shingles", "rep"))


#: per surviving class: its first tokens under the hash orders, then the text
def _first_tokens(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["c1", "c2", "text", "firsts"]
    for batch in batches:
        rows, kept = [], []
        for row, found in _sets_of(batch, 2, width):
            if set_digest(found) == (batch.column(0)[row].as_py(), batch.column(1)[row].as_py()):
                kept.append(row)
                rows.append([int(mix(found + np.uint64(1000 + k)).min().view(np.int64)) for k in range(FIRST_ORDERS)])
        part = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(rows, pa.list_(pa.int64()))], names=names)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class numbers whose sets are similar enough."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for (row, x), (_, y) in zip(_sets_of(batch, 2, width), _sets_of(batch, 3, width), strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    kept.append(row)
            yield pa.RecordBatch.from_arrays(batch.take(pa.array(kept, pa.int64())).columns[:2], names=["a", "b"])

    return cut(both.mapInArrow(run, "a long, b long"))


TOKENS = pa.schema([("part", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("tokens", pa.binary())])


def _dealt_tokens(parts: int, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row, found in _sets_of(batch, 1, width):
            node, part = batch.column(0)[row].as_py(), (found % np.uint64(parts)).astype(np.int64)
            for p in np.unique(part):
                rows.append({"part": int(p), "node": node, "size": len(found), "tokens": found[part == p].tobytes()})
            if len(rows) > 2000:
                yield pa.RecordBatch.from_pylist(rows, schema=TOKENS)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=TOKENS)


def _with_counts(table: pa.Table) -> pa.Table:
    """Each node's shared tokens of this part with the number of nodes that have them."""
    blobs = [np.frombuffer(b, np.uint64) for b in table["tokens"].to_pylist()]
    tokens = np.concatenate(blobs)
    _, number, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    counts = counts[number].astype(np.uint32)
    kept_tokens, kept_counts, at = [], [], 0
    for blob in blobs:
        mine = counts[at : at + len(blob)]
        kept_tokens.append(blob[mine > 1].tobytes())
        kept_counts.append(mine[mine > 1].tobytes())
        at += len(blob)
    return pa.table({"node": table["node"], "size": table["size"], "tokens": pa.array(kept_tokens, pa.binary()),
                     "counts": pa.array(kept_counts, pa.binary())})


def parity_signs(found: np.ndarray) -> np.ndarray:
    """One bit per slot of the hash space: whether an odd number of the tokens fall there."""
    slots = (mix(found ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * SIGNS)).astype(np.int64)
    return np.packbits(np.bincount(slots, minlength=64 * SIGNS).astype(np.uint8) & 1).view(np.int64)


def _prefixes(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node with tokens that others have too: how many are its own alone, the signs of the others, its prefix under each order."""
    for batch in batches:
        rows = []
        for node, size, blobs, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            found = np.concatenate([np.frombuffer(b, np.uint64) for b in blobs])
            often = np.concatenate([np.frombuffer(b, np.uint32) for b in counts])
            # tokens of this node alone come first in every order and cannot match
            alone = size - len(found)
            room = size - int(needed(np.int64(size), percent)) + 1 - alone
            if room <= 0:
                continue
            firsts = [found[np.lexsort((mix(found + np.uint64(7 + k)), often))[:room]].view(np.int64) for k in range(PREFIX_ORDERS)]
            rows.append((node, size, alone, *parity_signs(found).tolist(), firsts))
        columns = list(zip(*rows, strict=True)) or [[]] * (4 + SIGNS)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in columns[:-1]], pa.array(columns[-1], pa.list_(pa.list_(pa.int64())))],
            names=["node", "size", "alone", *SIGN_NAMES, "firsts"])


SIGN_NAMES = [f"sign{k}" for k in range(SIGNS)]
NODES = f"node long, size long, alone long, {', '.join(f'{name} long' for name in SIGN_NAMES)}, firsts array<array<long>>"


def _meetings(nodes: DataFrame, percent: int) -> DataFrame:
    """(ord, a, b) where nodes of different preliminary components that may be similar enough share a token of their prefixes.

    Both prefixes are in the same order, so the first shared token has none before it and a pair that may link is never missed;
    later tokens form it again only if none of the last `EARLIER` is shared.
    """
    kept = ["node", "size", "alone", "root", *SIGN_NAMES]
    postings = nodes.select(*kept, F.posexplode("firsts").alias("ord", "tokens")).select(
        *kept, "ord", "tokens", F.posexplode("tokens").alias("at", "token"))
    before = F.slice("tokens", F.greatest(F.col("at") - EARLIER, F.lit(0)) + 1, F.least(F.col("at"), F.lit(EARLIER)))
    postings = postings.select(*kept, "ord", "token", before.alias("before"))
    # a token seen in one preliminary component only forms no pair
    mixed = postings.groupBy("ord", "token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    used = postings.join(mixed.select("ord", "token"), ["ord", "token"], "left_semi")
    a, b = (used.select("ord", "token", *[F.col(c).alias(f"{side}_{c}") for c in [*kept, "before"]]) for side in "ab")
    sizes = F.col("a_size") + F.col("b_size")
    apart = F.col("a_alone") + F.col("b_alone")
    for name in SIGN_NAMES:
        apart += F.bit_count(F.col(f"a_{name}").bitwiseXOR(F.col(f"b_{name}")))
    pairs = a.join(b, ["ord", "token"]).filter(
        (F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root"))
        & (100 * F.col("a_size") >= percent * F.col("b_size")) & (100 * F.col("b_size") >= percent * F.col("a_size"))
        & ((100 + percent) * apart <= (100 - percent) * sizes) & ~F.arrays_overlap("a_before", "b_before"))
    return pairs.select("ord", F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def _cross_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different preliminary components that meet in the prefixes of every order and may be similar enough."""
    met = _meetings(nodes, percent).groupBy("a", "b").agg(F.expr("bit_or(shiftleft(1, cast(ord AS int)))").alias("orders"))
    return met.filter(F.col("orders") == (1 << PREFIX_ORDERS) - 1).select("a", "b")


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    described = cut(describe(plain, width))
    classes = described.filter("n_shingles > 0").groupBy("c1", "c2").agg(
        F.min(_key(F.col("doc_id"))).alias("rep"), F.first("n_shingles").alias("n_shingles"))
    survivors = _survivors(plain.select("doc_id", "text"), classes, width, percent)
    with_key = plain.select(_key(F.col("doc_id")).alias("rep"), "text")
    texts = with_key.join(survivors, "rep").select("c1", "c2", "text").mapInArrow(
        lambda batches: _first_tokens(width, batches), "c1 long, c2 long, text string, firsts array<long>")
    texts = cut(texts.dropDuplicates(["c1", "c2"]).withColumn("node", F.col("c1")))
    firsts = texts.select("node", F.posexplode("firsts").alias("ord", "token"))
    heads = firsts.groupBy("ord", "token").agg(F.min("node").alias("a"))
    stars = firsts.join(heads, ["ord", "token"]).filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    near = _verified(stars, texts.select("node", "text"), width, percent)
    roots = components(near)
    total = survivors.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_TOKENS))
    counted = texts.select("node", "text").mapInArrow(
        lambda batches: _dealt_tokens(parts, width, batches), "part long, node long, size long, tokens binary"
    ).groupBy("part").applyInArrow(_with_counts, "node long, size long, tokens binary, counts binary")
    nodes = counted.groupBy("node", "size").agg(F.collect_list(F.struct("tokens", "counts")).alias("x")).select(
        "node", "size", F.col("x.tokens").alias("tokens"), F.col("x.counts").alias("counts")).mapInArrow(
        lambda batches: _prefixes(percent, batches), NODES)
    nodes = cut(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    far = _verified(_cross_pairs(nodes, percent), texts.select("node", "text"), width, percent)
    linked = components(near.union(far)).withColumnRenamed("node", "c1")
    labelled = classes.join(linked, "c1", "left").withColumn("root", F.coalesce("root", "c1"))
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("least"))
    named = labelled.join(smallest, "root").select("c1", "c2", F.nullif(F.col("least"), F.lit(int(NO_ID))).alias("component_id"))
    some = described.filter("n_shingles > 0").join(named, ["c1", "c2"], "left").select("doc_id", "n_shingles", "component_id")
    none = described.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group: the one with the smallest id; of equal texts under that id, one row.

    Rows with a null id stay only in groups without any other id, one per text.
    """
    found = groups(docs, width, percent).select(F.col("doc_id").alias("_id"), "component_id").filter(
        F.col("component_id").eqNullSafe(F.col("_id"))).select(F.col("_id").cast("long")).distinct()
    packed = docs.select(docs["doc_id"].cast("long").alias("_id"), F.struct(*[own(docs, c) for c in docs.columns]).alias("_row"))
    kept = packed.join(found, packed["_id"].eqNullSafe(found["_id"]), "left_semi")
    return kept.withColumn("_text", F.md5("_row.text")).dropDuplicates(["_id", "_text"]).select("_row.*")
