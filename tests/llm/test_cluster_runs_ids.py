"""Centroid clustering, periodic runs and token files against brute force and exact round trips."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm import centroids, huffman, packing, periodic_runs, token_files
from tallyhouse.llm.common import checkpoint_folder
from tests.llm.test_native import DOCS, docs

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])


# --- centroid clustering


@pytest.mark.parametrize("spread", [3, 100_000])
@pytest.mark.parametrize("dimensions", [1, 2, 9])
def test_threshold_walk_equals_all_distances(spread, dimensions):
    rng = np.random.default_rng(spread + dimensions)
    middles = rng.integers(-spread, spread + 1, (17, dimensions))
    vectors = np.vstack([rng.integers(-2 * spread, 2 * spread + 1, (400, dimensions)), middles])
    distances = ((vectors[:, None] - middles[None]) ** 2).sum(2)
    cluster, best = centroids.SortedLists(middles).nearest(vectors)
    assert (best == distances.min(1)).all()
    assert (cluster == distances.argmin(1)).all()  # argmin takes the smaller number of equals


def test_threshold_walk_at_the_edge_of_the_range():
    edge = centroids.REACH - 1
    middles = np.array([[edge] * 64, [-edge] * 64])
    cluster, best = centroids.SortedLists(middles).nearest(np.array([[-edge] * 64, [edge] * 64, [0] * 64]))
    assert cluster.tolist() == [1, 0, 0]
    assert best.tolist() == [0, 0, 64 * edge * edge]


def brute_clusters(rows):
    kept = [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) and abs(x) < 2**18 for x in v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    middles = [list(v) for _, v in hashed[:40]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(middles))

    for _ in range(5):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for k, members in groups.items():
            middles[k] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    total = sum(d for _, _, d in placed)
    return sorted(
        ((i, k, d, sum(e for _, j, e in placed if j == k), total, hashlib.sha256(",".join(map(str, middles[k])).encode()).hexdigest())
         for i, k, d in placed), key=repr)


def vector_rows():
    rng = random.Random(8)
    base = [[rng.choice([-1.0, -0.25, 0.0, 0.3, 1.5]) for _ in range(64)] for _ in range(60)]
    rows = [(k, [x + rng.choice([0, 0.01]) for x in rng.choice(base)], k % 3) for k in range(150)]
    rows += [(k, base[0], None) for k in range(200, 240)]  # a group of equal vectors
    rows += [(300, base[1], 0)] * 3 + [(301, base[2], 0), (301, base[3], 0), (None, base[4], 0), (None, base[4], 1)]
    odd = [None, [], [0.0] * 63, [0.0] * 65, [None, *[0.0] * 63], [float("nan"), *[0.0] * 63], [float("inf"), *[0.0] * 63], [3e38, *[0.0] * 63]]
    return rows + [(400 + k, v, 0) for k, v in enumerate(odd)] + [(500, [-0.0] * 64, 0)]


def test_clustering_equals_brute_force(spark):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, VECTORS).repartition(5)
    frame = frame.withColumn("cluster", F.lit("x")).withColumn("parts", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("distance", F.lit(None))
    got = sorted((tuple(r) for r in centroids.clustering(frame).collect()), key=repr)
    assert got == brute_clusters(rows)


def test_clustering_of_few_and_no_vectors(spark):
    one = spark.createDataFrame([(7, [0.5] * 64, None)] * 3 + [(8, None, None)], VECTORS)
    assert [tuple(r)[:5] for r in centroids.clustering(one).collect()] == [(7, 0, 0, 0, 0)] * 3
    assert centroids.clustering(spark.createDataFrame([(8, None, None)], VECTORS)).collect() == []
    assert centroids.clustering(spark.createDataFrame([], VECTORS)).collect() == []


# --- periodic runs


def brute_runs(words, least_words=6, least_periods=4):
    n, found = len(words), []
    for q in range(1, n // least_periods + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if length >= max(least_words, least_periods * q) and not any(
                    all(words[start + k] == words[start + k + d] for k in range(length - d)) for d in range(1, q)):
                found.append((start, length, q))
            start = end + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(300):
        symbols = rng.choices(range(letters), k=rng.randint(0, 60))
        if rng.random() < 0.7:
            part = rng.choices(range(letters + 1), k=rng.randint(1, 9))
            symbols += (part * rng.randint(2, 9))[: rng.randint(1, 70)] + rng.choices(range(letters), k=rng.randint(0, 9))
        got = [tuple(r) for r in periodic_runs.find_runs(np.array(symbols, np.int64)).tolist()]
        assert got == brute_runs(symbols)


def run_texts():
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "x " * 600, "la la  la\nla la\tla end"]
    for _ in range(80):
        head, part = rng.choices("abcdefgh", k=rng.randint(0, 30)), rng.choices("abcü", k=rng.randint(1, 12))
        texts.append(" ".join([*head, *(part * rng.randint(1, 12)), *rng.choices("abcdefgh", k=rng.randint(0, 30))]))
    return texts + texts[:12] + [" ".join(f"w{k % 90}" for k in range(400))]


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_digest(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    left = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    return (doc_id, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(left.encode()).hexdigest())


@pytest.mark.parametrize("block", [1, 50, 1 << 18])
def test_run_digests_equal_brute_force(spark, monkeypatch, block):
    # the tasks fork from a daemon that has read the module, so the block size is set where it is used
    texts = run_texts()
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([words_of(t) for t in texts], pa.list_(pa.string()))],
                                          names=["doc_id", "words"])]
    monkeypatch.setattr(periodic_runs, "BLOCK_WORDS", block)
    got = [row for batch in periodic_runs._found(iter(batches)) for row in batch.to_pylist()]
    assert [[(r["start"], r["length"], r["period"]) for r in row["runs"]] for row in got] == [brute_runs(words_of(t)) for t in texts]
    if block > 50:
        frame = docs(spark, texts).repartition(3).withColumn("words", F.lit(0)).withColumn("runs", F.lit(0)).withColumn("a.b", F.lit(0))
        rows = {r.doc_id: tuple(r) for r in periodic_runs.digest_rows(frame).collect()}
        assert rows == {i: brute_digest(i, t) for i, t in enumerate(texts)}


def test_runs_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, "b b b b b b", None, None, None), (4, "c", None, None, None), (4, "c", None, None, None)], DOCS)
    assert sorted((tuple(r)[:6] for r in periodic_runs.digest_rows(frame).collect()), key=repr) == [
        (4, 0, None, None, None, None), (4, 0, None, None, None, None), (None, 1, 0, 6, 1, 6000)]
    assert periodic_runs.digest_rows(docs(spark, [])).collect() == []
    kept = periodic_runs.periodic_runs(frame).filter("doc_id IS NULL").first()
    assert (kept.collapsed, [tuple(r) for r in kept.runs]) == ("b", [(0, 6, 1)])


# --- token files


def plain_huffman_bits(counts):
    heap = [(c, k, 0) for k, c in enumerate(counts) if c]
    heapq.heapify(heap)
    total, tie = 0, len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        tie += 1
        heapq.heappush(heap, (a[0] + b[0], tie, 0))
    return total


def best_limited_bits(counts, longest):
    """Smallest total by trying every sorted list of lengths that Kraft allows."""
    ranked = sorted((c for c in counts if c), reverse=True)

    def least(k, shortest, room):
        if k == len(ranked):
            return 0
        return min((ranked[k] * bits + least(k + 1, bits, room - (1 << longest - bits))
                    for bits in range(shortest, longest + 1) if room >= (len(ranked) - k) * (1 << longest - bits) or (
                        room >= (1 << longest - bits) + (len(ranked) - k - 1))), default=10**9)

    return least(0, 1, 1 << longest)


def test_code_lengths_are_optimal():
    rng = random.Random(1)
    for _ in range(40):
        counts = np.array([rng.choice([0, 1, 2, 5, 40, 1000]) for _ in range(rng.randint(2, 400))])
        lengths = huffman.code_lengths(counts, huffman.WINDOW_ROOM)
        if (counts > 0).sum() > 1:
            assert (counts * lengths).sum() == plain_huffman_bits(counts.tolist())
            assert sum(2.0 ** -int(b) for b in lengths if b) == 1
        assert ((lengths > 0) == (counts > 0)).all()
    for _ in range(30):
        counts = np.array([rng.choice([1, 2, 50, 900]) for _ in range(rng.randint(2, 7))])
        lengths = huffman.code_lengths(counts, 3)
        assert lengths.max() <= 3
        assert (counts * lengths).sum() == best_limited_bits(counts.tolist(), 3)


@pytest.mark.parametrize("symbols", [1, 2, 3, 300, 49408])
def test_pack_and_unpack(symbols):
    rng = np.random.default_rng(symbols)
    ids = np.minimum(rng.geometric(min(0.9, 20 / symbols), 5000) - 1, symbols - 1)
    code = huffman.Code(huffman.code_lengths(np.bincount(ids, minlength=symbols) + (symbols == 49408)))
    for count in (0, 1, 63, 64, 65, 5000):
        stream, offsets = code.pack(ids[:count], block=64)
        bits = "".join(format(int(code.words[i]), f"0{code.lengths[i]}b") for i in ids[:count])
        assert stream == int(bits.ljust(-(-len(bits) // 8) * 8, "0") or "0", 2).to_bytes(-(-len(bits) // 8), "big")
        assert (code.unpack(stream, offsets, count, block=64) == ids[:count]).all()


def test_section_reads_any_stretch(tmp_path):
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 900, n).astype("<u2") for n in (1, 5000, 0, 30, 2500)]
    counts = np.bincount(np.concatenate(texts), minlength=900)
    path = tmp_path / "x.bin"
    with pa.OSFile(str(path), "wb") as sink:
        writer = token_files.FileWriter(sink, huffman.Code(huffman.code_lengths(counts)), section_ids=6000)
        for name, ids in zip([None, 3, 4, 4, -9], texts, strict=True):
            writer.add(name, ids)
        writer.close()
    with pa.memory_map(str(path)) as source:
        reader = token_files.FileReader(source)
        sections = reader.sections()
        assert [before for _, _, before in sections] == [0]
        found = reader.section(*sections[0][:2])
    whole = np.concatenate(texts)
    assert found.doc_ids.to_pylist() == [None, 3, 4, 4, -9]
    for first, past in [(0, 7531), (0, 0), (1023, 1025), (1024, 2048), (4000, 7531), (7530, 7531), (5, 5)]:
        assert (found.ids(first, past) == whole[first:past]).all()
    data = path.read_bytes()
    place, size, _ = sections[0]
    broken = bytearray(data[place : place + size])
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.Section(bytes(broken), found.code)


def id_texts():
    rng = random.Random(6)
    texts = [None, "", "   ", "#", "<|endoftext|> x", "don't  STOP's\r\nÄrger ÉCOLE", "日本語 text", "İstanbul ﬁne", "a\x0bb\x1cc\x85d e", "x" * 3000]
    return texts + [" ".join(rng.choices(["Word", "w0rd,", "(x)", "12", "naïve", "e.g."], k=rng.randint(1, 400))) for _ in range(40)]


@pytest.mark.parametrize(("section_ids", "file_ids"), [(1, 1 << 26), (1 << 20, 1 << 26), (500, 300)])
def test_round_trip_equals_the_tokenizer(spark, section_ids, file_ids):
    texts = id_texts()
    ids = [k * 7 - 20 for k in range(len(texts))]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(4)
    frame = frame.withColumn("ids", F.lit(1)).withColumn("file", F.lit(1)).withColumn("a.b", F.lit(1))
    folder = f"{checkpoint_folder(spark)}/test-{section_ids}-{file_ids}"
    index = token_files.write_files(frame, folder, section_ids=section_ids, file_ids=file_ids)
    got = sorted(tuple(r) for r in token_files.read_files(index, folder).collect())
    encode, before, want = packing._tokenizer(packing.vocabulary_path()).encode, 0, []
    for i, text in zip(ids, texts, strict=True):
        found = np.array([*encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, before, len(found), zlib.crc32(found.tobytes())))
        before += len(found)
    assert got == want


@pytest.mark.parametrize("known", [0, 5, 500_000])
def test_texts_looked_up_together_take_each_stretch_once(monkeypatch, known):
    monkeypatch.setattr(token_files, "KNOWN_CHUNKS", known)
    encode, asked = token_files.ChunkIds(packing.vocabulary_path()), []
    monkeypatch.setattr(encode, "of_word", lambda word, of_word=encode.of_word: asked.append(word) or of_word(word))
    texts = [t or "" for t in id_texts()]
    tokenizer = packing._tokenizer(packing.vocabulary_path())
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode.of_texts(texts) == want and encode.of_texts([]) == []
    assert asked.count("word") == asked.count("naïve") == asked.count(",") == 1
    assert encode.of_texts(texts[3:9]) + encode.of_texts(texts) == want[3:9] + want
    assert asked.count("word") == (2 if known < 10 else 1)


def test_token_files_of_repeated_and_null_ids(spark):
    rows = [(5, "b", None, None, None)] * 30 + [(5, "a", None, None, None), (None, "c", None, None, None), (2, None, None, None, None)]
    frame = spark.createDataFrame(rows, DOCS).repartition(6)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.round_trip(frame).collect())
    assert [doc_id for _, doc_id, _ in got] == [None, 2, *[5] * 31]
    assert [start for start, _, _ in got] == [sum(n for _, _, n in got[:k]) for k in range(len(got))]
    assert token_files.round_trip(docs(spark, [])).collect() == []
