"""Suffix sorting, substring dedup and embedding near-dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallyhouse.llm import cross_polytope, substrings, suffixes
from tests.llm.test_corpus import brute_components
from tests.llm.test_native import docs


def test_suffix_order_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        width = rng.choice([8, 9, 12, 16, 20])
        segments, counts = [], []
        for _ in range(rng.randint(1, 6)):
            count, letters = rng.randint(1, 40), rng.choice([b"a", b"ab", b"abc", bytes([0, 247, 5])])
            segments.append(bytes(rng.choice(letters) for _ in range(count + width - 1)))
            counts.append(count)
        ranked, repeats, first, _ = suffixes.repeated_windows(segments, counts, width)
        at, windows = 0, {}
        for segment, count in zip(segments, counts, strict=True):
            windows |= {at + k: segment[k : k + width] for k in range(count)}
            at += len(segment) + 8
        got = [windows[p] for p in ranked.tolist()]
        seen = Counter(got)
        assert got == sorted(windows.values())
        assert repeats.tolist() == [seen[w] > 1 for w in got] and first.sum() == len(seen)


def brute_spans(texts, width):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                covered[k : k + width] = b"\x01" * width
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        spans = sum(c and (k == 0 or not covered[k - 1]) for k, c in enumerate(covered))
        out.append((len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    rng = random.Random(6)
    words = [f"wört{k}" for k in range(900)]
    shared = [" ".join(rng.choices(words, k=60)) for _ in range(4)]
    texts = [None, "", "short", "a" * 399, "ab" * 900, "x" * 401, "x" * 1300]
    for _ in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 80))) for _ in range(3)]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, 3), rng.choice(shared)[rng.randint(0, 40):])
        texts.append(" ".join(parts))
    return [*texts, *texts[10:16], texts[20] + " tail", "head " + texts[21], texts[22] * 2]


@pytest.mark.parametrize(("split", "turn"), [(2000, 1 << 20), (3, 700)])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, split, turn):
    monkeypatch.setattr(substrings, "SPLIT", split)
    monkeypatch.setattr(substrings, "TURN", turn)
    texts = repeat_texts()
    rows = substrings.digest_rows(docs(spark, texts).repartition(3)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_spans(texts, 400)


def test_equal_segments_of_a_shard_are_sorted_once():
    rng = random.Random(3)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(1500))
    rows = [(0, True, k, -k, 10 * k, 1101, text) for k in range(400)]
    rows += [(0, True, 400, 7, 0, 701, bytes(reversed(text[:800])) + text[:300]), (0, True, 401, 7, 0, 101, text[200:700])]
    table = pa.table([list(c) for c in zip(*rows, strict=True)], names=[f.split()[0] for f in substrings.CUT.split(", ")])
    tracemalloc.start()
    got = substrings._sorted_shard(400, table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    runs = sorted((r["d1"], r["lo"], r["hi"]) for r in got if r["digest"] is None)
    assert runs == [*[(k, 10 * k, 10 * k + 1100) for k in range(400)], (401, 0, 100)]
    loose = [r for r in got if r["digest"] is not None]
    assert len(loose) == len({r["digest"] for r in loose}) == 1101 + 701
    assert sorted(r["lo"] for r in loose if not r["met"]) == list(range(701))
    assert peak < 10_000_000


def test_parts_of_a_split_hash_have_their_own_shards():
    text = "x" * 300 + "y" * 300
    wanted = [{"name": n, "lo": k, "hi": k, "parts": 4 if n else 1} for n in (0, 5, 60) for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text]), pa.array([wanted])], names=["d1", "d2", "text", "wanted"])
    rows = pa.Table.from_batches(list(substrings._cut_segments(400, 1, iter([batch]))))
    assert Counter(zip(rows["hot"].to_pylist(), rows["shard"].to_pylist(), strict=True))[False, 0] == 200
    assert len(set(rows["shard"].to_pylist())) == 9


def test_windows_of_a_common_passage_do_not_meet_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SPLIT", 20)
    rng = random.Random(9)
    words = [f"word{k}" for k in range(2000)]
    passage = " ".join(rng.choices(words, k=150))
    texts = [" ".join([*rng.choices(words, k=90), passage, *rng.choices(words, k=90)]) for _ in range(120)]
    texts += [t[: len(t) // 2] for t in texts[:40]]
    met, plain = [], substrings.cut
    monkeypatch.setattr(substrings, "cut", lambda df: met.append(plain(df)) or met[-1])
    rows = substrings.digest_rows(docs(spark, texts).repartition(3)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute_spans(texts, 400)
    found = next(df for df in met if "met" in df.columns)
    assert found.filter("digest IS NOT NULL").count() < 20_000


def test_substring_dedup_of_nothing(spark):
    assert substrings.digest_rows(docs(spark, [])).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, extra string"


def brute_links(rows, threshold=cross_polytope.THRESHOLD):
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float32).astype(np.float64)
        return x / np.linalg.norm(x)

    units = [unit(r[1]) for r in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if units[a] is not None and units[b] is not None
             and rows[a][2] is not None and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold]
    degree = Counter(x for p in pairs for x in p)
    roots = brute_components(range(len(rows)), pairs)
    return pairs, {k: (degree[k], roots[k], roots[k] == k) for k in range(len(rows))}


def vector_rows():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        base = rng.standard_normal(24)
        rows += [base + rng.standard_normal(24) * 0.12 for _ in range(rng.integers(1, 6))]
    rows = [(v.astype(np.float32).tolist(), int(rng.integers(0, 2))) for v in rows]
    rows += [rows[0], rows[0], ([x * 2 for x in rows[0][0]], rows[0][1]), (None, 1), ([0.0] * 24, 1), ([float("nan")] * 24, 1),
             ([None] * 24, 1), ([], 1), (rows[0][0], None), ([float("inf"), 1.0], 0), ([1.0, 2.0], 0), ([1.0, 2.0], 0), ([3e38] * 24, 0)]
    return [(k, v, label, "x") for k, (v, label) in enumerate(rows)]


def test_near_copies_equal_brute_force(spark):
    rows = vector_rows()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cross_polytope.near_copies(spark.createDataFrame(rows, VECTORS)).collect()}
    _, want = brute_links(rows)
    assert len(got) == len(rows)
    assert all(got[k][0] <= want[k][0] for k in got)
    assert sum(v[0] for v in got.values()) >= 0.9 * sum(v[0] for v in want.values())
    assert all(got[k] == want[k] for k in range(len(rows) - 13, len(rows)) if k >= len(rows) - 10)
    assert cross_polytope.near_copies(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_near_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y
    met = np.zeros(4000, bool)
    for table in range(cross_polytope.TABLES):
        a, b = cross_polytope.hashes(x, table), cross_polytope.hashes(y, table)
        met |= (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    assert met.mean() > 0.95, met.mean()


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(2).standard_normal((5, 16))
    assert np.allclose(np.linalg.norm(cross_polytope.rotated(x, 0), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(x)), x)


def test_vectors_meet_in_packed_buckets_and_are_verified_by_group(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(64)
    vectors = [*rng.standard_normal((500, 64)), *(base + 0.1 * rng.standard_normal((60, 64)))]
    # different vectors with one sketch, and copies
    vectors += [vectors[k] + 1e-6 for k in range(6)] + vectors[500:503]
    rows = [(k, v.astype(np.float32).tolist(), 1, "x") for k, v in enumerate(vectors)]
    written, plain = [], cross_polytope.cut
    monkeypatch.setattr(cross_polytope, "cut", lambda df: written.append(plain(df)) or written[-1])
    # takes effect where blocks are planned: the group is verified in four blocks
    monkeypatch.setattr(cross_polytope, "BLOCK", 16, raising=False)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cross_polytope.near_copies(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()}
    assert got == brute_links(rows)[1]
    assert sum(df.count() for df in written) < 8 * len(rows)


def test_more_parts_keep_recall_and_split_buckets():
    assert [cross_polytope.parts_for(n, 64) for n in (0, 30_000, 1_500_000, 100_000_000)] == [2, 2, 3, 4]
    rng = np.random.default_rng(4)
    x, z = rng.standard_normal((2, 2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (x * z).sum(1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    for parts in (3, 4):
        met = np.zeros(2000, bool)
        for table in range(cross_polytope.TABLES):
            a, b = cross_polytope.hashes(x, table, parts), cross_polytope.hashes(y, table, parts)
            met |= (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
            assert a.max() < 64**parts and len(np.unique(a[:, 0])) > 1900
        assert met.mean() > 0.95
    a, b = (cross_polytope.unpacked(*cross_polytope.sketches(v)) for v in (x, y))
    far = cross_polytope.distances(a, b).astype(int)
    assert far.tolist() == ((a.astype(int) - b) ** 2).sum(1).tolist()
    assert (far <= cross_polytope.reach(0.93)).all()
    assert (cross_polytope.distances(a[1:], a[:-1]) <= cross_polytope.reach(0.93)).mean() < 0.001


@pytest.mark.parametrize(("crowd", "pairs"), [(1 << 22, 1 << 18), (1 << 22, 50), (0, 50)])
def test_sketches_within_reach_are_connected(monkeypatch, crowd, pairs):
    monkeypatch.setattr(cross_polytope, "CROWD", crowd)
    monkeypatch.setattr(cross_polytope, "PAIRS", pairs)
    rng = np.random.default_rng(7)
    codes = np.clip(np.repeat(rng.integers(0, 8, (30, 32)), 6, axis=0) + rng.integers(-1, 2, (180, 32)), 0, 7).astype(np.int8)
    bucket = np.sort(rng.integers(0, 12, 180).astype(np.uint32))
    limit = cross_polytope.reach(0.93)
    want = [(a, b) for a in range(180) for b in range(a + 1, 180) if bucket[a] >> 1 == bucket[b] >> 1 and not bucket[a] & 1
            and ((codes[a].astype(int) - codes[b]) ** 2).sum() <= limit]
    found = [(int(a), int(b)) for part in cross_polytope._near_sketches(limit, bucket, codes) for a, b in zip(*part, strict=True)]
    assert len(want) > 20
    if crowd:
        assert sorted(found) == want
    roots = brute_components(range(180), found)
    assert all(roots[a] == roots[b] for a, b in want)
