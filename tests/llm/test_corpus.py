"""Classifiers, mixing, line templates, the Jaccard join and the pipeline against brute force."""

from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyhouse.llm import arrays, jaccard, line_templates, mixing, packing, quality_knn
from tallyhouse.llm.common import cut
from tallyhouse.llm.components import components
from tests.llm.test_native import DOCS, docs

SF = "/root/testdata/sf0.001"


def words_of(text, lower=True):
    text = "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


@pytest.mark.parametrize("window", [7, 64, 1 << 21])
def test_word_hashes_tell_words_apart(monkeypatch, window):
    monkeypatch.setattr(arrays, "WINDOW_BYTES", window)
    rng = random.Random(2)
    texts = [None, "", " ", *["".join(rng.choices("abÀ \n\tXyz", k=rng.randint(0, 90))) for _ in range(300)], "q" * 300 + " r", "é"]
    data, offsets = arrays.text_bytes(pa.array(texts, pa.string()))
    hashes, owners = arrays.word_hashes(data, offsets)
    want = [(k, w) for k, t in enumerate(texts) for w in words_of(t)]
    assert owners.tolist() == [k for k, _ in want]
    assert len(set(zip(hashes.tolist(), [w for _, w in want], strict=True))) == len(set(hashes.tolist())) == len({w for _, w in want})


def brute_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == brute_components(nodes, [x for x in links if x[0] != x[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_texts():
    rng = random.Random(9)
    texts = [None, "", " \n", "one", "One", "a b c d", "A b  C d", "a b c d e"]
    shared = " ".join(f"s{k}" for k in range(60))
    for _ in range(25):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(8, 90))]
        if rng.random() < 0.4:
            base += shared.split()
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 99)}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return [*texts, *texts[:20], "loop the loop " * 50]


def brute_groups(texts):
    sets = []
    for text in texts:
        w = words_of(text)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = brute_components(range(len(sets)), links)
    return {k: (len(s), roots[k]) for k, s in enumerate(sets)}


@pytest.mark.parametrize("part_tokens", [50, 3_000_000])
def test_jaccard_groups_equal_brute_force(spark, monkeypatch, part_tokens):
    monkeypatch.setattr(jaccard, "PART_TOKENS", part_tokens)
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs(spark, texts).repartition(3)).collect()}
    want = brute_groups(texts)
    assert got == want
    kept = jaccard.keep_one(docs(spark, texts))
    assert kept.columns == DOCS.names
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, (_, root) in want.items() if k == root)


def test_signs_differ_in_no_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(4)
    for _ in range(300):
        tokens = rng.integers(0, 2**63, rng.integers(1, 900)).astype(np.uint64)
        x, y = (tokens[rng.random(len(tokens)) < 0.8] for _ in range(2))
        bits = int(np.bitwise_count((jaccard.parity_signs(x) ^ jaccard.parity_signs(y)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(x, y))


def test_unlike_sets_that_share_a_passage_form_no_pair(spark, monkeypatch):
    texts = [" ".join([*[f"s{k}" for k in range(60)], *[f"d{n}x{k}" for k in range(10)]]) for n in range(60)]
    texts += [f"{t} tail" for t in texts]
    met, plain = [], jaccard._cross_pairs
    monkeypatch.setattr(jaccard, "_cross_pairs", lambda nodes, percent: met.append(plain(nodes, percent)) or met[0])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs(spark, texts).repartition(3)).collect()}
    assert got == brute_groups(texts)
    assert met[0].count() <= len(texts)


def test_a_pair_meets_at_its_first_shared_token_only(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for n in range(12):
        base = [f"b{n}x{k}" for k in range(2000)]
        texts += [" ".join(f"e{n}y{e}z{k}" if k in edits else w for k, w in enumerate(base))
                  for e in range(3) for edits in [set(rng.sample(range(2000), 15))]]
    met, plain = [], jaccard._cross_pairs
    monkeypatch.setattr(jaccard, "FIRST_ORDERS", 1)
    monkeypatch.setattr(jaccard, "_cross_pairs", lambda nodes, percent: met.append(cut(nodes)) or plain(met[0], percent))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.groups(docs(spark, texts).repartition(3)).collect()}
    assert got == brute_groups(texts)
    alone = met[0].withColumn("root", F.col("node"))
    rows = jaccard._meetings(alone, jaccard.PERCENT)
    # of some three hundred tokens that each pair shares in its prefixes
    assert plain(alone, jaccard.PERCENT).count() == 36 and 72 <= rows.count() <= 20 * 36


def test_jaccard_of_nothing_and_of_odd_ids(spark):
    assert jaccard.groups(docs(spark, [])).count() == 0
    text = " ".join(f"w{k}" for k in range(20))
    frame = spark.createDataFrame([(None, text, None, None, None), (4, text, None, None, None), (4, text, None, None, None)], DOCS)
    assert {tuple(r)[::2] for r in jaccard.groups(frame).collect()} == {(None, 4), (4, 4)}
    assert [r.doc_id for r in jaccard.keep_one(frame).collect()] == [4]


def brute_lines(texts, least):
    def shape(line):
        found = [w for w in re.split("[\x20\x09-\x0d]+", line) if w]
        masked = tuple("<*>" if re.search("[0-9]", w) else w for w in found)
        return (len(found), masked[:3]), masked

    rows = [(k, pos, *shape(line)) for k, t in enumerate(texts) if t is not None for pos, line in enumerate(t.split("\n")) if shape(line)[1]]
    leaf_texts, field_texts, template_texts, first = {}, {}, {}, {}
    for k, _, leaf, w in rows:
        leaf_texts.setdefault(leaf, set()).add(texts[k])
        for i, word in enumerate(w):
            field_texts.setdefault((leaf, i, word), set()).add(texts[k])
    named = []
    for k, pos, leaf, w in rows:
        template = tuple(x if len(field_texts[leaf, i, x]) >= least else "<*>" for i, x in enumerate(w))
        if len(leaf_texts[leaf]) >= least and 2 * sum(x != "<*>" for x in template) >= len(w):
            named.append((k, pos, (leaf, template)))
            template_texts.setdefault((leaf, template), set()).add(texts[k])
            first.setdefault((leaf, template), texts[k])
    gone = {}
    for k, pos, template in named:
        if len(template_texts[template]) >= least and first[template] != texts[k]:
            gone.setdefault(k, set()).add(pos)
    return [None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())) for k, t in enumerate(texts)]


def test_line_templates_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "\n\n", "Page 3 of 9"]
    for k in range(120):
        lines = [f"own line {k} {rng.random()}" if rng.random() < 0.5 else " ".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(1, 5))]
        lines += rng.sample([f"Page {k} of {k + 7}", "All rights reserved.", f"Posted by user{k} on day {k}", "x y z " + rng.choice("pq"), ""], 2)
        rng.shuffle(lines)
        texts.append("\n".join(lines))
    texts += [texts[5]] * 30
    out = line_templates.drop_lines(docs(spark, texts), min_texts=10).orderBy("doc_id").collect()
    want = brute_lines(texts, 10)
    assert [r.text for r in out] == want
    assert sum(a != b for a, b in zip(texts, want, strict=True)) > 50
    assert all(r.n_chars is None or r.n_chars == len(r.text) for r in out)
    left = line_templates.without_boilerplate(docs(spark, texts), min_texts=10)
    assert left.columns == DOCS.names
    assert left.count() == sum(a is None or a == b or bool((b or "").split()) for a, b in zip(texts, want, strict=True))
    assert line_templates.drop_lines(docs(spark, [])).count() == 0


def test_whole_lines_go_at_few_texts(spark):
    rng = random.Random(12)

    def prose(count):
        return " ".join(f"w{rng.randint(0, 10**6)}x" for _ in range(count))

    passage, footer, short, table, brief = prose(60), prose(8), prose(4), " ".join(str(k) for k in range(9)), "Read more"
    texts = [f"{prose(90)}\n{passage}\n{prose(30)}" for _ in range(2)]
    texts += [f"{prose(90)}\n{prose(7)}\n{footer}\n{table}" for _ in range(3)] + [f"{short}\n{brief}\n{prose(70)}" for _ in range(9)]
    pair = prose(9)
    texts += [f"{prose(40)}\n{pair}" for _ in range(2)]
    whole = [prose(60), prose(55), prose(12)]
    near = ["\n".join([*whole, f"{prose(2)}"]) for _ in range(6)]
    texts += [*near, texts[0], None, "", f"{passage}\r\n{footer} and one more", None]
    out = [r.text for r in line_templates.drop_lines(docs(spark, texts)).orderBy("doc_id").collect()]
    want = list(texts)
    want[1] = "\n".join(texts[1].split("\n")[::2])
    for k in (3, 4):
        want[k] = "\n".join(texts[k].split("\n")[:2])
    for k in range(6, 14):
        want[k] = "\n".join(texts[k].split("\n")[1:])
    want[-2] = f"{footer} and one more"
    assert out == want


def test_line_hashes_equal_a_plain_loop():
    texts = ["", "a b\n\n b  a\n", "\n", "", "b a", "a b c\r\na b", "\n\nb a"]
    data, offsets = arrays.text_bytes(pa.array(texts))
    got = list(zip(*line_templates.line_hashes(data, offsets), strict=True))
    want = [(k, n, line.split()) for k, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if line.split()]
    assert [(k, n, size) for k, n, _, size, _ in got] == [(k, n, len(w)) for k, n, w in want]
    assert len({h for _, _, h, _, _ in got}) == len({tuple(w) for _, _, w in want})
    assert all((a[2] == b[2]) == (x[2] == y[2]) for a, x in zip(got, want, strict=True) for b, y in zip(got, want, strict=True))


def test_quality_votes_on_held_out_rows(spark):
    frame, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = quality_knn.score(frame, quality_knn.fit(frame, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in found]) > 0.9
    assert all(0 <= r.score <= 1 for r in found)


def test_quality_is_told_by_words_of_one_shape(spark):
    rng = random.Random(3)
    good, bad = ([a + str(k).translate(str.maketrans("0123456789", "abcdefghij")) for k in range(100, 160)] for a in "vw")
    texts = [" ".join(rng.choices(bad if k % 2 else good, k=40)) for k in range(80)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id long, quality int")
    out = quality_knn.score(docs(spark, texts), quality_knn.fit(docs(spark, texts), labels)).filter("doc_id >= 60").collect()
    assert [r.predicted for r in sorted(out)] == [1 - k % 2 for k in range(60, 80)]


def test_quality_votes_on_odd_rows(spark):
    texts = [None, "", "good text here", "bad ### text", "good text here", "x" * 100_000]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1), (None, 0), (2, None), (77, 0)], "doc_id long, quality int")
    out = quality_knn.score(docs(spark, texts), quality_knn.fit(docs(spark, texts), labels)).orderBy("doc_id").collect()
    assert len(out) == len(texts) and out[2].score == out[4].score
    none = quality_knn.fit(docs(spark, texts), labels.limit(0))
    assert {r.score for r in quality_knn.score(docs(spark, texts), none).collect()} == {0.5}
    assert quality_knn.score(docs(spark, []), none).count() == 0


def test_neighbour_votes_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    space = quality_knn.fit_space(rng.random((40, 30)).astype(np.float32), rng.integers(0, 2, 40).astype(float), 8)
    terms = rng.random((5, 30)).astype(np.float32)
    for row, score in zip(space.embed(terms), space.scores(terms), strict=True):
        near = sorted(((-float(row @ v), k) for k, v in enumerate(space.vectors)))[: quality_knn.NEIGHBOURS]
        weights = [np.exp(quality_knn.SHARPNESS * (-c - 1)) for c, _ in near]
        assert score == pytest.approx(sum(w * space.labels[k] for w, (_, k) in zip(weights, near, strict=True)) / sum(weights), abs=1e-5)


def test_mixing_reaches_its_targets(spark):
    frame, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = mixing.report(frame, labels).toPandas()
    total = out.n_tokens.sum()
    for name, share in mixing.TARGETS.items():
        assert (out.rate * out.n_tokens * out[f"p_{name}"]).sum() / total == pytest.approx(share, abs=0.002)
    assert (out.rate >= 0).all() and (abs(out.copies - out.rate) < 1).all()
    assert np.allclose(out[["p_clean", "p_low", "p_toxic"]].sum(axis=1), 1)


@pytest.mark.parametrize("same_id", [False, True])
def test_mixing_realises_its_rates_where_one_text_is_a_third(spark, same_id):
    frame, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = frame.collect()
    one = next(r for r in rows if r.text and 300 < len(r.text.split()) < 600)
    copies = [(one.doc_id if same_id else 10**6 + k, *one[1:]) for k in range(len(rows) // 2)]
    out = mixing.report(frame.union(spark.createDataFrame(copies, frame.schema)), labels).toPandas()
    group = out[(out.doc_id == one.doc_id) | (out.doc_id >= 10**6)]
    assert len(group) == len(copies) + 1 and abs(group.copies.mean() - group.rate.mean()) < 0.11
    part, total = out.rate % 1, (out.rate * out.n_tokens).sum()
    for name in mixing.DOMAINS:
        mass = out.n_tokens * out[f"p_{name}"]
        noise = (mass**2 * part * (1 - part)).sum() ** 0.5 / total
        assert abs((mass * (out.copies - out.rate)).sum() / total) < 4 * noise + 1e-4


@pytest.mark.parametrize("rare", [0.005, 0.0012])
def test_rates_reach_the_given_targets_of_a_rare_domain(spark, rare):
    rng = np.random.default_rng(4)
    natural = np.array([0.976 - rare, 0.024, rare])
    odds = rng.normal(size=(6000, 3))
    odds[np.arange(6000), rng.choice(3, 6000, p=natural)] += 5
    odds = np.exp(odds + np.log(natural))
    members = spark.createDataFrame(
        [(int(n), (p / p.sum()).tolist()) for n, p in zip(rng.integers(10, 900, 6000), odds, strict=True)], "_tokens long, _p array<double>")
    fit = mixing.fit_rates(members.coalesce(1).cache())
    assert fit.wanted.tolist() == pytest.approx([0.9, 0.07, 0.03])
    assert fit.reached.tolist() == pytest.approx([0.9, 0.07, 0.03], abs=mixing.TOLERANCE)
    with pytest.warns(UserWarning, match="targets not met"):
        poor = mixing.fit_rates(members, iterations=0)
    assert poor.wanted[2] == pytest.approx(0.03) and poor.reached[2] < 0.01


def test_targets_change_only_where_a_domain_has_no_mass():
    assert mixing.wanted_shares(np.array([0.9, 0.1, 0]), mixing.TARGETS).tolist() == pytest.approx([0.9 / 0.97, 0.07 / 0.97, 0])
    assert mixing.wanted_shares(np.array([0.9, 0.0999, 0.0001]), mixing.TARGETS).tolist() == pytest.approx([0.9, 0.07, 0.03])


def test_mixing_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    frame = docs(spark, [None, "a b c", "# # #", "", "a b c"]).withColumnsRenamed({"lang": "_rate", "source": "_p"})
    out = mixing.mix(frame, labels)
    assert out.columns == frame.columns and {r.doc_id for r in out.collect()} <= set(range(5))
    assert mixing.mix(frame.limit(0), labels).count() == 0
    assert mixing.report(frame, labels.limit(0)).count() == 5


def test_rates_equal_a_plain_loop(spark):
    steps = [np.array([0.5, -0.2, 2.0]), np.array([-0.3, 0.1, 0.0])]
    p = [[1.0, 0.0, 0.0], [0.2, 0.3, 0.5], [0.0, 0.0, 1.0]]
    want = []
    for row in p:
        r = 1.0
        for step in steps:
            r = max(0.0, r - float(np.dot(row, step)))
        want.append(r)
    frame = spark.createDataFrame([(x,) for x in p], "_p array<double>")
    assert [r[0] for r in frame.select(mixing.rate(steps, F.col("_p"))).collect()] == pytest.approx(want)


def test_pipeline_stages(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    held = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, held, SF)
        assert after.columns == frame.columns, name
        rows = after.collect()
        assert 0 < len(rows)
        if name == "jaccard_join":
            assert len(rows) == len({root for _, root in brute_groups([r.text for r in held.orderBy("doc_id").collect()]).values()})
        held = spark.createDataFrame(rows, frame.schema)
    texts = {r.doc_id: r.text for r in held.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, held, SF).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert {r.doc_id for r in pieces} == set(texts) and max(r.offset + r.length for r in pieces) <= packing.SEQUENCE


def test_fit_of_the_domains_holds_few_columns_at_a_time(spark):
    frame = docs(spark, [f"text {k} of word{k % 7}" for k in range(400)])
    labels = spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    tracemalloc.start()
    classifier = mixing.fit_classifier(frame, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(classifier.kept) == mixing.KEPT_FEATURES
    # all features of the 400 texts at once would take 20 MB in single precision
    assert peak < 12_000_000
