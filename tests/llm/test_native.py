"""Quality rules, secret scan, packing and archives against brute force on small hand-made frames."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from tallyhouse.llm import packing, quality_rules, secrets, warc

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
BLANK = "\x20\x09-\x0d"


def docs(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], schema)


def corpus() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "Über", "naïve", "x1", "#tag", "a|b", "end.", "…"]
    made = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(30)]
    lined = ["\n".join(rng.choices(["one two", "", " ", "three\tfour", "five!"], k=rng.randint(1, 40))) for _ in range(20)]
    return [None, "", " \n\t ", "one", "a b c", "a b c a b c", "a b a b a b a", "é" * 9, *made, *lined, made[0],
            " ".join(f"w{i}" for i in range(5000)), "x" * 20000]


def quality_base(text: str | None) -> tuple:
    text = text or ""
    words = [w for w in re.split(f"[{BLANK}]+", text) if w]
    lines = [line for line in text.split("\n") if re.search(f"[^{BLANK}]", line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_base_equals_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules.judge(docs(spark, texts)).select("doc_id", *quality_rules.BASE).collect()}
    assert got == {i: quality_base(t) for i, t in enumerate(texts)}


def test_quality_verdicts(spark):
    prose = " ".join(f"the w{i} of v{i}" for i in range(40))
    texts = [prose, prose.upper().replace(" ", "!! "), prose.replace(" ", "### "), prose.replace("the", "zzz").replace("of", "yyy"), None]
    rows = quality_rules.judge(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.kept for r in rows] == [True, False, False, False, False]
    assert "stop_word_ratio" in rows[3].failed_rules


def test_quality_keeps_columns_with_clashing_names(spark):
    frame = docs(spark, [" ".join(f"the w{i}" for i in range(60)), "short"])
    frame = frame.withColumnsRenamed({"lang": "kept", "source": "n_words"})
    out = quality_rules.keep_good(frame)
    assert out.columns == frame.columns and [tuple(r) for r in out.collect()] == [tuple(frame.orderBy("doc_id").first())]
    assert quality_rules.keep_good(frame.limit(0)).count() == 0


def brute_secrets(text: str | None) -> list[tuple[int, int, int]]:
    text, found = text or "", []
    pattern = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(pattern, text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(found)


def secret_texts() -> list[str | None]:
    rng = random.Random(3)
    parts = ["password", "PassWd", "tOKen", "secret", "api_key", "APIKEY", "toKen", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA",
             "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", "\n", "x", "-._/+", "ſecret", "apiKey", "abcdef", "AB"]
    return [None, "", "password=token=abcdef", "token: short", "a" * 23, "a" * 24, "f" * 100_000,
            *["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(3000)]]


def test_secret_base_equals_brute_force():
    for text in secret_texts():
        assert [s for s in secrets.spans(text or "") if s[1] < 3] == brute_secrets(text), text


def test_secret_scan_rows(spark):
    texts = [None, "", "é password = abc123xyz", "AKIA" + "A" * 16]
    rows = secrets.scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.spans for r in rows] == ["", "", "assign:2:22", "access:0:20"]
    assert rows[2].base_sha256 == hashlib.sha256(b"assign:2:22").hexdigest()
    assert (rows[2].n_assign, rows[3].n_access) == (1, 1)
    assert secrets.scan(docs(spark, [])).count() == 0


def test_tokens_need_their_checksum():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = "ghp_" + body + secrets.checksum62(body)
    assert secrets.spans(f"x {good} y") == [(2, 3, 42)]
    assert secrets.spans(f"x {good[:-1]}{'0' if good[-1] != '0' else '1'} y") == []
    assert secrets.spans(f"{good}z") == []


def test_redact(spark):
    frame = secrets.scan(docs(spark, ["a token=abcdef b", None])).join(docs(spark, ["a token=abcdef b", None]), "doc_id")
    assert [r.text for r in secrets.redact(frame).orderBy("doc_id").collect()] == ["a [secret] b", None]


def tokens_of(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary_path())
    return [[*whole.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for t in texts]


ODD_TEXTS = ["ΑΣ ΟΔΟΣ", "İstanbul Straße", "a<|endoftext|>b", "é combined", "don't We'LL it's", "tab\tnew\nline\x1cfs\x85nel nb",
             "漢字かな 12345 !!??", "x­y İͅ", "🙂 emoji", "ﬁ ligature Ⅷ"]


def test_fast_ids_equal_the_tokenizer():
    encode = packing.TextIds(packing.vocabulary_path())
    texts = [*ODD_TEXTS, *[t or "" for t in corpus()]]
    for text, ids in zip(texts, tokens_of(texts), strict=True):
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in ids[:-1]), text


def test_packing_places_every_id_once(spark):
    texts = [*corpus(), *ODD_TEXTS, "word " * 9000, "word " * 9000]
    rows = packing.pack(docs(spark, texts), group_pieces=20).collect()
    want = tokens_of(texts)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc_id, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            ids = want[doc_id][r.start : r.start + r.length]
            assert r.start == at and r.doc_tokens == len(want[doc_id])
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
            at += r.length
        assert at == len(want[doc_id])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
    assert packing.pack(docs(spark, [])).count() == 0


def test_first_fit_decreasing_equals_a_plain_loop():
    rng = random.Random(1)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 60))), reverse=True)
        room, want = [], []
        for length in lengths:
            k = next((k for k, free in enumerate(room) if free >= length), len(room))
            room += [100] * (k == len(room))
            want.append((k, 100 - room[k]))
            room[k] -= length
        assert list(zip(*packing.first_fit_decreasing(lengths, 100), strict=True)) == want


PAGES = "page_id long, url string, html string, archive string"


@pytest.mark.parametrize("frame_bytes", [1, 300, 1 << 20])
def test_archives_round_trip(spark, tmp_path, frame_bytes):
    rows = [(5, "u", "same", "c"), (3, "u\r\n v", "same", None), (7, None, "same", "c"), (1, "u", None, "c"), (2, "u", "", "c"),
            (9, "é", "WARC/1.1\r\n\r\nä" * 50, "c"), (11, "u", "x" * 5000, "c"), (4, "u", "once", "c"), (4, "u", "once", "c")]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), f"file://{tmp_path}/w", frame_bytes=frame_bytes)
    got = sorted(tuple(r) for r in warc.read_archives(index, f"file://{tmp_path}/w").collect())
    first = {"same": 3, "": 1, "once": 4}
    want = []
    for page_id, _, html, _ in rows:
        payload = (html or "").encode()
        refers = first.get(html or "")
        refers = refers if refers != page_id else None
        want.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                     "response" if refers is None else "revisit", refers))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    found = {r.page_id: bytes(r.block).decode() for r in warc.lookup(index, f"file://{tmp_path}/w").collect()}
    assert found[9] == rows[5][2] and found[7] == "" and found[3] == "same"


def test_archives_of_nothing(spark):
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_archive_is_plain_zstandard(tmp_path):
    import zstandard

    with open(tmp_path / "a", "wb") as sink:
        writer = warc.BundleWriter(sink, 10)
        places = [writer.add(data) for data in (b"12345", b"6789", b"0" * 30, b"x")]
        writer.close()
    assert places == [(0, 0), (0, 5), (1, 0), (2, 0)]
    with open(tmp_path / "a", "rb") as source:
        assert zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True).read() == b"123456789" + b"0" * 30 + b"x"
        assert warc.BundleReader(source).frame(1) == b"0" * 30
