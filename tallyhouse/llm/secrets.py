"""Secret scan: keyword prefilter, anchored patterns at the hits, embedded checksums.

An Aho-Corasick automaton over all keywords walks each whole text once. A pattern is tried only at
the place where one of its keywords starts, so ordinary prose costs one automaton step per
character. Issued tokens that carry their own checksum are reported only if it holds.

Kinds, in the order that breaks ties at one start: `assign` (a named password, secret, token or key),
`access` (AKIA...), `hex` (24 or more lower-case hex digits), and the two added by this method,
`github` and `npm` (tokens whose last six characters are the base-62 CRC-32 of the 30 before them).

Within a kind, matches are leftmost and do not overlap; a match that is too short still consumes its
text. Cases: a null or empty text has no span; texts of any length are scanned whole; repeated rows give
repeated results; an empty table gives an empty table. `scan` returns only its own columns.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]

#: fixed values: the keywords and patterns of each kind
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
TOKEN_PREFIXES = {"github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
TOKEN_BODY = re.compile("[A-Za-z0-9]{36}(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: hex digits have no keyword of their own, so every group of this many digits is one
HEX_GRAM = 4

Span = tuple[int, int, int]  # start, kind, end


@cache
def automaton():
    """Keyword -> (kind, length); keywords that match in either case are listed in every casing."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for gram in product("0123456789abcdef", repeat=HEX_GRAM):
        found.add_word("".join(gram), (2, HEX_GRAM))
    for word in ASSIGN_WORDS:
        for cased in product(*[sorted({c.lower(), c.upper()}) for c in word]):
            found.add_word("".join(cased), (0, len(word)))
    found.add_word("AKIA", (1, 4))
    for kind, prefixes in TOKEN_PREFIXES.items():
        for prefix in prefixes:
            found.add_word(prefix, (KINDS.index(kind), len(prefix)))
    found.make_automaton()
    return found


def checksum62(body: str) -> str:
    """CRC-32 of the text as six base-62 digits, highest first."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def spans(text: str) -> list[Span]:
    """All reported spans in code points, by start and then kind."""
    found: list[Span] = []
    over = [0] * len(KINDS)  # per kind, the end of its last match
    for last, (kind, length) in automaton().iter(text):
        start = last - length + 1
        if start < over[kind]:
            continue
        if kind == 2:
            over[2] = end = HEX.match(text, start).end()
            if end - start >= MIN_HEX:
                found.append((start, 2, end))
        elif kind == 0:
            if match := ASSIGN.match(text, start):
                over[0] = match.end()
                if match.end(2) - match.start(2) >= MIN_VALUE:
                    found.append((start, 0, match.end()))
        elif kind == 1:
            if match := ACCESS.match(text, start):
                over[1] = end = match.end()
                if end - start >= MIN_ACCESS:
                    found.append((start, 1, end))
        elif match := TOKEN_BODY.match(text, last + 1):
            body = match.group()
            if checksum62(body[:30]) == body[30:]:
                over[kind] = match.end()
                found.append((start, kind, match.end()))
    return sorted(found)


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1):
            found = spans(text.as_py() or "")
            base = [s for s in found if s[1] < len(BASE_KINDS)]
            counts = [sum(s[1] == kind for s in base) for kind in range(len(BASE_KINDS))]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def scan(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, and all spans as text."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        _scan, f"doc_id long, {SCHEMA}")


def redact(text_spans: DataFrame, text: str = "text", found: str = "spans", mark: str = "[secret]") -> DataFrame:
    """Replaces every reported span by `mark`; overlapping spans are merged. Null texts stay null."""
    def clean(value: str | None, listed: str | None) -> str | None:
        if not value or not listed:
            return value
        out, at = [], 0
        for start, end in sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in listed.split(","))):
            if start >= at:
                out += [value[at:start], mark]
            at = max(at, end)
        return "".join(out) + value[at:]

    return text_spans.withColumn(text, F.udf(clean, "string")(text_spans[text], text_spans[found]))
