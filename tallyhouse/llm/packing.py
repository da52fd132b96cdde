"""Packing: first-fit decreasing with a tournament tree of bin capacities, in random groups.

Each document is tokenised whole, closed by an end id and cut at multiples of the sequence length. The
pieces, as small rows, are dealt into random groups of about `GROUP_PIECES`; in each group the longest
piece goes first, into the first bin with room. The leaves of the tree are the free room of the bins and an
inner node is the larger of its two children, so the first fitting bin is found by one descent.

Groups are random by piece number and equally large, whatever the documents look like; a group never
holds more than one task can pack, and waste per group is at most a few open bins.

Cases: null and empty texts are one piece with the end id alone; a long text gives one piece per
`SEQUENCE` ids; repeated rows are packed as often as they come; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import cut

SEQUENCE = 4096
END_ID = 2
GROUP_PIECES = 20_000
VOCABULARY = "word_bpe_49k.json"
#: words whose ids a task remembers; only speed depends on it
CACHED_WORDS = 400_000
BIN_BITS = 24

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: fixed values: the vocabulary's own split, after lower-casing
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: texts that need no normalising but lower case: printable ASCII, precomposed Latin, plain white space
SIMPLE = r"[\t\n\r -~\u00a1-\u024f]*"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one above 255."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, above = [], 0x100
    for byte in range(256):
        letters.append(chr(byte if byte in printable else above))
        above += byte not in printable
    return letters


class TextIds:
    """Ids of whole texts, remembered by word.

    A text of plain Latin letters is split into the vocabulary's words, which go straight to the
    tokenizer's merges; any other text goes through all steps of the tokenizer.
    """

    def __init__(self, path: str):
        import regex

        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.split, self.simple = regex.compile(WORDS).findall, regex.compile(SIMPLE).fullmatch
        self.letters = {byte: letter for byte, letter in enumerate(_byte_letters()) if chr(byte) != letter}
        self.words: dict[str, bytes] = {}

    def of_word(self, word: str) -> bytes:
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [token.id for token in self.model.tokenize(spelt)]).tobytes()

    def __call__(self, text: str) -> bytes:
        if "<|" in text or not self.simple(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) > CACHED_WORDS:
            self.words = {}
        words, known = self.split(text.lower()), self.words
        for word in set(words).difference(known):
            known[word] = self.of_word(word)
        return b"".join(map(known.__getitem__, words))


def _pieces(path: str, length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, end = TextIds(path), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                for start in range(0, len(ids), 4 * length):
                    piece = ids[start : start + 4 * length]
                    rows.append((doc_id, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def tokenised_pieces(docs: DataFrame, path: str, length: int = SEQUENCE) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        lambda batches: _pieces(path, length, batches), PIECES)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length, which come in falling order."""
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)  # node k has children 2k and 2k + 1
    bins, offsets = [], []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < length:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - room[node])
        room[node] -= length
        node //= 2
        while node:
            larger = max(room[2 * node], room[2 * node + 1])
            if room[node] == larger:
                break
            room[node] = larger
            node //= 2
    return bins, offsets


def _pack(length: int, table: pa.Table) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("_piece", "ascending")])
    bins, offsets = first_fit_decreasing(table["length"].to_pylist(), length)
    group = table["_group"][0].as_py() << BIN_BITS
    return table.drop_columns(["_group", "_piece"]).append_column(
        "sequence_id", pa.array(np.array(bins, np.int64) + group)).append_column("offset", pa.array(offsets, pa.int64()))


def pack(docs: DataFrame, path: str | None = None, length: int = SEQUENCE, group_pieces: int = GROUP_PIECES,
         seed: int = 7) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    path = path or vocabulary_path()
    # numbered once and written, so that a lost task deals the same groups again
    pieces = cut(tokenised_pieces(docs, path, length).withColumn("_piece", F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group_pieces))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("_piece", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(
        lambda table: _pack(length, table), f"{PIECES}, sequence_id long, offset long")
