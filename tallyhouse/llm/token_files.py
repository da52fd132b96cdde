"""Token ids as Huffman-coded binary files in ascending document order.

Every text is tokenised once, closed by an end id and written as plain ids. The ids are counted over all texts; one
code is built from these counts. The documents are then ranged by id and each partition writes one file:

    file     := MAGIC, size of the code table, code table, sections, section table, FOOTER
    code table := the bits of every symbol, deflated
    section  := HEAD, documents (null flag, id, number of ids; deflated), bit offset of every block, bit stream, crc32
    section table := (place, size, ids before it in the file) of every section

A section holds whole documents of about `SECTION_IDS` ids. Blocks of a section decode independently from their bit
offsets, so any stretch of ids is read without decoding the rest. The index names file and place of every section;
reading deals runs of sections, not files, to tasks.

Files go to the shared folder of the session. A task puts its attempt in the file's name and the index has the names of
the attempts that counted, so a lost or doubled task cannot mix two versions. Only sums reach the driver: one count
per symbol of the vocabulary and one per file.

Cases: a null or empty text has the end id alone; null document ids come first; documents with one id are ordered by
crc32 and number of their ids; a document of any length lies in one section; an empty table gives no file and no row;
other columns of the input are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, groupby, pairwise
from operator import itemgetter
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.arrays import blocks, text_bytes
from tallyhouse.llm.common import checkpoint_folder, cut
from tallyhouse.llm.huffman import BLOCK_IDS, Code, code_lengths
from tallyhouse.llm.packing import END_ID, TextIds, vocabulary_path
from tallyhouse.llm.warc import _filesystem

SECTION_IDS = 1 << 20
#: sections that a reading task takes on, where files are larger
TASK_SECTIONS = 8
#: ids per file at most, where spark.sql.shuffle.partitions files would be larger
FILE_IDS = 1 << 26
#: stretches whose ids a worker remembers; only speed depends on it
KNOWN_CHUNKS = 500_000
#: bytes of texts that are looked up together
TEXT_BYTES = 4 << 20
MAGIC = b"TOKHUF01"
SIZE, HEAD, ENTRY, FOOTER = struct.Struct("<I"), struct.Struct("<QQIII"), struct.Struct("<QQQ"), struct.Struct("<I8s")

TOKENS = "doc_id long, n_tokens long, ids_crc32 long, ids binary"
INDEX = "file long, name string, place long, size long, first long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class ChunkIds(TextIds):
    """Ids of whole texts by stretch between white space, which no token spans. Known stretches and their ids are two columns."""

    #: what the short way cannot take, besides "<|"; see SIMPLE
    other = re.compile("[^\t\n\r -~¡-ɏ]").search

    def __init__(self, path: str):
        super().__init__(path)
        self.known, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.marks: dict[str, bytes] = {}

    def of_chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            return self.of_word(chunk)
        mark = chunk[-1:]
        if chunk[:-1].isalpha() and not mark.isnumeric():
            if mark not in self.marks:
                self.marks[mark] = self.of_word(mark)
            return self.of_word(chunk[:-1]) + self.marks[mark]
        return b"".join(map(self.of_word, self.split(chunk)))

    def of_texts(self, texts: list[str]) -> list[bytes]:
        simple = ["<|" not in text and not self.other(text) for text in texts]
        short = iter(self._of_simple([text for text, plain in zip(texts, simple, strict=True) if plain]))
        return [next(short) if plain else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                for text, plain in zip(texts, simple, strict=True)]

    def _of_simple(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        chunks = pc.utf8_split_whitespace(pa.array([text.lower() for text in texts], pa.large_string()))
        coded = chunks.values.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = coded.dictionary.filter(place.is_null())
        numbers = place.fill_null(-1).to_numpy().astype(np.int64)
        numbers[numbers < 0] = np.arange(len(self.known), len(self.known) + len(fresh))
        self.known = pa.concat_arrays([self.known, fresh])
        self.ids = pa.concat_arrays([self.ids, pa.array(map(self.of_chunk, fresh.to_pylist()), pa.large_binary())])
        data, offsets = text_bytes(self.ids.take(pa.array(numbers[coded.indices.to_numpy()])))
        if len(self.known) > KNOWN_CHUNKS:
            # the stretches met last stay
            self.known, self.ids = coded.dictionary, self.ids.take(pa.array(numbers))
        ends = offsets[chunks.offsets.to_numpy()].tolist()
        whole = memoryview(data)
        return [bytes(whole[first:past]) for first, past in pairwise(ends)]

    def __call__(self, text: str) -> bytes:
        return self.of_texts([text])[0]


@cache
def _encoder(path: str) -> ChunkIds:
    """One per process, so that the tasks of a worker share what it remembers."""
    return ChunkIds(path)


def _tokenised(path: str, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode, end = _encoder(path), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        for first, past, _, _ in blocks(batch.column(1), TEXT_BYTES):
            part = batch.slice(first, past - first)
            found = [ids + end for ids in encode.of_texts([text or "" for text in part.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(ids) // 4 for ids in found], pa.int64()),
                pa.array([zlib.crc32(ids) for ids in found], pa.int64()),
                pa.array([np.frombuffer(ids, "<u4").astype(kind).tobytes() for ids in found], pa.binary()),
            ], names=["doc_id", "n_tokens", "ids_crc32", "ids"])


def _joined(column: pa.Array, kind: str) -> np.ndarray:
    """The ids of all rows in a row."""
    if not len(column):
        return np.zeros(0, kind)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind)


def _counted(kind: str, symbols: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(symbols, np.int64)
    for batch in batches:
        counts += np.bincount(_joined(batch.column(0), kind), minlength=symbols)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])


class FileWriter:
    """Sections of whole documents in one code, then their table."""

    def __init__(self, sink, code: Code, section_ids: int = SECTION_IDS):
        self.sink, self.code, self.section_ids = sink, code, section_ids
        table = zlib.compress(code.lengths.astype(np.uint8).tobytes())
        self.place = sink.write(MAGIC + SIZE.pack(len(table)) + table)
        self.sections: list[tuple[int, int, int]] = []
        self.ids_before = 0
        self._clear()

    def _clear(self) -> None:
        self.nulls, self.names, self.counts, self.parts, self.held = [], [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.nulls.append(doc_id is None)
        self.names.append(doc_id or 0)
        self.counts.append(len(ids))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.section_ids:
            self.flush()

    def flush(self) -> None:
        if not self.names:
            return
        stream, offsets = self.code.pack(np.concatenate(self.parts))
        documents = zlib.compress(np.array(self.nulls, np.uint8).tobytes() + np.array(self.names, "<i8").tobytes()
                                  + np.array(self.counts, "<u8").tobytes())
        body = HEAD.pack(len(self.names), self.held, BLOCK_IDS, len(offsets), len(documents)) + documents
        body += offsets.astype("<u8").tobytes() + stream
        size = self.sink.write(body + SIZE.pack(zlib.crc32(body)))
        self.sections.append((self.place, size, self.ids_before))
        self.place, self.ids_before = self.place + size, self.ids_before + self.held
        self._clear()

    def close(self) -> None:
        self.flush()
        self.sink.write(b"".join(ENTRY.pack(*section) for section in self.sections)
                        + FOOTER.pack(len(self.sections), MAGIC))


class Section:
    """Documents of one section, and any stretch of its ids."""

    def __init__(self, data: bytes, code: Code):
        body = data[: -SIZE.size]
        if zlib.crc32(body) != SIZE.unpack(data[-SIZE.size :])[0]:
            raise ValueError("a section does not match its checksum")
        docs, self.n_ids, self.block, blocks, packed = HEAD.unpack_from(body)
        at = HEAD.size + packed
        table = zlib.decompress(body[HEAD.size : at])
        names = np.frombuffer(table, "<i8", docs, docs)
        self.doc_ids = pa.array(names, pa.int64(), mask=np.frombuffer(table, np.uint8, docs).astype(bool))
        self.counts = np.frombuffer(table, "<u8", docs, 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(body, "<u8", blocks, at).astype(np.int64)
        self.stream, self.code = body[at + 8 * blocks :], code

    def ids(self, first: int = 0, past: int | None = None) -> np.ndarray:
        """Ids [first, past) of the section, from the blocks they lie in."""
        past = self.n_ids if past is None else past
        if past <= first:
            return np.zeros(0, np.uint32)
        low, high = first // self.block, -(-past // self.block)
        # the stream is cut to the bytes of these blocks
        begin = int(self.offsets[low]) >> 3
        end = (int(self.offsets[high]) + 7) // 8 if high < len(self.offsets) else len(self.stream)
        count = min(high * self.block, self.n_ids) - low * self.block
        found = self.code.unpack(self.stream[begin:end], self.offsets[low:high] - 8 * begin, count, self.block)
        return found[first - low * self.block : past - low * self.block]


class FileReader:
    """Sections of a file by number, or by place."""

    def __init__(self, source):
        self.source = source
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of token ids")
        size, = SIZE.unpack(source.read(SIZE.size))
        self.code = Code(np.frombuffer(zlib.decompress(source.read(size)), np.uint8))

    def sections(self) -> list[tuple[int, int, int]]:
        end = self.source.size()
        self.source.seek(end - FOOTER.size)
        count, magic = FOOTER.unpack(self.source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no section table at the end of the file")
        self.source.seek(end - FOOTER.size - count * ENTRY.size)
        return list(ENTRY.iter_unpack(self.source.read(count * ENTRY.size)))

    def section(self, place: int, size: int) -> Section:
        self.source.seek(place)
        return Section(self.source.read(size), self.code)


def _written(folder: str, kind: str, lengths: np.ndarray, section_ids: int,
             batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = _filesystem(folder)
    task = TaskContext.get()
    name = f"ids-{task.partitionId():06d}-{task.taskAttemptId()}.bin"
    writer = sink = None
    for batch in batches:
        column = batch.column("ids")
        flat, at = _joined(column, kind), 0
        for doc_id, count in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), strict=True):
            if writer is None:
                sink = store.open_output_stream(f"{root}/{name}")
                writer = FileWriter(sink, Code(lengths), section_ids)
            # a copy, so that what waits for its section does not hold the whole batch
            writer.add(doc_id, flat[at : at + count].copy())
            at += count
    if writer is None:
        return
    writer.close()
    sink.close()
    places, sizes, firsts = zip(*writer.sections, strict=True)
    n_ids = [after - first for first, after in zip(firsts, [*firsts[1:], writer.ids_before], strict=True)]
    count = len(places)
    yield pa.RecordBatch.from_arrays(
        [pa.array([task.partitionId()] * count, pa.int64()), pa.array([name] * count),
         *(pa.array(list(c), pa.int64()) for c in (places, sizes, firsts, n_ids))],
        names=["file", "name", "place", "size", "first", "n_ids"])


def tokenised(docs: DataFrame, path: str, kind: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids) of every text, the end id included."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        lambda batches: _tokenised(path, kind, batches), TOKENS)


def write_files(docs: DataFrame, folder: str, path: str | None = None, section_ids: int = SECTION_IDS,
                file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all texts under `folder` and returns the index, one row per section."""
    path = path or vocabulary_path()
    symbols = _symbols(path)
    kind = "<u2" if symbols <= 1 << 16 else "<u4"
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    tokens = cut(tokenised(docs, path, kind))
    counts = np.zeros(symbols, np.int64)
    # at most one row per symbol
    for row in tokens.select("ids").mapInArrow(
            lambda batches: _counted(kind, symbols, batches), "id long, n long").groupBy("id").agg(
            F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    lengths = code_lengths(counts)
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(counts.sum()) // file_ids))
    # a repeated document id is ranged further by its contents, and equal rows by their number
    order = ["doc_id", "ids_crc32", "n_tokens", "_row"]
    ranged = tokens.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(files, *order)
    return cut(ranged.sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids").mapInArrow(
        lambda batches: _written(folder, kind, lengths, section_ids, batches), INDEX))


def _symbols(path: str) -> int:
    from tallyhouse.llm.packing import _tokenizer

    return max(_tokenizer(path).get_vocab().values()) + 1


def _read(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = _filesystem(folder)
    for name, rows in groupby((row for batch in batches for row in batch.to_pylist()), itemgetter("name")):
        with store.open_input_file(f"{root}/{name}") as source:
            reader = FileReader(source)
            yield from (_documents(reader.section(row["place"], row["size"]), row["base"] + row["first"]) for row in rows)


def _documents(section: Section, before: int) -> pa.RecordBatch:
    """The documents of a section that has `before` ids before it."""
    ids = memoryview(section.ids().astype("<u4").tobytes())
    ends = np.cumsum(section.counts)
    starts = ends - section.counts
    crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [section.doc_ids, pa.array(starts + before), pa.array(section.counts), pa.array(crcs, pa.int64())],
        names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(index: DataFrame, folder: str) -> DataFrame:
    """Every document of the files that the index names, with the number of ids before it."""
    spark = index.sparkSession
    sizes = index.groupBy("file").agg(F.sum("n_ids").alias("n"), F.count(F.lit(1)).alias("sections")).orderBy("file").collect()
    if not sizes:
        return spark.createDataFrame([], ROWS)
    bases = list(accumulate((row.n for row in sizes[:-1]), initial=0))
    files = spark.createDataFrame([(row.file, base) for row, base in zip(sizes, bases, strict=True)], "file long, base long")
    # sections are small rows that stand for much work: a stated number of partitions is not merged again
    tasks = max(len(sizes), sum(row.sections for row in sizes) // TASK_SECTIONS)
    dealt = index.join(files, "file").repartitionByRange(tasks, "file", "place").sortWithinPartitions("file", "place")
    return dealt.select("name", "place", "size", "first", "base").mapInArrow(lambda batches: _read(folder, batches), ROWS)


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes the files to a folder of the session's shared one and describes what is read back."""
    folder = f"{checkpoint_folder(docs.sparkSession).rstrip('/')}/ids-{uuid4().hex}"
    return read_files(write_files(docs, folder), folder)
