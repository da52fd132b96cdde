"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

Fit: up to `LABELLED_PER_CLASS` labelled rows of each label (smallest hash of the id first) give a term
matrix, of letter-class trigrams, repetition shares and the presence of hashed words, the words of a text at unit length
together like its trigrams; a truncated SVD of it is the latent space. The space and the labelled vectors, at most
2 * LABELLED_PER_CLASS rows of `DIMENSIONS` numbers, are broadcast; nothing else is. Score: every
document is mapped to the space in blocks, its cosines with all labelled vectors are one matrix product, and
the `NEIGHBOURS` nearest vote with weights that rise with their similarity.

Only the text is an input of a score. Cases: null and empty texts are documents without words, which have a
coordinate of their own, and score like their nearest neighbours; texts of any length are read whole; ties between
neighbours go to the earlier labelled row; rows of `labels` with a null label or id, or without a document, are left out;
a repeated row counts as often as it comes; without any labelled row every score is 0.5; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.arrays import blocks
from tallyhouse.llm.features import SHARES, TRIGRAMS, style_and_words

LABELLED_PER_CLASS = 1500
DIMENSIONS = 48
NEIGHBOURS = 15
SHARPNESS = 8.0
SHARE_WEIGHT = 1.5
THRESHOLD = 0.3
#: texts whose dense term rows are held at once
ROWS = 256


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, terms): style features, then hashed words."""
    found = style_and_words(data, offsets)
    words = found[:, TRIGRAMS + SHARES :]
    words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-9)
    return found


@dataclass(frozen=True)
class Space:
    """Term weights, the latent directions, and the labelled vectors with their labels."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, terms: np.ndarray) -> np.ndarray:
        latent = (terms * self.weights) @ self.directions
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(terms), 0.5)
        cosines = self.embed(terms) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        nearest = np.argsort(-cosines, axis=1, kind="stable")[:, :k]
        weights = np.exp(SHARPNESS * (np.take_along_axis(cosines, nearest, 1).astype(np.float64) - 1))
        return np.clip((weights * self.labels[nearest]).sum(1) / weights.sum(1), 0, 1)


def fit_space(terms: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, shares: slice = slice(-4, None)) -> Space:
    """Truncated SVD of the weighted term matrix by subspace iteration from a fixed start."""
    if not len(terms):
        return Space(np.zeros(0, np.float32), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), labels)
    present = (terms > 0).sum(0)
    weights = np.log((1 + len(terms)) / (1 + present)).astype(np.float32) + 0.2
    weights[shares] = SHARE_WEIGHT
    weighted = terms * weights
    k = min(dimensions, *weighted.shape)
    basis = np.random.Generator(np.random.PCG64(11)).standard_normal((weighted.shape[1], k)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    space = Space(weights, basis.astype(np.float32), np.zeros((0, k), np.float32), labels)
    return Space(weights, space.directions, space.embed(terms), labels)


def labelled_sample(labels: DataFrame, label: str, per_class: int) -> list[tuple[int, int]]:
    """(doc_id, label) of at most `per_class` rows of each label, held-out rows excluded."""
    usable = labels.filter(labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"]))
    usable = usable.select("doc_id", F.col(label).cast("int").alias("label"))
    rows = []
    for value in (0, 1):
        rows += usable.filter(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    return [(r.doc_id, r.label) for r in rows]


SPARSE = pa.schema([("doc_id", pa.int64()), ("at", pa.binary()), ("value", pa.binary())])


def sparse_rows(features, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, positions, values) of the features of each text, as packed 32-bit numbers."""
    for batch in batches:
        for first, past, data, offsets in blocks(batch.column(1)):
            rows = []
            for k, row in enumerate(features(data, offsets)):
                at = np.flatnonzero(row)
                rows.append({"doc_id": batch.column(0)[first + k].as_py(), "at": at.astype(np.int32).tobytes(),
                             "value": row[at].astype(np.float32).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=SPARSE)


def sample_features(docs: DataFrame, ids: list[int], features) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Features of the documents with the given ids, whose number the caller bounds; eight bytes each at the driver."""
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(i,) for i in sorted(set(ids))], "doc_id long"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).join(wanted, "doc_id", "left_semi")
    found = rows.mapInArrow(lambda batches: sparse_rows(features, batches), "doc_id long, at binary, value binary")
    return {r.doc_id: (np.frombuffer(r.at, np.int32), np.frombuffer(r.value, np.float32)) for r in found.collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = LABELLED_PER_CLASS) -> Space:
    chosen = labelled_sample(labels, label, per_class)
    found = sample_features(docs, [i for i, _ in chosen], text_terms) if chosen else {}
    chosen = [(i, value) for i, value in chosen if i in found]
    terms = np.zeros((len(chosen), text_terms(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]), np.float32)
    for row, (doc_id, _) in enumerate(chosen):
        at, values = found[doc_id]
        terms[row, at] = values
    return fit_space(terms, np.array([value for _, value in chosen], np.float64), shares=slice(TRIGRAMS, TRIGRAMS + SHARES))


def score(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, past, data, offsets in blocks(batch.column(1)):
                for at in range(0, past - first, ROWS):
                    some = offsets[at : at + ROWS + 1]
                    out[first + at : first + at + len(some) - 1] = shared.value.scores(text_terms(data[some[0] : some[-1]], some - some[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    scored = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
