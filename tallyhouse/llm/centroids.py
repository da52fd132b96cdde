"""Centroid clustering of integer vectors; the nearest centroid is found by the threshold algorithm.

Every dimension keeps its centroid components sorted. From a vector's value both ways outward, each round takes
the next closer entry of every list; a centroid met for the first time gets its exact distance. The distances
from the vector to the entries that come next, squared and summed over the dimensions, bound every centroid not
met yet from below; the walk ends once that sum is strictly greater than the best exact distance, so that a tie
with a smaller number is never missed.

A round over all vectors is one map over the scan: each task walks its vectors and emits one row of sums per
centroid. What reaches the driver are `CLUSTERS` x `DIMENSIONS` sums, whatever the table holds, and the same
number of values goes to the tasks. All arithmetic is on whole numbers, so the order of the rows cannot matter.

Cases: a vector that is null, of another length, or holds a null or non-finite component is left out, and so is
one with a component of 2**18 or more, whose squared distances could pass 64 bits; repeated rows count as often as
they come; equal start hashes (repeated ids) go by the components, null ids start last; with fewer vectors than
clusters each vector starts one; an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import cut

CLUSTERS = 40
DIMENSIONS = 64
ROUNDS = 5
SCALE = 256
SEED = 2
#: whole-number components stay below this, so a sum of squared distances stays below 2**62 up to 64 dimensions
REACH = 1 << 26
#: vectors walked at once
BLOCK = 4096


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, parts): the usable vectors in whole numbers."""
    found = embeddings["embedding"]
    inside = F.forall(found, lambda x: F.coalesce(F.abs(x.cast("double")) < REACH // scale, F.lit(False)))
    return embeddings.filter((F.size(found) == dimensions) & inside).select(
        embeddings["vec_id"].cast("long").alias("vec_id"),
        F.transform(found, lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("parts"))


class SortedLists:
    """The centroids' components, sorted per dimension, with an unreachable entry at both ends."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.count, self.dimensions = centroids.shape
        order = np.argsort(centroids, axis=0, kind="stable").T
        ends = np.full((self.dimensions, 1), 3 * REACH)
        nobody = np.full((self.dimensions, 1), self.count)
        self.values = np.hstack([-ends, np.take_along_axis(centroids.T, order, 1), ends]).ravel()
        self.numbers = np.hstack([nobody, order, nobody]).ravel()
        self.rows = np.arange(self.dimensions) * (self.count + 2)  # where each list begins

    def _places(self, vectors: np.ndarray) -> np.ndarray:
        """Per vector and dimension, the first entry at or above the vector's value."""
        width = self.count + 2
        return np.stack([np.searchsorted(self.values[at : at + width], vectors[:, k]) + at
                         for k, at in enumerate(self.rows)], axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid; the smaller number among equal distances."""
        count = len(vectors)
        cluster, best = np.full(count, self.count), np.full(count, np.iinfo(np.int64).max)
        above = self._places(vectors)
        below = above - 1
        met = np.zeros((count, self.count + 1), bool)
        active = np.arange(count)
        while len(active):
            to_below, to_above = vectors - self.values[below], self.values[above] - vectors
            down = to_below <= to_above
            new = np.zeros_like(met)
            new[np.arange(len(active))[:, None], self.numbers[np.where(down, below, above)]] = True
            new &= ~met
            met |= new
            below -= down
            above += ~down
            for number in range(self.count):
                rows = np.flatnonzero(new[:, number])
                if not len(rows):
                    continue
                gaps = vectors[rows] - self.centroids[number]
                exact, at = np.einsum("ij,ij->i", gaps, gaps), active[rows]
                better = (exact < best[at]) | ((exact == best[at]) & (number < cluster[at]))
                best[at[better]], cluster[at[better]] = exact[better], number
            frontier = np.minimum(vectors - self.values[below], self.values[above] - vectors)
            go_on = (np.einsum("ij,ij->i", frontier, frontier) <= best[active]) & ~met[:, : self.count].all(axis=1)
            active, vectors, below, above, met = active[go_on], vectors[go_on], below[go_on], above[go_on], met[go_on]
        return cluster, best


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            flat = part.column("parts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield part.column("vec_id"), flat.reshape(part.num_rows, -1)


def _sums(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = SortedLists(centroids)
    sums, sizes = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    for _, vectors in _blocks(batches):
        cluster, _ = lists.nearest(vectors)
        sizes += np.bincount(cluster, minlength=len(sizes))
        for number in np.unique(cluster):
            sums[number] += vectors[cluster == number].sum(axis=0)
    used = np.flatnonzero(sizes)
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(sizes[used]), pa.array(list(sums[used]), pa.list_(pa.int64()))],
        names=["cluster", "size", "sums"])


def _nearest(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = SortedLists(centroids)
    for ids, vectors in _blocks(batches):
        cluster, distance = lists.nearest(vectors)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])


def starts(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hash of seed and id, in the order of that hash."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = vectors.orderBy(hashed.asc_nulls_last(), "parts").limit(clusters).select("parts").collect()
    return np.array([row.parts for row in first], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; one without vectors stays where it is."""
    partial = vectors.mapInArrow(
        lambda batches: _sums(centroids, batches), "cluster int, size long, sums array<long>")
    totals = partial.select("cluster", "size", F.posexplode("sums").alias("dimension", "part")).groupBy(
        "cluster", "dimension").agg(F.sum("part").alias("part"), F.sum("size").alias("size"))
    after = centroids.copy()
    for row in totals.collect():
        after[row.cluster, row.dimension] = row.part // row.size
    return after


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids, one row each; no row for an empty table."""
    centroids = starts(vectors, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    kind = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], kind)
    return vectors.mapInArrow(lambda batches: _nearest(centroids, batches), kind)


def clustering(embeddings: DataFrame) -> DataFrame:
    """Every vector with its cluster, distance, inertias and the digest of its centroid."""
    vectors = whole_vectors(embeddings)
    centroids = fit(vectors)
    placed = cut(assign(vectors, centroids))
    totals = {row.cluster: row.total for row in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("total")).collect()}
    described = embeddings.sparkSession.createDataFrame(
        [(number, total, hashlib.sha256(",".join(map(str, centroids[number])).encode()).hexdigest())
         for number, total in totals.items()], "cluster int, cluster_inertia long, centroid_sha256 string")
    # at most one row per cluster
    return placed.join(F.broadcast(described), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(totals.values())).cast("long").alias("inertia"),
        "centroid_sha256")
