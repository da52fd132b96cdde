"""Connected components of a link table, by repeated joins of bounded rows.

Each round sends, for every node, its smallest known label along all links (hash-to-min), then follows labels of
labels (pointer jumping), so chains shorten at least by half. Rounds are written to the shared checkpoint folder. Links are thinned
first: inside each task a union-find keeps one spanning forest of the links it sees.

Cases: links may repeat, be given one way round, or join a node with itself; nodes without a link do not appear.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import cut

FOREST_LINKS = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of every `FOREST_LINKS` links: at most as many links, the same components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def out() -> pa.RecordBatch:
        rows = [(x, root(x)) for x in list(parent) if root(x) != x]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["src", "dst"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= FOREST_LINKS:
            yield out()
            parent = {}
    yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of each component, for every node of `links` (two long columns)."""
    src, dst = links.columns
    plain = links.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).filter("src <> dst")
    forest = cut(plain.mapInArrow(_forest, "src long, dst long"))
    both = cut(forest.union(forest.select("dst", "src")).toDF("src", "dst").distinct())
    labels = cut(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("root")).withColumnRenamed("src", "node"))
    while True:
        sent = both.join(labels, both["dst"] == labels["node"]).groupBy("src").agg(F.min("root").alias("near"))
        joined = labels.join(sent, labels["node"] == sent["src"], "left").select(
            "node", "root", F.least("root", F.coalesce("near", "root")).alias("best"))
        # a label is itself a node: take over its label
        up = labels.select(F.col("node").alias("best"), F.col("root").alias("jump"))
        moved = cut(joined.join(up, "best", "left").select(
            "node", F.least("best", F.coalesce("jump", "best")).alias("next"), "root"))
        changed = moved.filter("next <> root").limit(1).count()
        labels = moved.select("node", F.col("next").alias("root"))
        if not changed:
            return labels
