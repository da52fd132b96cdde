"""Intervals of a key that begin before an earlier one has ended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.bitemporal import running

OPEN_END = "9999-12-31"


def overlapping(df: DataFrame, keys: Sequence[str], start: str, end: str, tiebreak: str) -> DataFrame:
    """The rows [start, end) that begin before the end of any earlier row of their keys; a NULL end is open.

    Earlier is by start, then `tiebreak`. The greatest end so far is a running maximum over calendar cells, so a key
    may have any number of intervals, and an interval nested in a much earlier one is found; only the
    rows of one key and instant share a window. A row without a start overlaps nothing.
    """
    dated = df.filter(F.col(start).isNotNull()).withColumn("__end", F.coalesce(F.col(end), F.lit(OPEN_END).cast("timestamp_ntz")))
    ends = dated.groupBy(*keys, F.col(start).alias("__start")).agg(F.max("__end").alias("__before"))
    earlier = running(ends, keys, "__start", "__before", F.max, inclusive=False)
    named = earlier.select(*[F.col(k).alias(f"__{k}") for k in keys], "__start", "__before")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    beside = Window.partitionBy(*keys, start).orderBy(tiebreak).rowsBetween(Window.unboundedPreceding, -1)
    joined = dated.withColumn("__beside", F.max("__end").over(beside)).join(named, [*same, F.col(start) == F.col("__start")], "left")
    return joined.filter(F.col(start) < F.greatest("__before", "__beside")).select(*df.columns)
