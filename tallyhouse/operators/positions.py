"""Places in a total order, without sorting in one task."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.session import staged

_PLACE_BITS = 33  # of a monotonically increasing id; its partition's number lies above


def with_positions(df: DataFrame, order_by: Sequence[str], descending: Collection[str] = (), name: str = "position") -> DataFrame:
    """The rows with their place in the order, from 0.

    Rows are ranged and sorted inside their ranges, then written once with their place there; a range starts
    behind the rows of all ranges before it, one number per range. NULLs come first, behind falling columns last; ties
    are ordered by the remaining columns, rising.
    """
    order = [F.col(f"`{c}`").desc_nulls_last() if c in descending else F.col(f"`{c}`").asc_nulls_first()
             for c in [*order_by, *[c for c in df.columns if c not in order_by]]]
    ranged = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _PLACE_BITS)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()
    starts = accumulate((row.n for row in sizes), initial=0)
    before = df.sparkSession.createDataFrame(
        [(row["__part"], start) for row, start in zip(sizes, starts)], "__part long, __before long")
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return ranged.withColumn("__part", part).join(before, "__part").select(
        *[F.col(f"`{c}`") for c in df.columns], place.alias(name))
