"""Last event at or before a probe, per key, without an unbounded group.

A running `last` over (key, time) would put a whole key into one task. Instead time is cut into
hours, for every key alike:

1. events are cut to one row per (key, hour), combined before the shuffle;
2. a running last over the hours of a key gives what each hour starts with;
3. events, probes and these starts meet once by (key, hour), where a running last answers the probes.

So events and probes are shuffled once as they are, the cut events twice, and nothing is joined back.
Nothing is counted or written while the plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.blocks import stack


def last_before(
    probes: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    probe_ts: str,
    event_ts: str,
    tiebreak: Sequence[str],
    picks: Mapping[str, Column | None],
    inclusive: bool = True,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Probes with one struct column per pick: the last event that meets the pick's condition.

    `tiebreak` orders events of one instant, the greatest wins. A pick condition of None means
    every event. With `inclusive`, an event at the probe's own instant counts. NULL keys equal
    each other; an event without an instant never counts, a probe without one finds nothing.
    The structs hold the event's `columns`, all if not given.
    """
    names = list(picks)
    cell = [f"__k{i}" for i in range(len(keys))]
    hour = [*cell, "__hour"]

    def keyed(df: DataFrame, ts: str, *more: Column) -> DataFrame:
        own = [F.col(k).alias(c) for k, c in zip(keys, cell, strict=True)]
        return df.select(*own, F.date_trunc("hour", ts).alias("__hour"), F.col(ts).alias("__ts"), *more)

    # turns at one instant: what the hour starts with, then events and probes
    event_turn, probe_turn = (1, 2) if inclusive else (2, 1)
    event_rows = keyed(
        events.filter(F.col(event_ts).isNotNull()), event_ts, F.lit(event_turn).alias("__turn"),
        F.struct(*(tiebreak or [F.lit(0).alias("none")])).alias("__tie"),
        F.struct(*(columns or events.columns)).alias("__event"),
        *[(F.lit(True) if c is None else c).alias(f"__is_{n}") for n, c in picks.items()],
    )
    # the key and the instant of a probe stand beside it already
    beside = dict(zip([*keys, probe_ts], [*cell, "__ts"], strict=True))
    carried = [c for c in probes.columns if c not in beside]
    probe_rows = keyed(probes, probe_ts, F.lit(probe_turn).alias("__turn"), F.struct(*(carried or [F.lit(0).alias("none")])).alias("__probe"))
    starts = _hour_starts(event_rows, probe_rows.select(*hour), cell, names)
    rows = stack(event_rows, probe_rows, starts.withColumns({"__ts": F.col("__hour"), "__turn": F.lit(0)}))
    # an event crosses the shuffle once, however many picks it meets
    picked = rows.repartition(*hour).select(
        *hour, "__ts", "__turn", "__tie", "__probe", *[F.coalesce(n, F.when(F.col(f"__is_{n}"), F.col("__event"))).alias(n) for n in names])
    upto = Window.partitionBy(*hour).orderBy("__ts", "__turn", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    found = picked.select(*cell, "__ts", "__probe", *[F.last(n, ignorenulls=True).over(upto).alias(n) for n in names]).filter("__probe IS NOT NULL")
    # events may have widened the types of what stands beside
    return found.select(*[F.col(beside[f.name]).cast(f.dataType).alias(f.name) if f.name in beside else F.col("__probe")[f.name].alias(f.name)
                          for f in probes.schema], *names)


def _hour_starts(event_rows: DataFrame, asked: DataFrame, cell: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(cell, __hour, picks) of the asked hours that follow an event: the last event before each."""
    own = event_rows.select(
        *cell, "__hour", F.struct("__ts", "__tie").alias("__at"), *[F.when(F.col(f"__is_{n}"), F.col("__event")).alias(n) for n in names])
    hours = stack(own, asked.withColumn("__asked", F.lit(True))).groupBy(*cell, "__hour").agg(
        F.max("__asked").alias("__asked"), *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col("__at"))).alias(n) for n in names])
    earlier = Window.partitionBy(*cell).orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    starts = hours.select(*cell, "__hour", "__asked", *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in names])
    return starts.filter(F.col("__asked") & reduce(or_, [F.col(n).isNotNull() for n in names])).drop("__asked")


def previous_row(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str]) -> DataFrame:
    """Each row with the struct `previous` of the last row strictly earlier, per key."""
    slim = df.select(*dict.fromkeys([*keys, ts, *columns]))
    return last_before(df, slim, keys, ts, ts, [], {"previous": None}, inclusive=False)
