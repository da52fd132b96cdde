"""Last event of a key at or before a probe's time, among those known by the probe's own cutoff.

The event with the greatest time `<= t` and known time `<= c` is a two-dimensional dominance question, and every
probe brings its own pair (t, c). It is cut into one-dimensional ones:

1. the instants of a key's events are numbered in rising order, and a probe learns how many lie at or before it;
2. a prefix of that many numbers is a union of blocks of 1, 2, 4 ... numbers, one per binary one of the count; an event
   belongs to one block per size, and only the even ones are ever asked for;
3. per block, the running maximum over known time gives the last event known by each cutoff asked for;
4. the best of a probe's blocks is its answer, and the event's columns are joined back once.

A key with n events costs n log n / 2 small rows, so a key without revisions pays little. No window spans a whole key
or block: sums and maxima run over the instants of a second, the seconds of a day and the days of a key, so
each window is bounded by the calendar for every key alike. What several steps read (the slim events and probes, the
numbers, the blocks) is written to the shared checkpoint folder once, so building the plan runs these jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.blocks import stack
from tallyhouse.session import staged

Fold = Callable[[Column], Column]


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def _beside(df: DataFrame, other: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join on equally named columns; the other side is unique on them."""
    renamed = other.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in other.columns])
    return df.join(renamed, _same(on, [f"__r_{c}" for c in on]), how).drop(*[f"__r_{c}" for c in on])


def running(rows: DataFrame, keys: Sequence[str], ts: str, value: str, fold: Fold, inclusive: bool = True) -> DataFrame:
    """`value` folded over the rows of the same keys up to each `ts`, or before it; rows are unique on (keys, ts).

    `fold` is `F.sum` or `F.max`; NULL values count nothing.
    """
    rows = rows.withColumn("__second", F.date_trunc("second", ts))
    second, day = [*keys, "__second"], [*keys, "__day"]

    def before(groups: Sequence[str], *order: str) -> Column:
        return fold(F.col("__part")).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)).alias("__part")

    # what a day and a second start with goes through the next window as a row of its own, ahead of theirs
    seconds = rows.groupBy(*second).agg(fold(F.col(value)).alias("__part")).withColumn("__day", F.date_trunc("day", "__second"))
    days = rows.groupBy(*keys, F.date_trunc("day", "__second").alias("__day")).agg(fold(F.col(value)).alias("__part"))
    of_days = days.select(*day, before(keys, "__day")).filter("__part IS NOT NULL").withColumn("__second", F.col("__day"))
    of_seconds = stack(seconds.withColumn("__turn", F.lit(1)), of_days.withColumn("__turn", F.lit(0))).select(
        *second, "__turn", before(day, "__second", "__turn")).filter("__turn = 1 AND __part IS NOT NULL")
    starts = of_seconds.select(*second, F.col("__second").alias(ts), F.lit(0).alias("__turn"), F.col("__part").alias(value))
    both = stack(rows.withColumn("__turn", F.lit(1)), starts)
    folded = fold(F.col(value)).over(
        Window.partitionBy(*second).orderBy(ts, "__turn").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    found = both.withColumn(value, F.coalesce(folded, F.lit(0)) if fold is F.sum else folded)
    return found.filter("__turn = 1").drop("__second", "__turn")


def last_known_before(
    probes: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    probe_ts: str,
    cutoff: str,
    event_ts: str,
    known_ts: str,
    tiebreak: Sequence[str],
    name: str = "found",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Probes with the struct `name` of the last event at or before `probe_ts` known at or before `cutoff`.

    `tiebreak` orders events of one instant, the greatest wins; of full ties the one known first stands for
    all. NULL keys equal each other. An event without a time or known time never counts, a probe without time or
    cutoff finds nothing. The struct holds the event's `columns`, all if not given.
    """
    cell = [f"__k{i}" for i in range(len(keys))]

    def keyed(df: DataFrame, *columns: Column) -> DataFrame:
        return df.select(*[F.col(k).alias(c) for k, c in zip(keys, cell, strict=True)], *columns)

    tie = F.struct(*(tiebreak or [F.lit(0).alias("none")])).alias("__tie")
    dated = events.filter(F.col(event_ts).isNotNull() & F.col(known_ts).isNotNull())
    marks = staged(keyed(dated, F.col(event_ts).alias("__ts"), tie, F.col(known_ts).alias("__known")).groupBy(
        *cell, "__ts", "__tie").agg(F.min("__known").alias("__known")))
    asked = staged(keyed(probes.filter(F.col(probe_ts).isNotNull() & F.col(cutoff).isNotNull()),
                         F.col(probe_ts).alias("__ts"), F.col(cutoff).alias("__cut")).distinct())

    # 1. numbers of the instants
    instants = marks.select(*cell, "__ts", F.lit(1).alias("__n")).unionByName(
        asked.select(*cell, "__ts", F.lit(0).alias("__n"))).groupBy(*cell, "__ts").agg(F.max("__n").cast("long").alias("__n"))
    # how many there are decides the largest block
    sizes = instants.groupBy(*cell).agg(F.sum("__n").alias("__all"))
    numbered = staged(_beside(running(instants, cell, "__ts", "__n", F.sum), sizes, cell))

    # 2. blocks of events and probes
    event_blocks = _beside(marks, numbered, [*cell, "__ts"]).withColumn("__level", F.explode(F.expr(
        "filter(sequence(0, length(bin(__all)) - 1), b -> shiftright(__n - 1, b) % 2 = 0)"))).select(
        *cell, "__level", F.expr("shiftright(__n - 1, __level)").alias("__block"), F.col("__known").alias("__at"),
        F.struct("__ts", "__tie").alias("__pick"))
    probe_blocks = _beside(asked, numbered, [*cell, "__ts"]).filter("__n > 0").withColumn("__level", F.explode(F.expr(
        "filter(sequence(0, length(bin(__n)) - 1), b -> shiftright(__n, b) % 2 = 1)"))).select(
        *cell, "__ts", "__cut", "__level", F.expr("shiftright(__n, __level) - 1").alias("__block"))

    # 3. the last event of a block known by each cutoff asked for
    block = [*cell, "__level", "__block"]
    steps = staged(event_blocks.unionByName(
        probe_blocks.select(*block, F.col("__cut").alias("__at")), allowMissingColumns=True).groupBy(
        *block, "__at").agg(F.max("__pick").alias("__pick")))
    best = running(steps, block, "__at", "__pick", F.max)

    # 4. the best block of a probe
    pieces = _beside(probe_blocks.withColumnRenamed("__cut", "__at"), best, [*block, "__at"])
    answers = pieces.groupBy(*cell, "__ts", F.col("__at").alias("__cut")).agg(F.max("__pick").alias("__pick")).filter("__pick IS NOT NULL")
    whole = keyed(dated, F.struct(F.col(event_ts).alias("__ts"), tie).alias("__pick"), F.col(known_ts).alias("__known"),
                  F.struct(*(columns or events.columns)).alias("__event")).groupBy(*cell, "__pick").agg(F.min_by("__event", "__known").alias(name))
    resolved = _beside(answers, whole, [*cell, "__pick"]).select(*cell, "__ts", "__cut", name)
    here = [*[F.col(k).eqNullSafe(F.col(c)) for k, c in zip(keys, cell, strict=True)],
            F.col(probe_ts) == F.col("__ts"), F.col(cutoff) == F.col("__cut")]
    return probes.join(resolved, reduce(and_, here), "left").select(*[probes[c] for c in probes.columns], name)
