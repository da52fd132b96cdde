"""Relational building blocks the metric plans are composed of.

Shapes chosen for large, skewed inputs:

* owners are tested by semi join on their primary key, so a fact row is never multiplied;
* "latest per key" and "state as of" are aggregates (`max_by`), so map tasks reduce a hot key
  to one row before the shuffle, and several instants share one pass;
* facts at different grains are stacked with `union` and aggregated once, instead of being
  aggregated one by one and joined: a key present in only one of them survives by itself;
* periods are labelled by expression, never by a range join, and dense output comes from
  exploding one aggregated row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Period, instant, label_of, span_of


def visible(df: DataFrame, cutoff: datetime, *columns: str) -> DataFrame:
    """Rows known at the cutoff by every given time column (default `recorded_at`)."""
    for column in columns or ("recorded_at",):
        df = df.filter(F.col(column) <= instant(cutoff))
    return df


def real(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_test"))


def owned_by(df: DataFrame, owner: DataFrame, key: str, owner_key: str | None = None) -> DataFrame:
    """Keep rows whose owner exists in `owner`; the owner key must be unique or merely tested."""
    keys = owner.select(F.col(owner_key or key).alias(key))
    return df.join(keys, key, "left_semi")


def exclude_test_chain(
    df: DataFrame,
    owners: Sequence[tuple[DataFrame, str]] = (),
    optional: Sequence[tuple[DataFrame, str]] = (),
) -> DataFrame:
    """Drop test rows and rows with a test (or missing) owner.

    An `optional` owner may be absent; only a test owner that is present drops the row.
    """
    df = real(df)
    for owner, key in owners:
        df = owned_by(df, real(owner), key)
    for owner, key in optional:
        tests = owner.filter("is_test").select(key)
        df = df.join(tests, key, "left_anti")
    return df


def valid_at(ts: Column, start: Column, end: Column) -> Column:
    """ts in [start, end), where a NULL end is open."""
    return (start <= ts) & (end.isNull() | (ts < end))


def inline_rows(spark: SparkSession, schema: str, rows: Sequence[Sequence[str]]) -> DataFrame:
    """A literal table. Cells are text and are cast to the schema's types."""
    fields = [part.split() for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(cell).cast(kind).alias(name) for cell, (name, kind) in zip(row, fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def period_rows(spark: SparkSession, periods: Sequence[Period]) -> DataFrame:
    """Periods as a table (label, period_start, period_end)."""
    return inline_rows(
        spark,
        "label string, period_start timestamp_ntz, period_end timestamp_ntz",
        [(p.label, str(p.start), str(p.end)) for p in periods],
    )


def bucket_by_period(df: DataFrame, ts: str, periods: Sequence[Period], label: str = "period") -> DataFrame:
    """Rows inside one of the disjoint periods, with its label."""
    inside = span_of(list(periods)).holds(F.col(ts))
    return df.filter(inside).withColumn(label, label_of(F.col(ts), list(periods))).filter(
        F.col(label).isNotNull()
    )


def stack(*frames: DataFrame) -> DataFrame:
    """Union by name; a column one branch lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def dense_by_period(
    df: DataFrame,
    label: str,
    periods: Sequence[Period],
    measures: Mapping[str, Callable[[Column], Column]],
    keys: Sequence[str] = (),
    period_column: str = "report_month",
) -> DataFrame:
    """One row per (key, period), also for periods without a fact.

    Each measure is a function from "row is in this period" to an aggregate; all periods are
    aggregated side by side and then unfolded, so no grid has to be joined.
    """
    wide = []
    for i, period in enumerate(periods):
        here = F.col(label) == period.label
        wide.append(
            F.struct(
                F.lit(period.label).alias(period_column),
                *[make(here).alias(name) for name, make in measures.items()],
            ).alias(f"__p{i}")
        )
    grouped = df.groupBy(*keys).agg(*wide)
    return grouped.select(*keys, F.inline(F.array(*[f"__p{i}" for i in range(len(periods))])))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The row with the greatest `order` per key (columns: keys, then `columns`)."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")


def earliest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    best = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")


def states_at(ts: str, tiebreak: str, as_ofs: Sequence[datetime], columns: Sequence[str]) -> list[Column]:
    """Aggregates, one per instant: the struct of the last event strictly before it."""
    return [
        F.max_by(F.struct(*columns), F.when(F.col(ts) < instant(at), F.struct(ts, tiebreak))) for at in as_ofs
    ]


def state_as_of(
    events: DataFrame,
    key: Sequence[str],
    ts: str,
    tiebreak: str,
    as_ofs: Mapping[str, datetime],
    columns: Sequence[str],
    label: str = "as_of",
) -> DataFrame:
    """The last event strictly before each instant, per key, for all instants in one pass.

    Returns (label, key, columns); a key without an earlier event gives no row.
    """
    latest_needed = max(as_ofs.values())
    picks = [
        pick.alias(f"__s{i}") for i, pick in enumerate(states_at(ts, tiebreak, list(as_ofs.values()), columns))
    ]
    snapshots = F.array(
        *[
            F.struct(F.lit(name).alias(label), F.col(f"__s{i}").alias("__state"))
            for i, name in enumerate(as_ofs)
        ]
    )
    return (
        events.filter(F.col(ts) < instant(latest_needed))
        .groupBy(*key)
        .agg(*picks)
        .select(*key, F.inline(snapshots))
        .filter(F.col("__state").isNotNull())
        .select(label, *key, "__state.*")
    )


def net_by_instant(events: DataFrame, key: Sequence[str], ts: str, tiebreak: str,
                   before: Sequence[str], after: Sequence[str]) -> DataFrame:
    """Several changes of one key at one instant as one net change: first state before, last after."""
    first, last = F.min_by(F.struct(*before), tiebreak), F.max_by(F.struct(*after), tiebreak)
    netted = events.groupBy(*key, ts).agg(first.alias("__before"), last.alias("__after"))
    return netted.select(*key, ts, "__before.*", "__after.*")


def latest_revision(df: DataFrame, keys: Sequence[str], order: Sequence[str], cutoff: datetime,
                    columns: Sequence[str], seen: Sequence[str] = ("recorded_at",)) -> DataFrame:
    """Filter by visibility first, then take the highest revision."""
    return latest(visible(df, cutoff, *seen), keys, order, columns)


def key_union_join(frames: Sequence[DataFrame], keys: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    """All keys of several aggregated frames side by side, gaps filled; keys unique per frame."""
    columns = [c for frame in frames for c in frame.columns if c not in keys]
    stacked = stack(*frames)
    merged = stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns])
    return merged.select(
        *keys, *[F.coalesce(c, F.lit(fill[c])).alias(c) if c in fill else F.col(c) for c in columns]
    )


def complete_rows(df: DataFrame, required: DataFrame, keys: Sequence[str], fill: Mapping[str, Column]) -> DataFrame:
    """`df` (unique on its keys) plus the required key rows it lacks, with the given measures.

    One grouping over both, so that `df` is not evaluated a second time for an anti join.
    """
    rows = stack(df.withColumn("__have", F.lit(True)), required.select(*keys))
    merged = rows.groupBy(*keys).agg(F.max("__have").alias("__have"), *[F.max(c).alias(c) for c in fill])
    filled = [F.when(F.col("__have"), F.col(c)).otherwise(value).alias(c) for c, value in fill.items()]
    return merged.select(*keys, *filled)


def append_total(df: DataFrame, name: str, label: str, totals: Mapping[str, Column]) -> DataFrame:
    """A grand-total row last; present with its neutral values even when `df` is empty."""
    total_row = df.agg(*[value.alias(c) for c, value in totals.items()])
    detail = df.select(name, *totals, F.lit(0).alias("sort_order"))
    return detail.unionByName(
        total_row.select(F.lit(label).alias(name), *totals, F.lit(1).alias("sort_order"))
    )


def pivot_change(df: DataFrame, keys: Sequence[str], label: str, periods: tuple[Period, Period],
                 measures: Mapping[str, str], sums: Mapping[str, Column]) -> DataFrame:
    """Two periods of each summed measure side by side plus second minus first.

    `measures` maps an output name pattern with `{p}` to the name of its change column;
    `sums` maps the same pattern to the summed expression.
    """
    first, second = periods
    aggregates = []
    for pattern in measures:
        for period in periods:
            amount = F.when(F.col(label) == period.label, sums[pattern])
            aggregates.append(
                F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(19,4)").alias(pattern.format(p=period.label))
            )
    wide = df.groupBy(*keys).agg(*aggregates)
    changes = {
        change: (F.col(pattern.format(p=second.label)) - F.col(pattern.format(p=first.label))).cast("decimal(19,4)")
        for pattern, change in measures.items()
    }
    return wide.withColumns(changes)


def conditions_met(cohort: DataFrame, key: str, start: str, end: str, events: DataFrame,
                   names: Sequence[str]) -> DataFrame:
    """How many of the named conditions each cohort member met inside its own [start, end).

    `events` is (key, condition_name, happened_at). Events are reduced to those inside a
    member's window and stacked under the members, so a member without events counts 0 and the
    many events of one member are combined map-side.
    """
    met = (
        events.join(cohort.select(key, start, end), key)
        .filter((F.col("happened_at") >= F.col(start)) & (F.col("happened_at") < F.col(end)))
        .select(key, "condition_name")
    )
    flags = [F.max(F.when(F.col("condition_name") == n, 1).otherwise(0)) for n in names]
    carried = [c for c in cohort.columns if c != key]
    return stack(cohort.withColumn("__member", F.lit(1)), met).groupBy(key).agg(
        *[F.max(c).alias(c) for c in carried],
        reduce(lambda a, b: a + b, flags).alias("condition_count"),
    )


def share_of_total(amount: str, keys: Sequence[str]) -> Column:
    """amount's group total, for small aggregated results."""
    return F.sum(amount).over(Window.partitionBy(*keys))


def bounded(df: DataFrame, max_rows: int, max_bytes: int | None = None) -> list:
    """Collect a result that must be small; fails instead of truncating. Bytes are those of its rows as JSON text."""
    size = F.octet_length(F.to_json(F.struct(*[df[f"`{c}`"] for c in df.columns]), {"ignoreNullFields": "false"}))
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), size.alias("size")).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"result has more than {max_rows} rows")
    if max_bytes is not None and sum(r["size"] for r in rows) > max_bytes:
        raise ValueError(f"result is larger than {max_bytes} bytes")
    return [r["row"] for r in rows]
