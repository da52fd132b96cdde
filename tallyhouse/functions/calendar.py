"""Business periods: half-open, cut at local midnight of the business zone, stored as UTC."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

BUSINESS_ZONE = "America/Los_Angeles"


def local_midnight(day: date, zone: str = BUSINESS_ZONE) -> datetime:
    """The naive UTC instant at which the local day starts."""
    local = datetime(day.year, day.month, day.day, tzinfo=ZoneInfo(zone))
    return local.astimezone(timezone.utc).replace(tzinfo=None)


def month_start(year: int, month: int, zone: str = BUSINESS_ZONE) -> datetime:
    return local_midnight(date(year, month, 1), zone)


def instant(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def day(value: date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def local_month(ts: Column, zone: str = BUSINESS_ZONE) -> Column:
    """yyyy-MM of a naive UTC instant in the business zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), ts), "yyyy-MM")


def local_midnight_utc(local_day: Column, zone: str = BUSINESS_ZONE) -> Column:
    """Column form of `local_midnight`, daylight saving included."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local_day.cast("timestamp_ntz"))


@dataclass(frozen=True)
class Period:
    """One labelled half-open span [start, end) of instants or of dates."""

    label: str
    start: datetime | date
    end: datetime | date

    def holds(self, ts: Column) -> Column:
        literal = instant if isinstance(self.start, datetime) else day
        return (ts >= literal(self.start)) & (ts < literal(self.end))


def month_periods(year: int, first: int, last: int) -> list[Period]:
    return [
        Period(f"{year}-{m:02d}", month_start(year, m), next_month_start(year, m))
        for m in range(first, last + 1)
    ]


def next_month_start(year: int, month: int) -> datetime:
    return month_start(year + month // 12, month % 12 + 1)


def span_of(periods: list[Period]) -> Period:
    """The envelope of some periods; used as the pushed-down filter before labelling."""
    return Period("span", min(p.start for p in periods), max(p.end for p in periods))


def label_of(ts: Column, periods: list[Period]) -> Column:
    """Label of the (disjoint) period that holds ts, else NULL. No join, stays in codegen."""
    ordered = sorted(periods, key=lambda p: p.start)
    for before, after in zip(ordered, ordered[1:]):
        if after.start < before.end:
            raise ValueError(f"periods {before.label} and {after.label} overlap")
    labelled = F.lit(None).cast("string")
    for period in periods:
        labelled = F.when(period.holds(ts), F.lit(period.label)).otherwise(labelled)
    return labelled


@dataclass(frozen=True)
class Params:
    """Named parameters of the metric plans, all derived from one report year.

    `snapshot_cutoff` decides which facts were known; `activation_as_of` which cohorts are
    mature; `history_start` since when touches were collected.
    """

    year: int
    snapshot_cutoff: datetime
    activation_as_of: datetime
    history_start: datetime

    def month(self, number: int) -> datetime:
        return month_start(self.year, number) if number <= 12 else month_start(self.year + 1, number - 12)

    def month_day(self, number: int) -> date:
        return date(self.year, number, 1)

    def months(self, first: int, last: int) -> list[Period]:
        return month_periods(self.year, first, last)

    def quarter(self, number: int, label: str | None = None) -> Period:
        first = 3 * number - 2
        return Period(label or f"q{number}", self.month(first), self.month(first + 3))

    def quarter_days(self, number: int, label: str | None = None) -> Period:
        first = 3 * number - 2
        return Period(label or f"q{number}", self.month_day(first), self.month_day(first + 3))

    def month_days(self, number: int) -> Period:
        return Period(f"{self.year}-{number:02d}", self.month_day(number), self.month_day(number + 1))


def half_year_params(year: int, cutoff_days: int = 14) -> Params:
    """Reports on January to June, seen two weeks after the half-year ended."""
    end = month_start(year, 7)
    return Params(
        year=year,
        snapshot_cutoff=end + timedelta(days=cutoff_days),
        activation_as_of=end,
        history_start=local_midnight(date(year, 4, 8)),
    )
