from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import calendar, money


def test_month_edges_follow_daylight_saving():
    assert calendar.month_start(1997, 4) == datetime(1997, 4, 1, 8)  # DST began on 6 April 1997
    assert calendar.month_start(1997, 5) == datetime(1997, 5, 1, 7)
    assert calendar.month_start(2025, 4) == datetime(2025, 4, 1, 7)
    assert calendar.month_periods(1997, 12, 12)[0].end == datetime(1998, 1, 1, 8)


def test_column_form_agrees_with_driver_form(spark):
    days = [date(1997, 1, 15), date(1997, 4, 6), date(1997, 7, 1), date(2025, 11, 2)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").select("d", calendar.local_midnight_utc(F.col("d")).alias("t")).collect()
    assert [r["t"] for r in rows] == [calendar.local_midnight(d) for d in days]


def test_local_month(spark):
    df = spark.createDataFrame([(datetime(1997, 6, 1, 6, 59),), (datetime(1997, 6, 1, 7),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(calendar.local_month(F.col("t"))).collect()] == ["1997-05", "1997-06"]


def test_label_is_half_open_and_rejects_overlap(spark):
    periods = calendar.month_periods(1997, 5, 6)
    edges = [periods[0].start, periods[1].start, periods[1].end]
    df = spark.createDataFrame([(t,) for t in edges], "t timestamp_ntz")
    assert [r[0] for r in df.select(calendar.label_of(F.col("t"), periods)).collect()] == ["1997-05", "1997-06", None]
    with pytest.raises(ValueError):
        calendar.label_of(F.col("t"), [periods[0], calendar.Period("x", periods[0].start, periods[1].end)])


def test_ratio_rounds_half_up_and_is_null_for_zero(spark):
    rows = [(Decimal(57), Decimal(800)), (Decimal(1), Decimal(3)), (Decimal(1), Decimal(0)), (Decimal(1), None)]
    df = spark.createDataFrame(rows, "n decimal(19,4), d decimal(19,4)")
    got = [r[0] for r in df.select(money.safe_ratio(F.col("n"), F.col("d"))).collect()]
    assert got == [Decimal("0.0713"), Decimal("0.3333"), None, None]


def test_annual_amount_counts_a_twelfth(spark):
    df = spark.createDataFrame([(Decimal(1200), "annual"), (Decimal(50), "monthly")], "a decimal(19,4), i string")
    assert [r[0] for r in df.select(money.monthly_amount(F.col("a"), F.col("i"))).collect()] == [100, 50]


def test_total_of_nothing_is_zero(spark):
    df = spark.createDataFrame([], "a decimal(19,4)")
    assert df.agg(money.total(F.col("a"))).collect()[0][0] == 0
