from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import month_periods
from tallyhouse.operators import blocks


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_visible_needs_every_time(spark):
    df = spark.createDataFrame([(1, datetime(1997, 1, 1), datetime(1997, 1, 3)), (2, datetime(1997, 1, 1), None)], "k int, a timestamp_ntz, b timestamp_ntz")
    assert rows(blocks.visible(df, datetime(1997, 1, 3), "a", "b").select("k")) == [(1,)]
    assert blocks.visible(df, datetime(1997, 1, 2), "b").count() == 0


def test_test_owner_drops_a_row_and_an_absent_optional_owner_does_not(spark):
    facts = spark.createDataFrame([(1, 1, None, False), (2, 2, None, False), (3, 1, 9, False), (4, 1, None, True), (5, 7, None, False)], "id int, o int, c int, is_test boolean")
    owners = spark.createDataFrame([(1, False), (2, True)], "o int, is_test boolean")
    campaigns = spark.createDataFrame([(9, True)], "c int, is_test boolean")
    kept = blocks.exclude_test_chain(facts, [(owners, "o")], [(campaigns, "c")])
    assert rows(kept.select("id")) == [(1,)]


def test_state_as_of_is_strictly_before_and_ranks_before_filtering(spark):
    events = spark.createDataFrame(
        [(1, 1, datetime(1997, 1, 1), "active"), (1, 2, datetime(1997, 2, 1), "cancelled"), (1, 3, datetime(1997, 2, 1), "paused"), (2, 4, datetime(1997, 3, 1), "active")],
        "k int, id int, ts timestamp_ntz, status string",
    )
    at = {"a": datetime(1997, 1, 1), "b": datetime(1997, 2, 1), "c": datetime(1997, 2, 2)}
    got = rows(blocks.state_as_of(events, ["k"], "ts", "id", at, ["status"]))
    assert got == [("b", 1, "active"), ("c", 1, "paused")]  # the greater id wins a tie


def test_latest_revision_filters_visibility_first(spark):
    df = spark.createDataFrame([(1, 1, datetime(1997, 1, 1), 5), (1, 2, datetime(1997, 1, 9), 7)], "k int, v int, recorded_at timestamp_ntz, x int")
    assert rows(blocks.latest_revision(df, ["k"], ["v"], datetime(1997, 1, 5), ["x"])) == [(1, 5)]
    assert rows(blocks.latest_revision(df, ["k"], ["v"], datetime(1997, 1, 9), ["x"])) == [(1, 7)]


def test_dense_series_keeps_empty_periods_even_without_input(spark):
    periods = month_periods(1997, 5, 6)
    df = spark.createDataFrame([("1997-06", 4)], "period string, x int")
    measures = {"n": lambda here: F.count_if(here), "s": lambda here: F.sum(F.when(here, F.col("x")))}
    assert rows(blocks.dense_by_period(df, "period", periods, measures)) == [("1997-05", 0, None), ("1997-06", 1, 4)]
    assert rows(blocks.dense_by_period(df.limit(0), "period", periods, measures)) == [("1997-05", 0, None), ("1997-06", 0, None)]


def test_total_row_exists_on_empty_input(spark):
    df = spark.createDataFrame([], "name string, x bigint")
    got = blocks.append_total(df, "name", "TOTAL", {"x": F.coalesce(F.sum("x"), F.lit(0))})
    assert rows(got) == [("TOTAL", 0, 1)]


def test_key_union_fills_gaps(spark):
    a = spark.createDataFrame([("x", 1)], "k string, a int")
    b = spark.createDataFrame([("y", 2)], "k string, b int")
    assert rows(blocks.key_union_join([a, b], ["k"], {"a": 0, "b": 0})) == [("x", 1, 0), ("y", 0, 2)]


def test_required_rows_are_added_once(spark):
    have = spark.createDataFrame([("x", 5)], "k string, v int")
    need = spark.createDataFrame([("x",), ("z",)], "k string")
    assert rows(blocks.complete_rows(have, need, ["k"], {"v": F.lit(0)})) == [("x", 5), ("z", 0)]


def test_conditions_count_once_per_kind_inside_the_window(spark):
    t = lambda d: datetime(1997, 1, d)
    cohort = spark.createDataFrame([(1, t(1), t(15)), (2, t(1), t(15))], "k int, a timestamp_ntz, b timestamp_ntz")
    events = spark.createDataFrame([(1, "p", t(1)), (1, "p", t(2)), (1, "q", t(15)), (3, "p", t(2))], "k int, condition_name string, happened_at timestamp_ntz")
    got = blocks.conditions_met(cohort, "k", "a", "b", events, ["p", "q"]).select("k", "condition_count")
    assert rows(got) == [(1, 1), (2, 0)]


def test_bounded_fails_instead_of_cutting(spark):
    df = spark.range(5)
    assert len(blocks.bounded(df, 5)) == 5
    with pytest.raises(ValueError):
        blocks.bounded(df, 4)
    with pytest.raises(ValueError):
        blocks.bounded(df, 5, max_bytes=3)


def test_changes_of_one_instant_are_netted(spark):
    t = datetime(1997, 1, 1)
    events = spark.createDataFrame([(1, t, 1, 50, 80), (1, t, 2, 80, 60), (1, datetime(1997, 1, 2), 3, 60, 0)], "k int, ts timestamp_ntz, id int, b int, a int")
    assert rows(blocks.net_by_instant(events, ["k"], "ts", "id", ["b"], ["a"]).select("b", "a")) == [(50, 60), (60, 0)]
