from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tallyhouse.operators.intervals import overlapping

START = datetime(1997, 1, 1, 23, 59, 59)
ROWS = "k string, a timestamp_ntz, b timestamp_ntz, id int"


def _brute(rows):
    found = []
    for k, a, b, i in rows:
        earlier = [(y or datetime.max) for key, x, y, j in rows if key == k and x is not None and a is not None and (x, j) < (a, i)]
        if earlier and a < max(earlier):
            found.append(i)
    return sorted(found)


def test_a_nested_interval_behind_a_short_one_is_found(spark):
    day = timedelta(days=1)
    rows = [("m", START + a * day, START + b * day, i) for i, (a, b) in enumerate([(1, 10), (2, 3), (4, 5), (10, 12), (12, 13)])]
    got = overlapping(spark.createDataFrame(rows, ROWS), ["k"], "a", "b", "id")
    assert sorted(r.id for r in got.collect()) == [1, 2] == _brute(rows)
    assert got.columns == ["k", "a", "b", "id"]


@pytest.mark.parametrize("unit", [1, 500_000, 86_400_000_000 // 2])
def test_overlaps_equal_all_pairs(spark, unit):
    rng = random.Random(unit)
    rows = []
    for i in range(250):
        a = START + timedelta(microseconds=unit * rng.randint(0, 120))
        b = rng.choice([None, *[a + timedelta(microseconds=unit * rng.choice([0, 1, 2, 2, 60]))] * 30])
        rows.append((rng.choice([None, *"abcdef"]), a, b, i))
    rows += [("a", None, START, 900), ("z", START, None, 901)]
    got = overlapping(spark.createDataFrame(rows, ROWS).repartition(5), ["k"], "a", "b", "id")
    assert sorted(r.id for r in got.collect()) == _brute(rows)


def test_one_key_with_very_many_intervals(spark):
    """Half a million intervals of one key in a row, a second apart; every thousandth reaches into the next."""
    step = "cast(timestamp_ntz '1997-01-01' as timestamp_ntz) + make_dt_interval(0, 0, 0, id"
    frame = spark.range(0, 500_000, 1, 16).selectExpr(
        "'m' AS k", f"{step}) AS a", f"{step} + if(id % 1000 = 0, 2, 1)) AS b", "CAST(id AS INT) AS id")
    found = overlapping(frame, ["k"], "a", "b", "id")
    assert found.count() == 500
    assert found.filter("id % 1000 <> 1").count() == 0
