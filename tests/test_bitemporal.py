from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.bitemporal import last_known_before, running

START = datetime(1997, 3, 30, 23, 59, 58)
EVENTS = "k string, at timestamp_ntz, known timestamp_ntz, id string, payload int"
PROBES = "k string, t timestamp_ntz, cut timestamp_ntz, n int"


def _moment(rng, spread):
    """Instants that often meet: within a second, a day or several days."""
    return START + timedelta(microseconds=rng.choice([1, 250_000, 1_000_000, 3_600_000_000, 86_400_000_000]) * rng.randint(0, spread))


def _rows(seed):
    rng = random.Random(seed)
    keys = [None, "a", "a", "a", "a", "b", "c"]
    events = [(rng.choice(keys), _moment(rng, 6), None, f"e{rng.randint(0, 400):03d}", i) for i in range(220)]
    events = [(k, at, at + timedelta(seconds=rng.choice([0, 1, 60, 200_000, 900_000])), i, n) for k, at, _, i, n in events]
    events += [("a", None, START, "x", 0), ("a", START, None, "z", 0)]
    probes = [(rng.choice([*keys, "none"]), _moment(rng, 8), _moment(rng, 12), i) for i in range(300)]
    return events, probes + probes[:5] + [("a", None, START, -1), ("a", START, None, -2)]


def _brute(events, probes):
    out = []
    for k, t, cut, n in probes:
        best = max(((at, i) for key, at, known, i, _ in events if key == k and at and known and t and cut and at <= t and known <= cut), default=None)
        out.append((k, t, cut, n, best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_last_known_equals_brute_force(spark, seed):
    events, probes = _rows(seed)
    got = last_known_before(
        spark.createDataFrame(probes, PROBES).repartition(3), spark.createDataFrame(events, EVENTS).repartition(4),
        ["k"], "t", "cut", "at", "known", ["id"], "hit")
    rows = sorted([(r.k, r.t, r.cut, r.n, (r.hit["at"], r.hit["id"]) if r.hit else None) for r in got.collect()], key=repr)
    assert rows == _brute(events, probes)
    assert got.columns == ["k", "t", "cut", "n", "hit"]


def test_full_ties_give_the_one_known_first(spark):
    day = timedelta(days=1)
    events = [("a", START, START + 2 * day, "e", 2), ("a", START, START + day, "e", 1), ("a", START, START + 3 * day, "e", 3)]
    probes = [("a", START, START + k * day, k) for k in range(4)]
    got = last_known_before(spark.createDataFrame(probes, PROBES), spark.createDataFrame(events, EVENTS), ["k"], "t", "cut", "at", "known", ["id"])
    assert {r.n: r.found and r.found["payload"] for r in got.collect()} == {0: None, 1: 1, 2: 1, 3: 1}


def test_nothing_asked_and_nothing_known(spark):
    events, probes = _rows(3)
    none_asked = last_known_before(spark.createDataFrame([], PROBES), spark.createDataFrame(events, EVENTS), ["k"], "t", "cut", "at", "known", ["id"])
    none_known = last_known_before(spark.createDataFrame(probes, PROBES), spark.createDataFrame([], EVENTS), ["k"], "t", "cut", "at", "known", ["id"])
    assert none_asked.collect() == []
    assert [r.found for r in none_known.collect()] == [None] * len(probes)


def test_running_maximum_and_sum(spark):
    rng = random.Random(5)
    rows = {(rng.choice("ab"), _moment(rng, 40)): rng.choice([None, 1, 2, 7, 9]) for _ in range(300)}
    frame = spark.createDataFrame([(k, at, v) for (k, at), v in rows.items()], "k string, at timestamp_ntz, v long")
    for fold, plain, nothing in ((F.sum, sum, 0), (F.max, max, None)):
        got = {(r.k, r["at"]): r.v for r in running(frame, ["k"], "at", "v", fold).collect()}
        want = {}
        for key, at in rows:
            seen = [v for (k, a), v in rows.items() if k == key and a <= at and v is not None]
            want[key, at] = plain(seen) if seen else nothing
        assert got == want


def test_no_window_spans_a_key(spark):
    """Each window partition is cut by the calendar, or has one row per day of the key."""
    frame = spark.createDataFrame([], "k string, at timestamp_ntz, v long")
    plan = running(frame, ["k"], "at", "v", F.sum)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if line.strip(" :+-").startswith("Window")]
    assert len(windows) == 3
    for line in windows:
        assert "__second" in line or "__day" in line


def test_running_folds_without_a_join(spark):
    frame = spark.range(9).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 1800).cast("timestamp_ntz").alias("at"), "id")
    found = running(frame, ["k"], "at", "id", F.sum)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 5
    assert sorted(r.id for r in found.collect()) == [0, 1, 3, 6, 10, 15, 21, 28, 36]
