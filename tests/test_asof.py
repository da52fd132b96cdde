"""The as-of operator against brute force, with ties, one dominant key, NULL keys and NULL instants."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.asof import last_before, previous_row

START = datetime(1997, 1, 1)


def data(seed: int):
    rng = random.Random(seed)

    def moment():
        # few distinct instants: within a second, across seconds and across days
        return START + timedelta(days=rng.choice([0, 0, 1, 3]), seconds=rng.randrange(4), milliseconds=rng.choice([0, 1, 999]))

    keys = [1, 1, 1, 1, 2, 3]
    events = [(rng.choice(keys), moment(), f"t{i:03d}", rng.random() < 0.5) for i in range(60)]
    probes = [(rng.choice(keys + [4]), moment(), i) for i in range(60)]
    return events, probes


def expected(events, probes, inclusive, known_only):
    found = []
    for key, ts, number in probes:
        fits = [
            (ets, name) for k, ets, name, known in events
            if k == key and (ets <= ts if inclusive else ets < ts) and (known or not known_only)
        ]
        found.append((number, max(fits)[1] if fits else None))
    return sorted(found)


@pytest.mark.parametrize("inclusive", [True, False])
def test_last_before_equals_brute_force(spark, inclusive):
    events, probes = data(7)
    e = spark.createDataFrame(events, "k int, ets timestamp_ntz, name string, known boolean")
    p = spark.createDataFrame(probes, "k int, pts timestamp_ntz, n int")
    got = last_before(p, e, ["k"], "pts", "ets", ["name"], {"any": None, "known": F.col("known")}, inclusive)
    rows = got.select("n", "any.name", F.col("known.name").alias("known")).collect()
    assert sorted((r[0], r[1]) for r in rows) == expected(events, probes, inclusive, False)
    assert sorted((r[0], r[2]) for r in rows) == expected(events, probes, inclusive, True)


def test_previous_row(spark):
    df = spark.createDataFrame([(1, START, "a"), (1, START + timedelta(days=2), "b"), (1, START + timedelta(days=9), "c"), (2, START, "d")], "k int, ts timestamp_ntz, v string")
    got = previous_row(df, ["k"], "ts", ["v"]).select("v", "previous.v").collect()
    assert sorted(map(tuple, got)) == [("a", None), ("b", "a"), ("c", "b"), ("d", None)]


@pytest.mark.parametrize("instants", [1, 100_000])
def test_one_key_with_many_rows(spark, instants):
    ids = spark.range(100_000)
    events = ids.select(F.lit(1).alias("k"), (F.lit(START) + F.make_dt_interval(secs=F.col("id") % instants)).alias("ets"), F.col("id").alias("e"))
    probes = ids.select(F.lit(1).alias("k"), (F.lit(START) + F.make_dt_interval(secs=F.col("id"))).alias("pts"), F.col("id").alias("n"))
    got = last_before(probes, events, ["k"], "pts", "ets", ["e"], {"hit": None})
    wrong = got.filter(~F.col("hit.e").eqNullSafe(F.col("n") if instants > 1 else F.lit(99_999)))
    assert got.count() == 100_000 and wrong.count() == 0


def test_null_keys_and_instants(spark):
    events = spark.createDataFrame([(None, START, "a"), (1, None, "b")], "k int, ts timestamp_ntz, v string")
    probes = spark.createDataFrame([(None, START, 1), (1, START, 2), (None, None, 3)], "k int, ts timestamp_ntz, n int")
    got = last_before(probes, events, ["k"], "ts", "ts", ["v"], {"hit": None})
    assert got.columns == ["k", "ts", "n", "hit"]
    assert sorted((r.n, r.hit and r.hit.v) for r in got.collect()) == [(1, "a"), (2, None), (3, None)]


def test_events_cross_few_shuffles_and_no_join(spark):
    events = spark.range(10).select((F.col("id") % 2).alias("k"), (F.lit(START) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"), "id")
    got = last_before(events, events, ["k"], "ts", "ts", [], {"hit": None, "odd": F.col("id") % 4 > 1}, columns=["id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3 and "Join" not in plan
    assert sorted((r.id, r.hit.id, r.odd and r.odd.id) for r in got.collect()) == [
        (0, 0, None), (1, 1, None), *[(i, i, i - i % 4 + 2 + i % 2 if i % 4 > 1 else i - 2) for i in range(2, 10)]]


def test_probes_carry_key_and_instant_once_and_keep_their_types(spark):
    events = spark.createDataFrame([(1, START, "a")], "k bigint, ts timestamp_ntz, v string")
    probes = spark.createDataFrame([(1, START, 1), (None, None, 2)], "k int, ts timestamp_ntz, n int")
    got = last_before(probes, events, ["k"], "ts", "ts", ["v"], {"hit": None})
    assert got.dtypes[:3] == [("k", "int"), ("ts", "timestamp_ntz"), ("n", "int")]
    carried = re.findall(r"struct\((\w+), [^)]*\) AS __probe", got._jdf.queryExecution().analyzed().toString())
    assert set(carried) == {"n"}
    assert sorted((r.n, r.k, r.hit and r.hit.v) for r in got.collect()) == [(1, 1, "a"), (2, None, None)]
    bare = last_before(probes.select("k", "ts"), events, ["k"], "ts", "ts", ["v"], {"hit": None})
    assert bare.columns == ["k", "ts", "hit"] and bare.count() == 2
