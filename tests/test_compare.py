from __future__ import annotations

import itertools
import random
from datetime import datetime
from decimal import Decimal

import pytest

from tallyhouse.operators import compare as C

SCHEMA = "k int, v string"


def verdict(df):
    (row,) = df.collect()
    return row["failure_code"]


def frames(spark, a, b, schema=SCHEMA):
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


@pytest.mark.parametrize("order", [None, ["k"]])
def test_stages_come_in_order(spark, order):
    base = spark.createDataFrame([(1, "a"), (2, None)], SCHEMA)
    assert verdict(C.compare(base, base, order)) is None
    assert verdict(C.compare(base.select("k"), base, order and ["k"])) == C.COLUMN_COUNT
    assert verdict(C.compare(base.withColumnRenamed("v", "w"), base, order)) == C.COLUMN_NAME
    assert verdict(C.compare(base.select("v", "k"), base, order)) == C.COLUMN_ORDER
    assert verdict(C.compare(base.limit(1), base, order)) == C.ROW_COUNT
    assert verdict(C.compare(base.fillna("x"), base, order)) == C.NULLS
    assert verdict(C.compare(base.withColumn("k", base.k.cast("decimal(10,0)")), base, order)) == C.TYPES


def test_multiset_counts_duplicates(spark):
    a, b = frames(spark, [(1, "a"), (1, "a"), (2, "b")], [(1, "a"), (2, "b"), (2, "b")])
    assert verdict(C.compare(a, b)) == C.MULTISET
    a, b = frames(spark, [(1, "a"), (2, "b")], [(2, "b"), (1, "a")])
    assert verdict(C.compare(a, b)) is None


def test_decimal_scale_matters_and_floats_are_refused(spark):
    a = spark.createDataFrame([(Decimal("1.0"),)], "x decimal(5,1)")
    b = spark.createDataFrame([(Decimal("1.00"),)], "x decimal(5,2)")
    assert verdict(C.compare(a, b)) == C.MULTISET
    with pytest.raises(TypeError):
        C.compare(spark.createDataFrame([(1.0,)], "x double"), b).collect()


def positional(a, b):
    """The code at the first differing position of two sorted row lists."""
    key = lambda row: tuple((x is not None, x if x is not None else 0) for x in row)
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        for p, q in zip(x, y):
            if p != q:
                return C.NULLS if None in (p, q) else C.VALUES
    return None


def test_ordered_code_is_that_of_the_first_differing_position(spark):
    rng = random.Random(3)
    cells = [None, 1, 2, 3]
    universe = list(itertools.product(cells, cells))
    for _ in range(12):
        a = [rng.choice(universe) for _ in range(5)]
        b = [rng.choice(a) if rng.random() < 0.5 else rng.choice(universe) for _ in range(5)]
        x, y = frames(spark, a, b, "k int, v int")
        assert verdict(C.compare(x, y, ["k", "v"])) == positional(a, b), (a, b)


def test_descending_order(spark):
    # descending by k: position 1 is (3, null) against (3, "a"), ascending it would be (1, "x") against (2, "y")
    a, b = frames(spark, [(3, None), (1, "x")], [(3, "a"), (2, "y")])
    assert verdict(C.compare(a, b, ["k"], descending=["k"])) == C.NULLS
    assert verdict(C.compare(a, b, ["k"])) == C.VALUES


def test_digest_ignores_order_and_sees_duplicates(spark):
    digest = lambda rows: tuple(C.digest(spark.createDataFrame(rows, SCHEMA)).collect()[0])
    assert digest([(1, "a"), (2, None)]) == digest([(2, None), (1, "a")])
    assert digest([(1, "a")]) != digest([(1, "a"), (1, "a")])
    assert digest([(1, None)]) != digest([(1, "null")])


def test_decode_keeps_to_the_declared_form(spark):
    df = spark.createDataFrame([("5", "1.5000", "1997-01-01T00:00:00.000000", "true", "s"), (None,) * 5], "a string, b string, c string, d string, e string")
    kinds = {"a": "integer", "b": "decimal", "c": "datetime", "d": "boolean", "e": "string"}
    assert tuple(C.decode(df, kinds).collect()[0]) == (5, Decimal("1.5"), datetime(1997, 1, 1), True, "s")
    for name, bad in [("a", "x"), ("c", "1997-01-01 00:00:00"), ("d", "yes")]:
        with pytest.raises(Exception, match="not a"):
            C.decode(df.na.replace(df.head()[name], bad, name), kinds).collect()
    with pytest.raises(ValueError):
        C.decode(df, {"a": "integer"})


def test_rollups(spark):
    results = spark.createDataFrame([("a", "PASS"), ("b", "PASS"), ("c", "FAIL_RESULT")], "case_id string, status string")
    counts = {r["status"]: r["cases"] for r in C.suite_rollup(results).collect()}
    assert counts == {s: 0 for s in C.STATUSES} | {"PASS": 2, "FAIL_RESULT": 1}


def test_response_gaps(spark):
    expected = spark.createDataFrame([("a", "execute_sql"), ("b", "deferred"), ("c", "execute_sql")], "case_id string, action string")
    answers = spark.createDataFrame([("a",), ("b",), ("z",)], "case_id string")
    assert sorted(map(tuple, C.response_gaps(expected, answers).collect())) == [("b", "forbidden"), ("c", "missing"), ("z", "unknown")]


def test_rows_meet_by_digests_that_tell_cells_apart(spark):
    a, b = frames(spark, [("1:x", "y"), ("", None)], [("1:x", "y"), (None, "")], "u string, v string")
    found = C.compare(a, b)
    assert verdict(found) == C.TYPES
    assert "cells" not in found._jdf.queryExecution().executedPlan().toString()
    for left, right in [(("ab", "c"), ("a", "bc")), (("a1:b", ""), ("a", "1:b")), (("1", "11:1"), ("11:1", "1"))]:
        assert verdict(C.compare(*frames(spark, [left], [right], "u string, v string"))) == C.MULTISET


def test_ordered_rows_meet_by_digests_and_share_places(spark):
    a, b = frames(spark, [(1, "a"), (2, "b"), (3, "c")], [(1, "a"), (2, None), (3, "d")])
    placed = {}
    found = C.compare(a, b, ["k"], placed=placed)
    assert verdict(found) == C.NULLS
    assert "cells" not in found._jdf.queryExecution().optimizedPlan().toString()
    first = dict(placed)
    assert verdict(C.compare(b, b, ["k"], placed=placed)) is None and placed == first
