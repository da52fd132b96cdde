from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import compare as C
from tallyhouse.operators import suite as S
from tallyhouse.operators.positions import with_positions


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_follow_the_order(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b", "Z"])) for _ in range(200)] + [(5, "x")] * 60
    frame = spark.createDataFrame(rows, "`k.1` int, v string").repartition(partitions)

    def nulls_first(x):
        return (x is not None, x if x is not None else 0)

    def placed(**how):
        return [tuple(r)[:2] for r in sorted(with_positions(frame, ["k.1"], **how).collect(), key=lambda r: r.position)]

    up = sorted(rows, key=lambda r: (nulls_first(r[0]), (r[1] is not None, r[1] or "")))
    assert placed() == up
    down = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), (r[1] is not None, r[1] or "")))
    assert placed(descending=["k.1"]) == down
    found = with_positions(frame, ["k.1"], name="n")
    assert sorted(r.n for r in found.collect()) == list(range(len(rows)))
    assert found.columns == ["k.1", "v", "n"]
    assert with_positions(frame.limit(0), ["k.1"]).collect() == []


KINDS = ["integer", "decimal", "string"]


def _cell(rng):
    return ("null", None) if rng.random() < 0.2 else (rng.choice(KINDS[: rng.choice([1, 1, 3])]), rng.choice("12"))


def _brute(mode, ours, theirs):
    """The stated comparison, row by row; rows are lists of (kind, text) in order."""
    if len(ours) != len(theirs):
        return C.ROW_COUNT
    if mode == S.ORDERED:
        for a, b in zip(ours, theirs, strict=True):
            for x, y in zip(a, b, strict=True):
                if x[0] != y[0]:
                    return C.NULLS if "null" in (x[0], y[0]) else C.TYPES
                if x[1] != y[1]:
                    return C.VALUES
        return None
    if Counter(ours) == Counter(theirs):
        return None
    shapes = [Counter(tuple(k for k, _ in row) for row in side) for side in (ours, theirs)]
    nulls = [Counter(sum(k == "null" for k, _ in row) for row in side) for side in (ours, theirs)]
    return C.MULTISET if shapes[0] == shapes[1] else C.NULLS if nulls[0] != nulls[1] else C.TYPES


def test_a_thousand_cases_equal_one_by_one(spark):
    rng = random.Random(11)
    cases, responses, actual, expected, want = [], [], [], [], {}
    for number in range(1000):
        case, mode = f"c{number:04d}", rng.choice([S.ORDERED, S.UNORDERED])
        theirs = [tuple(_cell(rng) for _ in range(2)) for _ in range(rng.randint(0, 5))]
        ours = list(theirs)
        if ours and rng.random() < 0.6:
            ours[rng.randrange(len(ours))] = tuple(_cell(rng) for _ in range(2))
        if rng.random() < 0.3:
            rng.shuffle(ours)
        if rng.random() < 0.1:
            ours.append((("integer", "1"), ("null", None)))
        cases.append((case, S.EXECUTE, None, mode, ["a", "b"]))
        responses.append((case, S.EXECUTE, None, None, None, ["a", "b"]))
        actual += [(case, k, list(row)) for k, row in enumerate(ours)]
        expected += [(case, k, list(row)) for k, row in enumerate(theirs)]
        want[case] = _brute(mode, ours, theirs)
    report = S.suite_report(
        spark.createDataFrame(cases, S.CASES), spark.createDataFrame(responses, S.RESPONSES),
        spark.createDataFrame(actual, S.ROWS).repartition(5), spark.createDataFrame(expected, S.ROWS).repartition(3)).collect()
    assert {r.case_id: r.failure_code for r in report} == want
    assert {r.status for r in report if r.failure_code} == {"FAIL_RESULT"}
    assert set(want.values()) == {None, C.ROW_COUNT, C.NULLS, C.TYPES, C.VALUES, C.MULTISET}
    for row in report:
        if row.status == "PASS":
            assert row.expected_digest == row.actual_digest
        elif row.failure_code in (C.ROW_COUNT, C.MULTISET):
            assert row.expected_digest != row.actual_digest


def test_earlier_stages_come_first(spark):
    columns = ["a", "b"]
    ways = {
        "deferred": ((S.DEFERRED, None, columns), None),
        "silent": ((S.EXECUTE, None, columns), None),
        "asked": ((S.CLARIFY, "x", None), (S.CLARIFY, "x", None, None, None)),
        "asked_other": ((S.CLARIFY, "x", None), (S.CLARIFY, None, None, None, None)),
        "ran": ((S.CLARIFY, "x", None), (S.EXECUTE, None, ["Z"], "BOOM", columns)),
        "asked_back": ((S.EXECUTE, None, columns), (S.CLARIFY, "x", None, None, None)),
        "structure": ((S.EXECUTE, None, columns), (S.EXECUTE, None, ["ODD", "EXTRA_TABLE", "PARSE_ERROR"], "BOOM", None)),
        "execution": ((S.EXECUTE, None, columns), (S.EXECUTE, None, [], "BOOM", None)),
        "no_columns": ((S.EXECUTE, None, columns), (S.EXECUTE, None, None, None, None)),
        "count": ((S.EXECUTE, None, columns), (S.EXECUTE, None, None, None, ["a"])),
        "name": ((S.EXECUTE, None, columns), (S.EXECUTE, None, None, None, ["a", "c"])),
        "order": ((S.EXECUTE, None, columns), (S.EXECUTE, None, None, None, ["b", "a"])),
        "good": ((S.EXECUTE, None, columns), (S.EXECUTE, None, None, None, columns)),
    }
    cases = [(name, action, code, S.ORDERED, c) for name, ((action, code, c), _) in ways.items()]
    answers = [(name, *answer) for name, (_, answer) in ways.items() if answer]
    empty = spark.createDataFrame([], S.ROWS)
    rows = S.suite_report(spark.createDataFrame(cases, S.CASES), spark.createDataFrame(answers, S.RESPONSES), empty, empty).collect()
    assert {r.case_id: (r.status, r.failed_stage, r.failure_code) for r in rows} == {
        "deferred": ("NOT_EVALUATED", None, S.NOT_BUILT), "silent": ("NOT_EVALUATED", None, S.NO_RESPONSE),
        "asked": ("PASS", None, None), "asked_other": ("FAIL_ACTION", "action", S.OTHER_CLARIFICATION),
        "ran": ("FAIL_ACTION", "action", S.WANTED_CLARIFICATION), "asked_back": ("FAIL_ACTION", "action", S.WANTED_SQL),
        "structure": ("FAIL_STRUCTURE", "structure", "PARSE_ERROR"), "execution": ("FAIL_EXECUTION", "execution", "BOOM"),
        "no_columns": ("FAIL_RESULT", "comparison", C.COLUMN_NAME), "count": ("FAIL_RESULT", "comparison", C.COLUMN_COUNT),
        "name": ("FAIL_RESULT", "comparison", C.COLUMN_NAME), "order": ("FAIL_RESULT", "comparison", C.COLUMN_ORDER),
        "good": ("PASS", None, None)}
    secondary = {r.case_id: r.secondary_codes for r in rows}
    assert secondary.pop("structure") == ["EXTRA_TABLE", "ODD"]
    assert set(map(tuple, secondary.values())) == {()}


def test_delta_and_reviews_look_at_every_digest(spark):
    kind = "case_id string, x string, y string"
    old = spark.createDataFrame([("a", "1", "1"), ("b", "1", "1"), ("c", "1", "1"), ("gone", "1", "1")], kind)
    new = spark.createDataFrame([("a", "1", "1"), ("b", "1", "2"), ("c", "3", "1"), ("new", "1", "1")], kind)
    changes = S.delta(old, new, ["x", "y"])
    assert {r.case_id: (r.changed, r.is_new, r.is_gone) for r in changes.collect()} == {
        "a": (False, False, False), "b": (True, False, False), "c": (True, False, False), "new": (False, True, False), "gone": (False, False, True)}
    seen = changes.filter("case_id IN ('b', 'c')").withColumn("new_y", F.when(F.col("case_id") == "c", "9").otherwise(F.col("new_y")))
    reviewed = seen.select("case_id", "old_x", "old_y", "new_x", "new_y", F.lit("why").alias("change_reason"), F.array(F.lit("s")).alias("scenario_ids"))
    found = {r.case_id: tuple(r)[1:] for r in S.reviews(changes, reviewed, ["x", "y"]).collect()}
    assert found["b"] == ("why", ["s"], "matches_reviewed")
    assert found["c"] == found["a"] == (None, [], "review_required")


def test_suite_is_written_in_order_and_read_back(spark, tmp_path):
    rows = [(2, "b"), (None, "c"), (1, None), (2, "a")]
    frame = spark.createDataFrame(rows, "k int, v string").repartition(3)
    S.write_suite({"up": frame, "free": frame.limit(1)}, str(tmp_path / "s"), {"up": ["k"]})
    back = S.read_suite(spark, str(tmp_path / "s")).collect()
    up = sorted((r.position, tuple(c.text for c in r.cells)) for r in back if r.case_id == "up")
    assert up == [(0, (None, "c")), (1, ("1", None)), (2, ("2", "a")), (3, ("2", "b"))]
    assert [(r.position, r.columns) for r in back if r.case_id == "free"] == [(None, ["k", "v"])]


def test_only_fingerprints_of_rows_are_dealt(spark, capsys):
    cases = spark.createDataFrame([("a", S.EXECUTE, None, S.ORDERED, ["x"]), ("b", S.EXECUTE, None, S.UNORDERED, ["x"])], S.CASES)
    answers = spark.createDataFrame([(c, S.EXECUTE, None, None, None, ["x"]) for c in "ab"], S.RESPONSES)
    side = [(c, k, [("string", "long text" * 100)]) for c in "ab" for k in range(20)]
    other = [(c, 19 - k if c == "b" else k, cells) for c, k, cells in side]
    report = S.suite_report(cases, answers, spark.createDataFrame(side, S.ROWS), spark.createDataFrame(other, S.ROWS))
    report.explain("formatted")
    dealt = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", capsys.readouterr().out)
    assert dealt and not [columns for columns in dealt if "cells#" in columns]
    assert [(r.case_id, r.status, r.expected_digest == r.actual_digest) for r in report.orderBy("case_id").collect()] == [
        ("a", "PASS", True), ("b", "PASS", True)]
