"""A whole suite of result comparisons in one job, one report row per case.

All cases of a suite lie in the same tables: what is expected of a case, what was answered, and the rows of both
sides as (case_id, position, cells) with cells as (kind, fixed text). Rows meet once by (case, position) as
fingerprints, so the work is dealt by row and one large case is spread like many small ones; only what differs goes
on, to its place where the order counts and to its cells where it does not, and each further grouping holds kinds of rows, not rows.

A case fails at its earliest stage: action, structure, execution, then columns, row count and cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.blocks import stack
from tallyhouse.operators.compare import (
    COLUMN_COUNT, COLUMN_NAME, COLUMN_ORDER, MULTISET, NULLS, ROW_COUNT, TYPES, VALUES, _cells, first_difference,
)
from tallyhouse.operators.positions import with_positions

# Actions, modes, and the failure codes of the stages before the comparison.
EXECUTE, CLARIFY, DEFERRED = "execute_sql", "request_clarification", "deferred"
ORDERED, UNORDERED = "ordered", "unordered"
WANTED_SQL, WANTED_CLARIFICATION = "EXPECTED_EXECUTE_SQL", "EXPECTED_REQUEST_CLARIFICATION"
OTHER_CLARIFICATION = "CLARIFICATION_CODE_MISMATCH"
NOT_BUILT, NO_RESPONSE = "DEFERRED_SCHEMA_DEPENDENCY", "MISSING_RESPONSE"
# structure codes, the most telling first
STRUCTURE_CODES = (
    "PARSE_ERROR", "MULTIPLE_STATEMENTS", "FORBIDDEN_DML", "FORBIDDEN_DDL", "FORBIDDEN_COMMAND", "NON_QUERY_STATEMENT",
    "FORBIDDEN_FILE_OPERATION", "FORBIDDEN_LOCKING_CLAUSE", "FORBIDDEN_FUNCTION", "FORBIDDEN_USER_VARIABLE",
    "FORBIDDEN_SYSTEM_SCHEMA", "UNKNOWN_TABLE", "MISSING_REQUIRED_TABLE", "EXTRA_TABLE", "WILDCARD_SELECT",
    "UNKNOWN_BIND_PARAMETER",
)

CASES = "case_id string, expected_action string, clarification_code string, mode string, columns array<string>"
RESPONSES = (
    "case_id string, action string, clarification_code string, structure_codes array<string>, execution_code string, "
    "columns array<string>"
)
ROWS = "case_id string, position long, cells array<struct<kind: string, text: string>>"


def result_rows(df: DataFrame, case_id: Column, position: Column | None = None) -> DataFrame:
    """A typed result as rows of `ROWS`; several results are stacked with `union`."""
    place = F.lit(None).cast("long") if position is None else position
    return df.select(case_id.alias("case_id"), place.cast("long").alias("position"), _cells(df.schema).alias("cells"))


def _fingerprints(rows: DataFrame) -> DataFrame:
    """Rows as (case_id, position, kinds, texts, content): kinds by name, 64 bits of each text, 128 bits of all cells.

    Rows meet by these few bytes, whatever their width.
    """
    kinds = F.array_join(F.transform("cells", lambda c: F.coalesce(c["kind"], F.lit(""))), ",")
    texts = F.transform("cells", lambda c: F.when(c["text"].isNotNull(), F.xxhash64(c["text"])))
    content = F.unhex(F.substring(F.sha2(_json(F.col("cells")), 256), 1, 32))
    return rows.select("case_id", "position", kinds.alias("kinds"), texts.alias("texts"), content.alias("content"))


def _differing(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """The rows that one side has more often than the other at a place, with their surplus on our side.

    Rows are dealt by place before they are counted: hardly two of a task are equal before that.
    """
    both = stack(_fingerprints(actual).withColumn("side", F.lit(1)), _fingerprints(expected).withColumn("side", F.lit(-1)))
    counted = both.repartition("case_id", "position").groupBy("case_id", "position", "kinds", "texts", "content").agg(F.sum("side").alias("surplus"))
    return counted.filter("surplus <> 0")


def _ordered(differing: DataFrame) -> DataFrame:
    """(case_id, row_surplus, ordered_code): the first place that differs decides."""
    named = F.transform(F.split("kinds", ","), lambda k: F.nullif(k, F.lit("")))
    cells = F.zip_with(named, "texts", lambda k, x: F.struct(k.alias("kind"), x.alias("text")))
    ours, theirs = F.when(F.col("surplus") > 0, cells), F.when(F.col("surplus") < 0, cells)
    places = differing.groupBy("case_id", "position").agg(
        F.sum("surplus").alias("surplus"), F.max(ours).alias("ours"), F.max(theirs).alias("theirs"))
    found = places.withColumn("code", first_difference(F.col("ours"), F.col("theirs"))).filter("surplus <> 0 OR code IS NOT NULL")
    return found.groupBy("case_id").agg(F.sum("surplus").alias("row_surplus"), F.min_by(
        F.coalesce("code", F.lit(VALUES)), "position").alias("ordered_code"))


def _unordered(differing: DataFrame) -> DataFrame:
    """(case_id, row_surplus, nulls_differ, shapes_differ): from rows to their kinds to their number of NULLs."""
    rows = differing.groupBy("case_id", "kinds", "content").agg(F.sum("surplus").alias("surplus")).filter("surplus <> 0")
    shapes = rows.groupBy("case_id", "kinds").agg(F.sum("surplus").alias("surplus"))
    nulls = F.size(F.filter(F.split("kinds", ","), lambda k: k == "null"))
    by_nulls = shapes.groupBy("case_id", nulls.alias("nulls")).agg(
        F.sum("surplus").alias("surplus"), F.max(F.col("surplus") != 0).alias("shapes_differ"))
    return by_nulls.groupBy("case_id").agg(
        F.sum("surplus").alias("row_surplus"), F.max(F.col("surplus") != 0).alias("nulls_differ"),
        F.max("shapes_differ").alias("shapes_differ"))


def _json(value: Column) -> Column:
    return F.coalesce(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("null"))


def _digests(rows: DataFrame, places: Mapping[str, Column]) -> DataFrame:
    """(case_id, a digest per name) of each case's rows, each row with its place under that name. Sums of hashes, so no sort."""
    cells = rows.select("case_id", _json(F.col("cells")).alias("cells"), *[place.cast("string").alias(f"at_{name}") for name, place in places.items()])
    hashes, numbers, sums, digests = [], [], [], []
    for name in places:
        text = F.concat(F.lit('{"at":'), F.coalesce(f"at_{name}", F.lit("null")), F.lit(',"cells":'), "cells", F.lit("}"))
        hashes.append(F.sha2(text, 256).alias(name))
        for k in range(4):
            part = f"{name}_{k}"
            numbers.append(F.conv(F.substring(name, 1 + 12 * k, 12), 16, 10).cast("long").alias(part))
            # 48 bits as two halves, whose sums stay far inside a long
            high, low = F.sum(F.shiftright(part, 24)), F.sum(F.col(part).bitwiseAND((1 << 24) - 1))
            sums.append((high.cast("decimal(28,0)") * F.lit(1 << 24).cast("decimal(9,0)") + low).cast("decimal(38,0)").cast("string").alias(part))
        digests.append(F.sha2(F.concat_ws("|", "n", *[f"{name}_{k}" for k in range(4)]), 256).alias(name))
    summed = cells.select("case_id", *hashes).select("case_id", *numbers).groupBy("case_id").agg(F.count(F.lit(1)).cast("string").alias("n"), *sums)
    return summed.select("case_id", *digests)


def row_digests(rows: DataFrame, mode: Column) -> DataFrame:
    """(case_id, digest) of each case's rows; positions count where the order does."""
    return _digests(rows, {"digest": F.when(mode == ORDERED, F.col("position"))})


def _by_priority(codes: Column) -> Column:
    """The known structure codes among those found, most telling first; unknown ones behind them."""
    known = F.array(*[F.lit(c) for c in STRUCTURE_CODES])
    return F.concat(F.array_intersect(known, codes), F.array_sort(F.array_except(codes, known)))


def suite_report(cases: DataFrame, responses: DataFrame, actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per case: status, first failing stage and code, further codes, digests of both sides' rows.

    `cases` are `CASES`, `responses` are `RESPONSES` (at most one per case), `actual` and `expected` are `ROWS`. A case
    without a response is not evaluated. Rows of a case that fails before the comparison count for its digest only.
    """
    differing = _differing(actual, expected).join(cases.select("case_id", "mode"), "case_id")
    in_order = F.col("mode") == ORDERED
    found = stack(_ordered(differing.filter(in_order)), _unordered(differing.filter(~in_order)))
    answers = responses.select(
        "case_id", F.col("action").alias("actual_action"), F.col("clarification_code").alias("answered_code"),
        _by_priority(F.coalesce("structure_codes", F.array().cast("array<string>"))).alias("structure"),
        "execution_code", F.col("columns").alias("actual_columns"))
    joined = cases.join(answers, "case_id", "left").join(found, "case_id", "left")
    # a row does not know its case's mode: both digests are summed, and the case takes its own
    for name, side in (("expected_digest", expected), ("actual_digest", actual)):
        digests = _digests(side, {"placed": F.col("position"), "loose": F.lit(None)})
        joined = joined.join(digests, "case_id", "left").withColumn(
            name, F.when(in_order, F.col("placed")).otherwise(F.col("loose"))).drop("placed", "loose")

    sql = F.col("expected_action") == EXECUTE
    ours, theirs = F.col("actual_columns"), F.col("columns")
    steps: list[tuple[Column, str, str, Column]] = [
        (F.col("expected_action") == DEFERRED, "NOT_EVALUATED", "", F.lit(NOT_BUILT)),
        (F.col("actual_action").isNull(), "NOT_EVALUATED", "", F.lit(NO_RESPONSE)),
        (~sql & (F.col("actual_action") != CLARIFY), "FAIL_ACTION", "action", F.lit(WANTED_CLARIFICATION)),
        (~sql & ~F.col("answered_code").eqNullSafe(F.col("clarification_code")), "FAIL_ACTION", "action", F.lit(OTHER_CLARIFICATION)),
        (~sql, "PASS", "", F.lit(None)),
        (F.col("actual_action") != EXECUTE, "FAIL_ACTION", "action", F.lit(WANTED_SQL)),
        (F.size("structure") > 0, "FAIL_STRUCTURE", "structure", F.get("structure", F.lit(0))),
        (F.col("execution_code").isNotNull(), "FAIL_EXECUTION", "execution", F.col("execution_code")),
    ]
    differences = [
        (F.size(ours) != F.size(theirs), F.lit(COLUMN_COUNT)),
        ((ours != theirs) & (F.array_sort(ours) == F.array_sort(theirs)), F.lit(COLUMN_ORDER)),
        (~ours.eqNullSafe(theirs), F.lit(COLUMN_NAME)),
        (F.coalesce("row_surplus", F.lit(0)) != 0, F.lit(ROW_COUNT)),
        (F.col("ordered_code").isNotNull(), F.col("ordered_code")),
        (F.col("nulls_differ"), F.lit(NULLS)),
        (F.col("shapes_differ"), F.lit(TYPES)),
        (F.col("shapes_differ").isNotNull(), F.lit(MULTISET)),
    ]
    steps += [(here, "FAIL_RESULT", "comparison", code) for here, code in differences]
    # the first step that applies
    outcome = F.coalesce(
        *[F.when(here, F.struct(F.lit(status).alias("status"), F.lit(stage or None).cast("string").alias("stage"),
                                code.cast("string").alias("code"))) for here, status, stage, code in steps],
        F.struct(F.lit("PASS").alias("status"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("code")))
    late = F.col("o.stage") == "structure"
    return joined.withColumn("o", outcome).select(
        "case_id", "expected_action", "actual_action", F.col("o.status").alias("status"), F.col("o.stage").alias("failed_stage"),
        F.col("o.code").alias("failure_code"),
        F.when(late, F.slice("structure", 2, F.greatest(F.size("structure"), F.lit(1)))).otherwise(F.array().cast("array<string>")).alias("secondary_codes"),
        "expected_digest", "actual_digest")


def delta(old: DataFrame, new: DataFrame, digests: Sequence[str]) -> DataFrame:
    """(case_id, old_<digest> and new_<digest> of each, changed, is_new, is_gone) of two reports' digests per case."""
    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select("case_id", F.lit(True).alias(f"{prefix}_here"), *[F.col(d).alias(f"{prefix}_{d}") for d in digests])

    joined = side(old, "old").join(side(new, "new"), "case_id", "full_outer")
    is_new, is_gone = F.col("old_here").isNull(), F.col("new_here").isNull()
    same = reduce(lambda a, b: a & b, [F.col(f"old_{d}").eqNullSafe(F.col(f"new_{d}")) for d in digests])
    return joined.withColumn("changed", ~is_new & ~is_gone & ~same).withColumn("is_new", is_new).withColumn(
        "is_gone", is_gone).drop("old_here", "new_here")


def reviews(changes: DataFrame, reviewed: DataFrame, digests: Sequence[str]) -> DataFrame:
    """(case_id, change_reason, scenario_ids, review_status): a review holds only while all its digests still match.

    `reviewed` has the digests of `delta` as they were seen, with change_reason and scenario_ids; at most one per case.
    """
    seen = [f"{side}_{d}" for side in ("old", "new") for d in digests]
    earlier = reviewed.select("case_id", F.struct(*seen).alias("seen"), "change_reason", "scenario_ids")
    joined = changes.withColumn("now", F.struct(*seen)).join(earlier, "case_id", "left")
    same = F.col("now").eqNullSafe(F.col("seen"))
    return joined.select(
        "case_id", F.when(same, F.col("change_reason")).alias("change_reason"),
        F.when(same, F.col("scenario_ids")).otherwise(F.array().cast("array<string>")).alias("scenario_ids"),
        F.when(same, "matches_reviewed").otherwise("review_required").alias("review_status"))


def write_suite(results: Mapping[str, DataFrame], path: str, ordered_by: Mapping[str, Sequence[str]] | None = None) -> None:
    """Typed results by case as one folder (case_id, columns, position, cells).

    A case named in `ordered_by` gets the positions of that order; any other keeps NULL positions.
    """
    for case_id, df in sorted(results.items()):
        order = (ordered_by or {}).get(case_id)
        placed = with_positions(df, order, name="__position") if order else df.withColumn("__position", F.lit(None).cast("long"))
        placed.select(
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"), F.col("__position").alias("position"),
            _cells(df.schema).alias("cells")).write.mode("overwrite").parquet(f"{path}/case_id={case_id}")


def read_suite(spark: SparkSession, path: str) -> DataFrame:
    """What `write_suite` wrote: rows of `ROWS` with their columns."""
    schema = "columns array<string>, position long, cells array<struct<kind: string, text: string>>, case_id string"
    return spark.read.schema(schema).parquet(path).select("case_id", "columns", "position", "cells")
