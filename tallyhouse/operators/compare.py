"""Strict comparison of result tables, and roll-ups over many comparisons.

Cells are compared as (kind, fixed text) without coercion or tolerance. Everything stays
distributed: multisets are compared by signed counts of row digests, and in an ordered comparison the two sides
meet by their place in the declared order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.blocks import inline_rows, stack
from tallyhouse.operators.positions import with_positions
from tallyhouse.session import staged

# Failure codes, earliest stage first, and the statuses of a suite.
COLUMN_COUNT, COLUMN_NAME, COLUMN_ORDER = "COLUMN_COUNT_MISMATCH", "COLUMN_NAME_MISMATCH", "COLUMN_ORDER_MISMATCH"
ROW_COUNT, NULLS, TYPES, VALUES = "ROW_COUNT_MISMATCH", "NULL_MISMATCH", "TYPE_MISMATCH", "VALUE_MISMATCH"
MULTISET = "UNORDERED_MULTISET_MISMATCH"
STATUSES = ("PASS", "FAIL_ACTION", "FAIL_STRUCTURE", "FAIL_EXECUTION", "FAIL_RESULT", "NOT_EVALUATED")

_LETTERS = {"integer": "i", "boolean": "b", "decimal": "d", "string": "s", "datetime": "t", "null": "n"}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind_of(data_type: T.DataType) -> str:
    """The result kind of a column type; other types are refused."""
    if isinstance(data_type, _INTEGERS):
        return "integer"
    kinds = {
        T.BooleanType: "boolean", T.DecimalType: "decimal", T.StringType: "string",
        T.TimestampNTZType: "datetime", T.NullType: "null",
    }
    for spark_type, kind in kinds.items():
        if isinstance(data_type, spark_type):
            return kind
    raise TypeError(f"unsupported result type: {data_type.simpleString()}")


def cell_text(name: str, data_type: T.DataType) -> Column:
    """Fixed text of a cell: a decimal keeps its scale, an instant its microseconds."""
    column = F.col(f"`{name}`")
    if isinstance(data_type, T.TimestampNTZType):
        return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return column.cast("string")


def normalize(df: DataFrame) -> DataFrame:
    """One column `cells`: array of (kind, text) in column order."""
    return df.select(_cells(df.schema).alias("cells"))


def _cells(schema: T.StructType) -> Column:
    cells = []
    for field in schema:
        missing = F.col(f"`{field.name}`").isNull()
        cells.append(
            F.struct(
                F.when(missing, "null").otherwise(kind_of(field.dataType)).alias("kind"),
                cell_text(field.name, field.dataType).alias("text"),
            )
        )
    return F.array(*cells)


def decode(df: DataFrame, kinds: Mapping[str, str]) -> DataFrame:
    """Stored text back to typed columns; text not in its kind's fixed form fails the job."""
    forms = {
        "integer": (r"^-?[0-9]+$", "bigint"),
        "boolean": (r"^(true|false)$", "boolean"),
        "datetime": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}$", "timestamp_ntz"),
        # more digits than the declared scale fail instead of being rounded away
        **{name: (rf"^-?[0-9]+(\.[0-9]{{1,{scale}}})?$", f"decimal(38,{scale})")
           for name, scale in [("decimal", 4), *[(f"decimal:{k}", k) for k in range(1, 19)]]},
    }
    if set(kinds) != set(df.columns):
        raise ValueError("declared kinds do not match the columns")
    columns = []
    for name in df.columns:
        if kinds[name] == "string":
            columns.append(F.col(name))
            continue
        pattern, spark_type = forms[kinds[name]]
        value = F.col(name)
        good = value.isNull() | value.rlike(pattern)
        message = F.concat(F.lit(f"not a {kinds[name]} in {name}: "), value)
        columns.append(F.when(good, value.cast(spark_type)).otherwise(F.raise_error(message).cast(spark_type)).alias(name))
    return df.select(*columns)


def column_failure(actual: Sequence[str], expected: Sequence[str]) -> str | None:
    if len(actual) != len(expected):
        return COLUMN_COUNT
    if list(actual) == list(expected):
        return None
    return COLUMN_ORDER if set(actual) == set(expected) else COLUMN_NAME


def compare(actual: DataFrame, expected: DataFrame, order_by: Sequence[str] | None = None,
            descending: Sequence[str] = (), placed: dict[int, DataFrame] | None = None) -> DataFrame:
    """One row (matches, failure_code). With `order_by`, position matters, else only the multiset.

    Several comparisons in one order may share `placed`, an empty dict at first: a frame met again is not placed again.
    """
    failure = column_failure(actual.columns, expected.columns)
    if failure is not None:
        spark = actual.sparkSession
        return inline_rows(spark, "matches boolean, failure_code string", [("false", failure)])
    if order_by is not None:
        return _verdict(_ordered_failure(actual, expected, order_by, descending, {} if placed is None else placed))
    both = stack(
        actual.select(*_row_key(actual.schema), F.lit(1).alias("side")),
        expected.select(*_row_key(expected.schema), F.lit(-1).alias("side")),
    )
    counted = both.groupBy("kinds", "content").agg(F.sum("side").alias("surplus"))
    return _verdict(_multiset_failure(counted))


def _row_key(schema: T.StructType) -> list[Column]:
    """A row as (kinds, content): one letter per cell, and the SHA-256 of all texts, each behind its length.

    Rows meet by these few bytes, whatever their width.
    """
    kinds, texts = [], []
    for field in schema:
        text = cell_text(field.name, field.dataType)
        kinds.append(F.when(F.col(f"`{field.name}`").isNull(), _LETTERS["null"]).otherwise(_LETTERS[kind_of(field.dataType)]))
        texts.append(F.concat(F.length(text).cast("string"), F.lit(":"), text))
    return [F.concat(*kinds).alias("kinds"), F.unhex(F.sha2(F.concat_ws("", *texts), 256)).alias("content")]


def _verdict(found: DataFrame) -> DataFrame:
    return found.select(F.col("failure_code").isNull().alias("matches"), "failure_code")


def _multiset_failure(counted: DataFrame) -> DataFrame:
    """Row count first, then shape of kinds (NULL counts before kinds), then the values."""
    by_shape = counted.filter("surplus <> 0").groupBy("kinds").agg(F.sum("surplus").alias("surplus"))
    nulls = F.length(F.regexp_replace("kinds", f"[^{_LETTERS['null']}]", ""))
    by_nulls = by_shape.groupBy(nulls.alias("nulls")).agg(
        F.sum("surplus").alias("null_surplus"), F.max(F.col("surplus") != 0).alias("shape_differs")
    )
    found = by_nulls.agg(
        F.coalesce(F.sum("null_surplus"), F.lit(0)).alias("row_surplus"),
        F.max(F.col("null_surplus") != 0).alias("nulls_differ"),
        F.max("shape_differs").alias("shapes_differ"),
        F.count(F.lit(1)).alias("differences"),
    )
    return found.select(
        F.when(F.col("row_surplus") != 0, ROW_COUNT)
        .when(F.col("nulls_differ"), NULLS)
        .when(F.col("shapes_differ"), TYPES)
        .when(F.col("differences") > 0, MULTISET)
        .alias("failure_code")
    )


def first_difference(ours: Column, theirs: Column) -> Column:
    """The failure code of the first cell that differs: NULL before other kinds, kinds before texts."""
    def code(a: Column, b: Column) -> Column:
        nulls = (a["kind"] == "null") | (b["kind"] == "null")
        return F.when(a["kind"] != b["kind"], F.when(nulls, NULLS).otherwise(TYPES)).when(~a["text"].eqNullSafe(b["text"]), VALUES)

    return F.get(F.filter(F.zip_with(ours, theirs, code), lambda c: c.isNotNull()), F.lit(0))


def _ordered_failure(actual: DataFrame, expected: DataFrame, order_by: Sequence[str], descending: Sequence[str],
                     placed: dict[int, DataFrame]) -> DataFrame:
    """Row count first, then the first differing cell at the first place that differs.

    Rows meet by place as digests, half a SHA-256 each; only the two rows of that place are looked at cell by cell.
    """
    sides = []
    for df, side in ((actual, 1), (expected, -1)):
        if id(df) not in placed:
            placed[id(df)] = with_positions(df, order_by, descending, "__place")
        sides.append((placed[id(df)], df.schema, side))
    keys = stack(*[rows.select("__place", *_row_key(schema), F.lit(side).alias("side")) for rows, schema, side in sides])
    counted = keys.groupBy("__place", "kinds", F.substring("content", 1, 16).alias("content")).agg(F.sum("side").alias("surplus"))
    first = staged(counted.filter("surplus <> 0").agg(
        F.coalesce(F.sum("surplus"), F.lit(0)).alias("row_surplus"), F.min("__place").alias("__place")))
    there = first.filter("row_surplus = 0").select("__place")
    found = stack(first.select("row_surplus"), *[
        rows.join(F.broadcast(there), "__place").select(_cells(schema).alias("ours" if side > 0 else "theirs")) for rows, schema, side in sides
    ]).agg(F.max("row_surplus").alias("row_surplus"), F.max("ours").alias("ours"), F.max("theirs").alias("theirs"))
    code = first_difference(F.col("ours"), F.col("theirs"))
    return found.select(F.when(F.col("row_surplus") != 0, ROW_COUNT).otherwise(code).alias("failure_code"))


def digest(df: DataFrame) -> DataFrame:
    """One row (row_count, content_digest): equal for equal multisets of typed rows.

    Each row is hashed and the hashes are summed, so no global sort is needed.
    """
    row_text = F.to_json(F.struct(_cells(df.schema).alias("row")), {"ignoreNullFields": "false"})
    row_hash = F.sha2(row_text, 256)
    parts = [F.conv(F.substring(row_hash, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = df.select(*[part.alias(f"h{i}") for i, part in enumerate(parts)]).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.coalesce(F.sum(f"h{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)],
    )
    names = F.lit(",".join(df.columns))
    text = F.concat_ws("|", names, F.col("row_count").cast("string"), *[F.col(f"s{i}").cast("string") for i in range(4)])
    return sums.select("row_count", F.sha2(text, 256).alias("content_digest"))


def suite_rollup(results: DataFrame) -> DataFrame:
    """(status, cases) for every known status, zero-filled, from (case_id, status)."""
    counts = F.array(*[F.struct(F.lit(s).alias("status"), F.count_if(F.col("status") == s).alias("cases")) for s in STATUSES])
    return results.agg(counts.alias("counts")).select(F.inline("counts"))


def response_gaps(expected: DataFrame, responses: DataFrame) -> DataFrame:
    """(case_id, problem) for missing, unknown and forbidden responses.

    `expected` is (case_id, action); a deferred case must not be answered.
    """
    deferred = expected.filter("action = 'deferred'")
    wanted = expected.filter("action <> 'deferred'")
    return stack(
        wanted.join(responses, "case_id", "left_anti").select("case_id", F.lit("missing").alias("problem")),
        responses.join(expected, "case_id", "left_anti").select("case_id", F.lit("unknown").alias("problem")),
        responses.join(deferred, "case_id", "left_semi").select("case_id", F.lit("forbidden").alias("problem")),
    )
