"""Idempotent load, verification and unload of a versioned dataset, set-based."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.operators.blocks import stack

TablesMap = Mapping[str, DataFrame]


def same_cell(field: T.StructField, left: str, right: str) -> Column:
    """Null-safe equality in the field's own type."""
    a, b = F.col(f"{left}.{field.name}"), F.col(f"{right}.{field.name}")
    return a.cast(field.dataType).eqNullSafe(b.cast(field.dataType))


def ambiguous_match_keys(df: DataFrame, match: Sequence[str]) -> DataFrame:
    """Match keys that hit more than one row."""
    return df.groupBy(*match).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def _same_key(match: Sequence[str]) -> Column:
    """A NULL in a match column equals a NULL; Spark hashes this form like a plain equi join."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in match])


def _beside(source: DataFrame, stored: DataFrame, match: Sequence[str], how: str) -> DataFrame:
    wanted = source.select(*match, F.struct(*source.columns).alias("source"))
    kept = stored.select(*[F.col(c).alias(f"_{c}") for c in match], F.struct(*source.columns).alias("stored"))
    joined = wanted.join(kept, _same_key(match), how)
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) for c in match], "source", "stored")


def _equal(source: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [same_cell(f, "source", "stored") for f in source.schema])


def new_rows(source: DataFrame, stored: DataFrame, match: Sequence[str]) -> DataFrame:
    """Source rows whose match key is not stored yet: what a load appends."""
    return source.join(stored.select(*[F.col(c).alias(f"_{c}") for c in match]), _same_key(match), "left_anti")


def conflicts(source: DataFrame, stored: DataFrame, match: Sequence[str]) -> DataFrame:
    """Match keys stored with different content: a load must fail on any."""
    return _beside(source, stored, match, "inner").filter(~_equal(source)).select(*match)


def load_check(source: DataFrame, stored: DataFrame, match: Sequence[str]) -> DataFrame:
    """(outcome, row_count) of a load: appended, unchanged, conflicting; one join."""
    beside = _beside(source, stored, match, "left")
    outcome = F.when(F.col("stored").isNull(), "append").when(_equal(source), "unchanged").otherwise("conflict")
    counts = F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.count_if(outcome == o).alias("row_count"))
        for o in ("append", "unchanged", "conflict")
    ])
    return beside.agg(counts.alias("counts")).select(F.inline("counts"))


def verify(source: DataFrame, stored: DataFrame, match: Sequence[str]) -> DataFrame:
    """(match, problem) for rows missing, differing or in excess of the source."""
    beside = _beside(source, stored, match, "full_outer")
    problem = (
        F.when(F.col("stored").isNull(), "missing").when(F.col("source").isNull(), "excess").when(~_equal(source), "differs")
    )
    return beside.select(*match, problem.alias("problem")).filter("problem IS NOT NULL")


def unload(source: DataFrame, stored: DataFrame, match: Sequence[str]) -> DataFrame:
    """Stored rows that remain once the exactly owned ones are taken out; match keys are unique in the source."""
    wanted = source.select(*[F.col(c).alias(f"_{c}") for c in match], F.struct(*source.columns).alias("source"))
    beside = stored.withColumn("stored", F.struct(*source.columns)).join(wanted, _same_key(match), "left")
    return beside.filter(F.col("source").isNull() | ~_equal(source)).select(*stored.columns)


def row_counts(t: TablesMap) -> DataFrame:
    """(table_name, row_count)."""
    return stack(*[t[name].agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name in t])


def count_differences(t: TablesMap, expected: DataFrame) -> DataFrame:
    """Tables whose row count is not the expected one: the store holds the dataset and no more."""
    joined = expected.select("table_name", F.col("row_count").alias("expected_count")).join(row_counts(t), "table_name", "full_outer")
    return joined.filter(~F.col("expected_count").eqNullSafe(F.col("row_count")))


def load_tables(source: TablesMap, root: str, match: Mapping[str, Sequence[str]], order: Sequence[str]) -> None:
    """Append the missing rows of each table in order, after every table has passed every check.

    Loading the same source again appends nothing. A crash between two writes leaves the tables before it
    complete and those behind it untouched; loading again completes them.
    """
    found = {name: _stored(source[name], f"{root}/{name}") for name in order}
    for name, stored in found.items():
        keys = list(match[name])
        if not ambiguous_match_keys(source[name], keys).isEmpty():
            raise ValueError(f"{name}: a match key is not unique in the source")
        if stored is None:
            continue
        wanted = source[name].select(*[F.col(c).alias(f"_{c}") for c in keys])
        if not ambiguous_match_keys(stored.join(wanted, _same_key(keys), "left_semi"), keys).isEmpty():
            raise ValueError(f"{name}: a match key is stored more than once")
        if not conflicts(source[name], stored, keys).isEmpty():
            raise ValueError(f"{name}: a stored row differs from the source")
    for name, stored in found.items():
        missing = source[name] if stored is None else new_rows(source[name], stored, list(match[name]))
        missing.write.mode("append").parquet(f"{root}/{name}")


def verify_tables(source: TablesMap, root: str, match: Mapping[str, Sequence[str]], order: Sequence[str]) -> DataFrame:
    """(table_name, problem, row_count) over all tables; empty if the store equals the source."""
    found = []
    for name in order:
        stored = _stored(source[name], f"{root}/{name}")
        stored = source[name].limit(0) if stored is None else stored
        found.append(verify(source[name], stored, list(match[name])).select(F.lit(name).alias("table_name"), "problem"))
    return stack(*found).groupBy("table_name", "problem").agg(F.count(F.lit(1)).alias("row_count"))


def unload_tables(source: TablesMap, root: str, target: str, match: Mapping[str, Sequence[str]], order: Sequence[str],
                  strict: bool = True) -> None:
    """Write what remains, in reverse table order, to another folder; the input is left as it is.

    Unless `strict` is off, an owned row that is missing or changed in the store fails the job before anything is written.
    """
    if target.rstrip("/") == root.rstrip("/"):
        raise ValueError("the remaining rows need a folder of their own")
    found = {name: _stored(source[name], f"{root}/{name}") for name in reversed(order)}
    for name, stored in found.items():
        kept = source[name].limit(0) if stored is None else stored
        if strict and not verify(source[name], kept, list(match[name])).filter("problem <> 'excess'").isEmpty():
            raise ValueError(f"{name}: an owned row is missing or changed")
    for name, stored in found.items():
        if stored is not None:
            unload(source[name], stored, list(match[name])).write.parquet(f"{target}/{name}")


def _stored(like: DataFrame, path: str) -> DataFrame | None:
    spark = like.sparkSession
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)
    return spark.read.schema(like.schema).parquet(path) if exists else None


def write_results(results: Mapping[str, DataFrame], path: str) -> None:
    """Results as JSON lines (case_id, columns, row) in one folder per case: decimals as text, times to the microsecond."""
    for case_id, df in sorted(results.items()):
        exact = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema]
        row = F.to_json(F.struct(*exact), {
            "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
            "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
        df.select(F.lit(",".join(df.columns)).alias("columns"), row.alias("row")).write.mode("overwrite").json(
            f"{path}/case_id={case_id}"
        )
