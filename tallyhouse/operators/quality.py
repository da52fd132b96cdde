"""Data-quality operators: they return violating rows, or count them per rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.blocks import inline_rows, stack
from tallyhouse.operators.rules import CHECKS, REFERENCES, UNIQUE
from tallyhouse.schemas import primary_key

TablesMap = Mapping[str, DataFrame]


def _violated(predicate: str):
    return ~F.coalesce(F.expr(predicate), F.lit(True))


def check(df: DataFrame, key: str, rules: Mapping[str, str]) -> DataFrame:
    """(rule, record_id) for each violated rule of each row; one scan for all rules."""
    hits = F.array_compact(F.array(*[F.when(_violated(p), F.lit(name)) for name, p in rules.items()]))
    return df.select(F.explode(hits).alias("rule"), F.col(key).cast("string").alias("record_id"))


def check_counts(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """(rule, violations) including rules without a violation; one global aggregate."""
    counts = [
        F.struct(F.lit(name).alias("rule"), F.count_if(_violated(p)).alias("violations"))
        for name, p in rules.items()
    ]
    return df.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column values held by more than one row, with the number of rows."""
    present = df.select(*columns).dropna()
    return present.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count")).filter("row_count > 1")


def foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose reference is set but has no parent row."""
    keys = parent.select(F.col(parent_column).alias(column))
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def check_report(t: TablesMap) -> DataFrame:
    return stack(
        *[
            check_counts(t[table], rules).select(F.lit(table).alias("table_name"), "rule", "violations")
            for table, rules in CHECKS.items()
        ]
    )


def _with_zeros(counted: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(table_name, rule, violations) of all rules, 0 where nothing was counted."""
    zeros = inline_rows(counted.sparkSession, "table_name string, rule string, violations bigint", [(*rule, "0") for rule in rules])
    return stack(zeros, counted.select("table_name", "rule", "violations")).groupBy("table_name", "rule").agg(
        F.sum("violations").alias("violations"))


def _keys(df: DataFrame, rules: Mapping[int, Sequence[str]]) -> DataFrame:
    """(rule number, key) of every row and rule whose columns are all set: one pass over the table for all its rules."""
    def key(columns: Sequence[str]) -> Column:
        texts = [F.col(c).cast("string") for c in columns]
        whole = texts[0] if len(columns) == 1 else F.to_json(F.struct(*texts))
        return F.when(reduce(and_, [F.col(c).isNotNull() for c in columns]), whole)

    keys = [F.struct(F.lit(number).alias("number"), key(columns).alias("key")) for number, columns in rules.items()]
    return df.select(F.inline(F.array(*keys))).filter("key IS NOT NULL")


def unique_report(t: TablesMap) -> DataFrame:
    """Keys held by several rows, for all rules: each table is read once and all keys meet in one grouping."""
    tables: dict[str, dict[int, Sequence[str]]] = {}
    for number, (table, _, columns) in enumerate(UNIQUE):
        tables.setdefault(table, {})[number] = columns
    keys = stack(*[_keys(t[table], rules) for table, rules in tables.items()])
    doubled = keys.groupBy("number", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    names = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule")) for table, rule, _ in UNIQUE])
    counted = doubled.groupBy("number").agg(F.count(F.lit(1)).alias("violations")).select(
        F.get(names, F.col("number")).alias("named"), "violations").select("named.*", "violations")
    return _with_zeros(counted, [(table, rule) for table, rule, _ in UNIQUE])


def foreign_key_report(t: TablesMap) -> DataFrame:
    """Child rows without their parent, for all references: each table is read once.

    Children are first cut to one row per (reference, key), so a key meets its parent next to at most one row per
    reference, however many children it has.
    """
    children: dict[str, list[tuple[str, str]]] = {}
    for child, column, parent in REFERENCES:
        children.setdefault(child, []).append((column, parent))
    asked = stack(*[
        t[child].select(F.lit(child).alias("table_name"), F.inline(F.array(*[
            F.struct(F.lit(column).alias("rule"), F.lit(parent).alias("parent"), F.col(column).cast("string").alias("key"))
            for column, parent in columns]))).filter("key IS NOT NULL")
        for child, columns in children.items()
    ]).groupBy("table_name", "rule", "parent", "key").agg(F.count(F.lit(1)).alias("n"))
    there = stack(*[
        t[parent].select(F.lit(parent).alias("parent"), F.col(primary_key(parent)).cast("string").alias("key"))
        for parent in dict.fromkeys(parent for _, _, parent in REFERENCES)
    ]).withColumn("here", F.lit(True))
    both = asked.select("parent", "key", F.struct("table_name", "rule", "n").alias("child")).unionByName(there, allowMissingColumns=True)
    met = both.groupBy("parent", "key").agg(F.max("here").alias("here"), F.collect_list("child").alias("children"))
    lost = met.filter("here IS NULL").select(F.inline("children"))
    counted = lost.groupBy("table_name", "rule").agg(F.sum("n").alias("violations"))
    return _with_zeros(counted, [(child, column) for child, column, _ in REFERENCES])
