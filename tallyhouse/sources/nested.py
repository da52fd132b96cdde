"""The nested JSON dataset: a manifest and one file per domain.

A file holds {source_id, tables: [{table_name, match_columns, records: [{record_id, values}]}]};
a value is a scalar or a reference {table, record_id} to another record. Records are exploded to
one row each and stay a DataFrame from there on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.blocks import inline_rows, stack
from tallyhouse.schemas import SCHEMAS, primary_key
from tallyhouse.sources.tables import Tables

_FILE = "source_id string, tables array<struct<table_name: string, match_columns: array<string>, records: array<struct<record_id: string, values: map<string, string>>>>>"
_MANIFEST = (
    "dataset_id string, dataset_version string, dataset_digest string, schema_revision string, business_timezone string, "
    "snapshot_cutoff string, marketing_history_started_at string, source_files array<string>, table_order array<string>, "
    "expected_row_counts map<string, bigint>"
)
_REFERENCE = "struct<table: string, record_id: string>"


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row; instants as naive UTC."""
    raw = spark.read.schema(_MANIFEST).option("multiLine", True).json(f"{root}/manifest.json")
    for name in ("snapshot_cutoff", "marketing_history_started_at"):
        raw = raw.withColumn(name, F.to_timestamp(name).cast("timestamp_ntz"))
    return raw


def expected_counts(manifest: DataFrame) -> DataFrame:
    return manifest.select(F.explode("expected_row_counts").alias("table_name", "row_count"))


def read_records(spark: SparkSession, root: str, files: Sequence[str]) -> DataFrame:
    """(source_id, source_file, table_name, match_columns, record_id, values), values as text.

    A file is one JSON value and so one task; its records are dealt out again right behind the parser.
    """
    raw = spark.read.schema(_FILE).option("multiLine", True).json([f"{root}/{name}" for name in files])
    tables = raw.select("source_id", F.col("_metadata.file_path").alias("source_file"), F.inline("tables"))
    records = tables.select("source_id", "source_file", "table_name", "match_columns", F.inline("records"))
    return records.repartition("table_name", "record_id")


def cells(records: DataFrame) -> DataFrame:
    """(table_name, record_id, column_name, value, ref) with ref set where the value is a reference."""
    flat = records.select("table_name", "record_id", F.explode("values").alias("column_name", "value"))
    parsed = F.from_json("value", _REFERENCE)
    is_ref = F.col("value").startswith("{") & parsed["table"].isNotNull() & parsed["record_id"].isNotNull()
    return flat.withColumn("ref", F.when(is_ref, parsed))


def structure_problems(records: DataFrame, manifest: DataFrame) -> DataFrame:
    """(problem, detail) of duplicates, unexpected or miscounted tables, missing match columns, references
    that resolve nowhere, a source id in two files, and a table order that is not the dataset's tables, each once."""
    twice = records.groupBy("table_name", "record_id").count().filter("count > 1")
    sources = records.select("source_id", "table_name").distinct().groupBy("table_name").count().filter("count > 1")
    files = records.select("source_id", "source_file").distinct().groupBy("source_id").count().filter("count > 1")
    listed = manifest.select(F.explode("table_order").alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("times"))
    found_tables = records.select("table_name").distinct().withColumn("present", F.lit(True))
    order = listed.join(found_tables, "table_name", "full_outer").filter("NOT (times <=> 1) OR present IS NULL")
    counted = records.groupBy("table_name").agg(F.count(F.lit(1)).alias("found"))
    counts = expected_counts(manifest).join(counted, "table_name", "full_outer").filter(
        ~F.coalesce("row_count", F.lit(-1)).eqNullSafe(F.coalesce("found", F.lit(0)))
    )
    unmatched = records.filter(F.size(F.array_except("match_columns", F.map_keys("values"))) > 0)
    known = records.select(F.col("table_name").alias("table"), F.col("record_id").alias("to"))
    dangling = cells(records).filter("ref IS NOT NULL").select(
        F.col("ref.table").alias("table"), F.col("ref.record_id").alias("to")
    ).join(known, ["table", "to"], "left_anti")
    collisions = surrogate_ids(records).groupBy("table_name", "id").count().filter("count > 1")
    return stack(
        collisions.select(F.lit("id_collision").alias("problem"), F.concat_ws(":", "table_name", "id").alias("detail")),
        twice.select(F.lit("duplicate_record").alias("problem"), F.concat_ws(":", "table_name", "record_id").alias("detail")),
        files.select(F.lit("source_in_two_files").alias("problem"), F.col("source_id").alias("detail")),
        order.select(F.lit("table_order").alias("problem"), F.col("table_name").alias("detail")),
        sources.select(F.lit("table_in_two_sources").alias("problem"), F.col("table_name").alias("detail")),
        counts.select(F.lit("row_count").alias("problem"), F.col("table_name").alias("detail")),
        unmatched.select(F.lit("missing_match_column").alias("problem"), F.concat_ws(":", "table_name", "record_id").alias("detail")),
        dangling.select(F.lit("unresolved_reference").alias("problem"), F.concat_ws(":", "table", "to").alias("detail")),
    )


def surrogate_ids(records: DataFrame) -> DataFrame:
    """(table_name, record_id, id): an id derived from the key, so no global numbering is needed."""
    key = F.xxhash64("table_name", "record_id")
    return records.select("table_name", "record_id", F.shiftrightunsigned(key, 1).alias("id"))


def resolve_references(records: DataFrame) -> DataFrame:
    """Cells with references replaced by the surrogate id of the record they name."""
    ids = surrogate_ids(records)
    flat = cells(records).withColumn("ref_table", F.col("ref.table")).withColumn("ref_record", F.col("ref.record_id"))
    targets = ids.select(F.col("table_name").alias("ref_table"), F.col("record_id").alias("ref_record"), F.col("id").alias("ref_id"))
    joined = flat.join(targets, ["ref_table", "ref_record"], "left")
    value = F.when(F.col("ref").isNotNull(), F.col("ref_id").cast("string")).otherwise(F.col("value"))
    return joined.select("table_name", "record_id", "column_name", value.alias("value"))


def typed_tables(records: DataFrame) -> Tables:
    """The dataset as typed entity tables, keyed by surrogate ids."""
    resolved = resolve_references(records)
    ids = surrogate_ids(records)

    def load(name: str) -> DataFrame:
        schema, key = SCHEMAS[name], primary_key(name)
        wide = resolved.filter(F.col("table_name") == name).groupBy("record_id").agg(
            *[F.max(F.when(F.col("column_name") == c, F.col("value"))).alias(c) for c in schema.names if c != key]
        )
        own = ids.filter(F.col("table_name") == name).select("record_id", F.col("id").alias(key))
        return wide.join(own, "record_id").select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    return Tables(load, SCHEMAS)


def match_columns(records: DataFrame) -> Mapping[str, Sequence[str]]:
    """Match columns per table (driver side: one short row per table)."""
    rows = records.select("table_name", "match_columns").distinct().collect()
    return {row["table_name"]: list(row["match_columns"]) for row in rows}


def counts_as_rows(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    return inline_rows(spark, "table_name string, row_count bigint", [(n, str(c)) for n, c in counts.items()])
