"""One large nested dataset file read by many tasks.

The text source cuts a file at every `"record_id"` and deals byte ranges of it to tasks. Such a token never lies inside
a longer string, where its quotes would be escaped, so each piece begins outside of strings and its brackets can be
counted by itself. A running sum over the pieces of a byte range, and one over the few ranges of a file, give the
nesting depth before every piece. A piece opens a record where it continues a key at the depth of records;
pieces in between (references, texts that read `record_id`) belong to the record before them. What stands behind the
last record of a table names the next table.

The file must have its keys in the order of the format: source_id, tables; table_name, match_columns, records; record_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhouse.session import staged

TOKEN = '"record_id"'
#: brackets open before a record's own key: file, tables, table, records, record
RECORD_DEPTH = 5

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_TABLE = rf'\{{\s*"table_name"\s*:\s*({_STRING})\s*,\s*"match_columns"\s*:\s*(\[[^\]]*\])\s*,\s*"records"\s*:\s*\[\s*\{{\s*$'
_SOURCE = rf'^\s*\{{\s*"source_id"\s*:\s*({_STRING})\s*,\s*"tables"\s*:\s*\['
_RECORD = "record_id string, values map<string, string>"


def _pieces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source_file, range, place, text, steps): the pieces in file order, with the brackets each leaves open."""
    raw = spark.read.option("lineSep", TOKEN).text(list(paths)).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))
    bare = F.regexp_replace("text", _STRING, "")
    opened, closed = (F.length(F.regexp_replace(bare, rf"[^{brackets}]", "")) for brackets in (r"\[{", r"\]}"))
    return staged(raw.withColumn("steps", (opened - closed).cast("long")))


def _before(pieces: DataFrame, value: str, name: str, own: bool) -> DataFrame:
    """The sum of `value` over all earlier pieces of the file, with `own` over the piece itself too."""
    inside = Window.partitionBy("source_file", "range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    earlier = Window.partitionBy("source_file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.groupBy("source_file", "range").agg(F.sum(value).alias("__all")).select(
        "source_file", "range", F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__earlier"))
    summed = pieces.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(ranges, ["source_file", "range"]).withColumn(
        name, F.col("__inside") + F.col("__earlier")).drop("__inside", "__earlier")


def _unquoted(text: Column) -> Column:
    return F.from_json(F.concat(F.lit('{"x":'), text, F.lit("}")), "x string")["x"]


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source_id, source_file, table_name, match_columns, record_id, values) of all records, values as text.

    How finely a file is dealt follows `spark.sql.files.maxPartitionBytes`. A record in front of which no table is
    named fails the job.
    """
    deep = _before(_pieces(spark, paths), "steps", "depth", own=False)
    opens = (F.col("depth") == RECORD_DEPTH) & F.col("text").rlike(r"^\s*:")
    numbered = _before(deep.withColumn("opens", opens.cast("long")), "opens", "number", own=True)
    # a record's pieces: one, and one more per reference
    texts = numbered.groupBy("source_file", "number").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("range", "place", "text"))), lambda x: x["text"]), TOKEN).alias("text"))
    texts = staged(texts)
    table, columns = F.regexp_extract("text", _TABLE, 1), F.regexp_extract("text", _TABLE, 2)
    named = texts.filter((F.col("number") == 0) | (table != "")).select(
        "source_file", "number", F.when(F.col("number") == 0, _unquoted(F.regexp_extract("text", _SOURCE, 1))).alias("source_id"),
        F.when(table != "", F.struct("number", _unquoted(table).alias("table_name"), F.from_json(columns, "array<string>").alias("match_columns"))).alias("head"))
    # as many heads as a file has tables
    heads = named.groupBy("source_file").agg(F.max("source_id").alias("source_id"), F.collect_list("head").alias("heads"))
    # what stands behind the record's closing bracket is not read
    record = F.from_json(F.concat(F.lit("{" + TOKEN), "text"), _RECORD)
    joined = texts.filter("number > 0").join(heads, "source_file", "left")
    before = F.array_max(F.filter("heads", lambda h: h["number"] < F.col("number")))
    found = joined.withColumn("head", before).withColumn("record", record)
    checked = F.when(F.col("head").isNull(), F.raise_error(F.concat(F.lit("no table is named before a record of "), "source_file")).cast("string"))
    return found.select(
        "source_id", "source_file", F.coalesce(checked, F.col("head.table_name")).alias("table_name"),
        F.col("head.match_columns").alias("match_columns"), "record.record_id", "record.values")
