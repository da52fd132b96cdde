"""What the corpus operators share: reading tables, cutting lineage, fixed text rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import shared_dir

#: words are the runs of characters that are neither a space nor one of the five ASCII controls 9 to 13
BLANK = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session; set from the library's fallback only where none is set."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and goes on from there; Spark removes the files."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def own(df: DataFrame, name: str) -> Column:
    """A column of `df` by its exact name, whatever characters the name has."""
    return df["`" + name.replace("`", "``") + "`"]


def free_name(df: DataFrame, name: str) -> str:
    """`name`, led by as many underscores as make it no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), lambda w: w != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, however often and inside whatever lambda it is used.

    The optimizer merges projections and may move an expression into a lambda that runs per element; a lambda
    variable is never replaced by its definition.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
