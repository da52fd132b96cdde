"""Session settings the plans rely on.

`tune` only sets runtime SQL options, so it can be applied to a session somebody else
started. Nothing here is needed for a correct result except the UTC zone; the rest keeps
adaptive execution able to split skewed joins.
"""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession

RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even where that costs one more shuffle downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # a table written in a few folders keeps a file open for each instead of sorting its whole rows by folder
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in RUNTIME_OPTIONS.items():
        spark.conf.set(name, value)
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyhouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates, as the cluster names it.

    Only a local session may fall back on a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.conf.get("spark.master").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    return _own_folder()


def staged(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared checkpoint folder and goes on from there, for what is read several times."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyhouse-")
