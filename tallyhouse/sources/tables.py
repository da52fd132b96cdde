"""Named tables of the business model, read with a fixed schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyhouse.schemas import SCHEMAS


class Tables(Mapping[str, DataFrame]):
    """A lazy name -> DataFrame map; each table is planned at most once."""

    def __init__(self, load: Callable[[str], DataFrame], names: Iterable[str]) -> None:
        self._load = load
        self._names = tuple(names)
        self._planned: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._planned:
            if name not in self._names:
                raise KeyError(name)
            self._planned[name] = self._load(name)
        return self._planned[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)

    def replacing(self, **frames: DataFrame) -> Tables:
        """The same tables with some swapped, e.g. a freshly attributed result."""
        merged = Tables(self._load, dict.fromkeys([*self._names, *frames]))
        merged._planned = {**self._planned, **frames}
        return merged


# the business time that reports filter large tables by
CLUSTER_BY = {
    "organization": "registered_at",
    "subscription_state_event": "effective_at",
    "invoice_payment_attempt": "succeeded_at",
    "commerce_order": "first_paid_at",
    "commerce_refund": "succeeded_at",
    "platform_fee_charge": "succeeded_at",
    "campaign_daily_spend": "business_date",
    "marketing_touch": "occurred_at",
    "attributed_conversion": "conversion_at",
}


def read_tables(spark: SparkSession, root: str, schemas: Mapping[str, T.StructType] = SCHEMAS) -> Tables:
    """One parquet folder per entity, read with the model's schema: no inference."""
    return Tables(lambda name: spark.read.schema(schemas[name]).parquet(f"{root}/{name}"), schemas)


def write_tables(t: Mapping[str, DataFrame], root: str, names: Iterable[str] | None = None) -> None:
    """One parquet folder per entity, large ones ranged by business time.

    A period filter then skips whole files and row groups by their statistics.
    """
    for name in names or t:
        df, column = t[name], CLUSTER_BY.get(name)
        if column:
            df = df.repartitionByRange(column).sortWithinPartitions(column)
        df.write.parquet(f"{root}/{name}")


def in_memory(spark: SparkSession, rows: Mapping[str, list[dict]]) -> Tables:
    """Small hand-made tables; missing tables are empty and missing columns NULL."""
    def load(name: str) -> DataFrame:
        schema = SCHEMAS[name]
        loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
        values = [{f.name: row.get(f.name) for f in schema} for row in rows.get(name, [])]
        return spark.createDataFrame(pa.Table.from_pylist(values, schema=to_arrow_schema(loose)), loose)

    return Tables(load, SCHEMAS)


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns in its order and types; a missing or extra column fails."""
    missing = [f.name for f in schema if f.name not in df.columns]
    extra = [c for c in df.columns if c not in schema.names]
    if missing or extra:
        raise ValueError(f"columns differ from the schema: missing {missing}, extra {extra}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def existing_tables(names: Iterable[str]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) names against the model's twenty tables."""
    present = set(names)
    return sorted(set(SCHEMAS) - present), sorted(present - set(SCHEMAS))
