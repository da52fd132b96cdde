from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import lifecycle
from tallyhouse.schemas import SCHEMAS
from tallyhouse.sources import nested, tables
from tests.sample import dataset

MATCH = {"consumer": ["external_consumer_id"], "commerce_order": ["external_order_id"]}
ORDER = ["consumer", "commerce_order"]


def test_load_verify_unload_can_be_repeated(spark, tmp_path):
    source = tables.in_memory(spark, dataset())
    root = str(tmp_path / "store")
    lifecycle.load_tables(source, root, MATCH, ORDER)
    lifecycle.load_tables(source, root, MATCH, ORDER)
    assert lifecycle.verify_tables(source, root, MATCH, ORDER).count() == 0
    stored = tables.read_tables(spark, root)
    assert stored["commerce_order"].count() == 2
    lifecycle.unload_tables(source, root, str(tmp_path / "left"), MATCH, ORDER)
    assert tables.read_tables(spark, str(tmp_path / "left"))["commerce_order"].count() == 0
    with pytest.raises(ValueError):
        lifecycle.unload_tables(source, root, root + "/", MATCH, ORDER)


def test_load_fails_on_a_conflict_or_an_ambiguous_key(spark, tmp_path):
    rows = dataset()
    root = str(tmp_path / "store")
    lifecycle.load_tables(tables.in_memory(spark, rows), root, MATCH, ORDER)
    rows["commerce_order"][0]["status"] = "paid"
    with pytest.raises(ValueError, match="differs"):
        lifecycle.load_tables(tables.in_memory(spark, rows), root, MATCH, ORDER)
    found = lifecycle.verify_tables(tables.in_memory(spark, rows), root, MATCH, ORDER).collect()
    assert [tuple(r) for r in found] == [("commerce_order", "differs", 1)]
    rows["commerce_order"].append(rows["commerce_order"][0])
    with pytest.raises(ValueError, match="not unique"):
        lifecycle.load_tables(tables.in_memory(spark, rows), root, MATCH, ORDER)


def test_unload_keeps_rows_that_are_not_exactly_owned(spark):
    source = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    stored = spark.createDataFrame([(1, "a"), (2, "changed"), (3, "c")], "k int, v string")
    assert sorted(r["k"] for r in lifecycle.unload(source, stored, ["k"]).collect()) == [2, 3]


def test_count_differences(spark):
    t = tables.in_memory(spark, dataset())
    expected = lifecycle.row_counts(t)
    assert lifecycle.count_differences(t, expected).count() == 0
    off = expected.withColumn("row_count", F.when(F.col("table_name") == "product", 9).otherwise(F.col("row_count")))
    assert [r["table_name"] for r in lifecycle.count_differences(t, off).collect()] == ["product"]


def test_results_are_written_per_case(spark, tmp_path):
    lifecycle.write_results({"a": spark.range(2)}, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted(r["row"] for r in back.collect()) == ['{"id":0}', '{"id":1}']
    assert {(r["case_id"], r["columns"]) for r in back.collect()} == {("a", "id")}


def test_enforce_schema(spark):
    schema = SCHEMAS["consumer"]
    df = tables.in_memory(spark, dataset())["consumer"]
    shuffled = df.select(*reversed(df.columns)).withColumn("consumer_id", F.col("consumer_id").cast("int"))
    assert [(f.name, f.dataType) for f in tables.enforce_schema(shuffled, schema).schema] == [(f.name, f.dataType) for f in schema]
    with pytest.raises(ValueError):
        tables.enforce_schema(df.drop("status"), schema)
    assert tables.existing_tables(["consumer", "x"])[1] == ["x"]


def _dataset(folder, **changes):
    stamp = "1997-01-01 00:00:00.000000"
    org = {"external_organization_id": "o1", "organization_name": "A", "status": "active", "registered_at": stamp, "closed_at": None,
           "is_test": False, "recorded_at": stamp, "updated_at": stamp}
    merchant = {"merchant_id": 7, "external_merchant_id": "m1", "organization_id": {"table": "organization", "record_id": "org-a"}, "merchant_name": "M",
                "status": "active", "assignment_valid_from": stamp, "is_test": False, "recorded_at": stamp, "updated_at": stamp}
    tables_ = [
        {"table_name": "organization", "match_columns": ["external_organization_id"], "records": [{"record_id": "org-a", "values": org}]},
        {"table_name": "merchant", "match_columns": ["external_merchant_id", "assignment_valid_from"], "records": [{"record_id": "mer-a", "values": merchant | changes}]},
    ]
    (folder / "identity.json").write_text(json.dumps({"source_id": "identity", "tables": tables_}, indent=2))
    (folder / "manifest.json").write_text(json.dumps({
        "dataset_id": "d", "dataset_version": "1.0.0", "snapshot_cutoff": "1997-07-15T07:00:00Z", "source_files": ["identity.json"],
        "table_order": ["organization", "merchant"], "expected_row_counts": {"organization": 1, "merchant": 1},
    }))
    return str(folder)


def test_nested_dataset_becomes_typed_tables(spark, tmp_path):
    root = _dataset(tmp_path)
    manifest = nested.read_manifest(spark, root)
    assert manifest.head()["snapshot_cutoff"] == datetime(1997, 7, 15, 7)
    records = nested.read_records(spark, root, manifest.head()["source_files"])
    assert nested.structure_problems(records, manifest).count() == 0
    typed = nested.typed_tables(records)
    org, merchant = typed["organization"].head(), typed["merchant"].head()
    assert merchant["organization_id"] == org["organization_id"] and merchant["merchant_id"] == 7
    assert org["registered_at"] == datetime(1997, 1, 1) and org["is_test"] is False and org["closed_at"] is None
    assert nested.match_columns(records)["merchant"] == ["external_merchant_id", "assignment_valid_from"]


def test_structure_problems_are_named(spark, tmp_path):
    root = _dataset(tmp_path, organization_id={"table": "organization", "record_id": "gone"})
    records = nested.read_records(spark, root, ["identity.json", "identity.json"]).limit(3)
    found = {r["problem"] for r in nested.structure_problems(records, nested.read_manifest(spark, root)).collect()}
    assert {"unresolved_reference"} <= found
    (tmp_path / "copy.json").write_text((tmp_path / "identity.json").read_text().replace("organization\"", "person\""))
    both = nested.read_records(spark, root, ["identity.json", "copy.json"])
    found = {(r["problem"], r["detail"]) for r in nested.structure_problems(both, nested.read_manifest(spark, root)).collect()}
    assert {("source_in_two_files", "identity"), ("table_order", "person")} <= found
    twice = records.unionByName(records)
    assert {"duplicate_record", "row_count"} <= {r["problem"] for r in nested.structure_problems(twice, nested.read_manifest(spark, root)).collect()}


def test_written_tables_read_back_and_are_ranged_by_time(spark, tmp_path):
    source = tables.in_memory(spark, dataset())
    root = str(tmp_path / "model")
    tables.write_tables(source, root, ["commerce_order", "consumer"])
    back = tables.read_tables(spark, root)
    for name in ("commerce_order", "consumer"):
        assert sorted(map(repr, back[name].collect())) == sorted(map(repr, source[name].collect()))
    plan = back["commerce_order"].filter(F.col("first_paid_at") >= F.lit("1997-06-01").cast("timestamp_ntz"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(first_paid_at" in text.split("PushedFilters")[1]
