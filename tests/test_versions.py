from __future__ import annotations

import pytest

from tallyhouse.operators.versions import LaterVersion, Store
from tallyhouse.sources import tables
from tests.sample import dataset

MATCH = {"consumer": ["external_consumer_id"], "commerce_order": ["external_order_id"]}
ORDER = ["consumer", "commerce_order"]


def _counts(store, source, version=None):
    return {name: df.count() for name, df in store.read(source, version).items()}


def test_load_is_idempotent_and_old_versions_stay_readable(spark, tmp_path):
    source = tables.in_memory(spark, dataset())
    store = Store(spark, str(tmp_path / "s"))
    assert store.versions() == [] and store.read(source) == {}
    part = {"consumer": source["consumer"].limit(1), "commerce_order": source["commerce_order"].limit(0)}
    assert store.load(part, MATCH, ORDER) == 1
    assert store.load(source, MATCH, ORDER) == 2
    assert store.load(source, MATCH, ORDER) == 2
    whole = {name: source[name].count() for name in ORDER}
    assert _counts(store, source) == whole
    assert _counts(store, source, 1) == {"consumer": 1, "commerce_order": 0}
    assert store.verify(source, MATCH, ORDER).count() == 0
    assert store.verify(source, MATCH, ORDER, 1).count() > 0
    assert store.unload(source, MATCH, ORDER) == 3
    assert _counts(store, source) == {"consumer": 0, "commerce_order": 0}
    with pytest.raises(ValueError, match="missing"):
        store.unload(source, MATCH, ORDER)
    with pytest.raises(ValueError, match="no version"):
        store.read(source, 9)


def test_a_job_killed_between_two_tables_leaves_the_old_version(spark, tmp_path):
    source = tables.in_memory(spark, dataset())
    store = Store(spark, str(tmp_path / "s"))
    part = {"consumer": source["consumer"].limit(0), "commerce_order": source["commerce_order"].limit(1)}
    store.load(part, MATCH, ORDER)

    def die(table):
        if table == "consumer":
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.load(source, MATCH, ORDER, between=die)
    again = Store(spark, str(tmp_path / "s"))
    assert again.versions() == [1]
    assert _counts(again, source) == {"consumer": 0, "commerce_order": 1}
    assert len(again.remove_orphans()) == 1
    assert again.load(source, MATCH, ORDER) == 2
    assert again.verify(source, MATCH, ORDER).count() == 0
    assert again.remove_orphans() == []
    assert _counts(again, source, 1) == {"consumer": 0, "commerce_order": 1}


def test_of_two_loads_at_a_time_one_wins(spark, tmp_path):
    source = tables.in_memory(spark, dataset())
    store = Store(spark, str(tmp_path / "s"))

    def other(table):
        if table == "commerce_order":
            Store(spark, str(tmp_path / "s")).load({"consumer": source["consumer"]}, MATCH, ["consumer"])

    with pytest.raises(LaterVersion):
        store.load(source, MATCH, ORDER, between=other)
    assert _counts(store, source) == {"consumer": source["consumer"].count()}
    assert store.load(source, MATCH, ORDER) == 2
    assert store.verify(source, MATCH, ORDER).count() == 0


def test_a_conflict_in_a_later_table_writes_nothing(spark, tmp_path):
    rows = dataset()
    source = tables.in_memory(spark, rows)
    store = Store(spark, str(tmp_path / "s"))
    store.load({"commerce_order": source["commerce_order"]}, MATCH, ["commerce_order"])
    rows["commerce_order"][0]["status"] = "paid"
    with pytest.raises(ValueError, match="differs"):
        store.load(tables.in_memory(spark, rows), MATCH, ORDER)
    assert store.versions() == [1] and store.remove_orphans() == []
    rows["commerce_order"].append(rows["commerce_order"][0])
    with pytest.raises(ValueError, match="not unique"):
        store.load(tables.in_memory(spark, rows), MATCH, ORDER)
