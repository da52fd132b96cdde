from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.attribution import append_results, attribute, attribute_at, latest_results, reattribute
from tallyhouse.sources.tables import in_memory
from tests.sample import PARAMS, at, channel, dataset, touch

CUTOFF = PARAMS.snapshot_cutoff
PAID = at(5, 10)  # the sample's only payment


def run(spark, rows, cutoffs=(CUTOFF,), types=("saas_first_payment",), **options):
    results = attribute(in_memory(spark, rows), list(cutoffs), PARAMS.history_start, types, **options)
    return sorted(results.collect(), key=lambda r: (r["conversion_type"], r["attributed_conversion_id"]))


def outcome(spark, rows, **options):
    (row,) = run(spark, rows, **options)
    return row["attribution_result"], row["selected_marketing_touch_id"], row["marketing_channel_id"]


def test_window_is_closed_on_both_sides(spark):
    rows = dataset()
    for offset, expected in [
        (timedelta(0), "non_direct"), (timedelta(hours=168), "non_direct"),
        (timedelta(hours=168, microseconds=1), "direct"), (timedelta(microseconds=-1), "direct"),
    ]:
        rows["marketing_touch"] = [touch(1, PAID - offset, organization_id=1)]
        assert outcome(spark, rows)[0] == expected, offset


def test_tie_goes_to_the_greatest_source_id_by_bytes(spark):
    rows = dataset()
    tied = at(5, 8)
    rows["marketing_touch"] = [
        touch(1, tied, organization_id=1, source_event_id="x-Z"), touch(2, tied, organization_id=1, source_event_id="x-a"),
        touch(3, tied, organization_id=1, source_event_id="x-B"),
    ]
    assert outcome(spark, rows)[1] == 2


def test_late_touch_wins_only_at_the_later_cutoff(spark):
    rows = dataset()
    rows["marketing_touch"] = [touch(1, at(5, 9), organization_id=1, processed_at=at(6, 20), recorded_at=at(6, 21))]
    early = at(6, 1)
    first, second = run(spark, rows, cutoffs=[early, CUTOFF])
    assert [first["attribution_result"], second["attribution_result"]] == ["direct", "non_direct"]
    assert first["marketing_channel_id"] == 2 and first["selected_marketing_touch_id"] is None


def test_no_result_before_the_conversion(spark):
    assert run(spark, dataset(), cutoffs=[at(5, 9)]) == []


@pytest.mark.parametrize("change", [
    {"quality_status": "rejected"}, {"touch_type": "direct"}, {"is_test": True}, {"processed_at": None},
    {"recorded_at": datetime(1999, 1, 1)}, {"marketing_channel_id": 2}, {"marketing_channel_id": 3}, {"marketing_channel_id": 4},
    {"marketing_campaign_id": 2}, {"organization_id": 2}, {"organization_id": None, "consumer_id": 1},
])
def test_ineligible_touches_are_passed_over(spark, change):
    rows = dataset()
    rows["marketing_channel"] += [channel(3, "try", "paid", is_test=True), channel(4, "old", "paid", effective_to=at(5, 8))]
    rows["marketing_touch"] = [touch(1, at(5, 9), organization_id=1) | change]
    assert outcome(spark, rows) == ("direct", None, 2)


def test_inactive_channel_counts_while_it_was_valid(spark):
    rows = dataset()
    rows["marketing_channel"] += [channel(4, "old", "paid", status="inactive", effective_to=at(5, 9, 13))]
    rows["marketing_touch"] = [touch(1, at(5, 9), channel_id=4, organization_id=1)]
    assert outcome(spark, rows) == ("non_direct", 1, 4)


def test_campaign_of_another_channel_or_organization_is_refused(spark):
    for change in ({"primary_channel_id": 2}, {"organization_id": 2}, {"is_test": True}):
        rows = dataset()
        rows["marketing_campaign"][0] |= change
        assert outcome(spark, rows)[0] == "direct"


def test_history_edge_is_complete_and_earlier_is_unknown(spark):
    rows = dataset()
    payment = rows["invoice_payment_attempt"][0]
    payment["succeeded_at"] = PARAMS.history_start + timedelta(hours=168)
    assert outcome(spark, rows)[0] == "direct"
    payment["succeeded_at"] -= timedelta(microseconds=1)
    (row,) = run(spark, rows)
    assert (row["attribution_result"], row["reason_code"], row["history_complete"]) == ("unknown_unattributed", "window_history_incomplete", False)
    assert row["marketing_channel_id"] is None


def test_first_payment_is_one_and_revenue_is_all(spark):
    rows = dataset()
    rows["invoice_payment_attempt"].append(rows["invoice_payment_attempt"][0] | {"invoice_payment_attempt_id": 2, "succeeded_at": at(6, 10)})
    kinds = [r["conversion_type"] for r in run(spark, rows, types=("saas_first_payment", "saas_revenue"))]
    assert kinds == ["saas_first_payment", "saas_revenue", "saas_revenue"]


def test_test_lineage_is_marked(spark):
    rows = dataset()
    rows["organization"][0]["is_test"] = True
    assert run(spark, rows)[0]["is_test"] is True


def test_commerce_types(spark):
    found = {(r["conversion_type"], r["commerce_order_id"], r["platform_fee_charge_id"]): r["attribution_result"]
             for r in run(spark, dataset(), types=("commerce_first_payment", "attributed_gmv", "commerce_revenue"))}
    assert found == {
        ("commerce_first_payment", 1, None): "direct", ("attributed_gmv", 1, None): "direct", ("attributed_gmv", 2, None): "non_direct",
        ("commerce_revenue", None, 1): "direct", ("commerce_revenue", None, 2): "non_direct",
    }


def test_append_never_overwrites_and_latest_picks_the_last_cutoff(spark):
    t = in_memory(spark, dataset())
    early = attribute(t, [at(6, 1)], PARAMS.history_start, ["saas_revenue"])
    both = attribute(t, [at(6, 1), CUTOFF], PARAMS.history_start, ["saas_revenue"])
    added = append_results(early, both)
    assert added.count() == 1
    newest = latest_results(early.unionByName(added), CUTOFF, ["saas_revenue"], ["source_data_cutoff_at"]).collect()
    assert [r["source_data_cutoff_at"] for r in newest] == [CUTOFF]
    assert latest_results(both, at(6, 2), ["saas_revenue"], ["source_data_cutoff_at"]).collect()[0]["source_data_cutoff_at"] == at(6, 1)


def test_incremental_run_gives_the_same_rows_as_the_whole_one(spark):
    rows = dataset()
    rows["invoice_payment_attempt"].append(rows["invoice_payment_attempt"][0] | {"invoice_payment_attempt_id": 2, "succeeded_at": at(6, 10)})
    rows["marketing_touch"] += [touch(5, at(6, 10) - timedelta(hours=168), organization_id=1)]
    kinds = ("saas_first_payment", "saas_revenue")
    whole = run(spark, rows, types=kinds)
    later = run(spark, rows, types=kinds, since=at(6, 10))
    assert later == [r for r in whole if r["conversion_at"] >= at(6, 10)]
    assert [(r["conversion_type"], r["selected_marketing_touch_id"]) for r in later] == [("saas_revenue", 5)]


def test_every_result_is_resolved_at_its_own_cutoff(spark):
    t = in_memory(spark, _many())
    cutoffs = [at(4, 20), at(5, 20), at(6, 1), at(6, 12), CUTOFF]
    whole = attribute(t, cutoffs, PARAMS.history_start)
    fact = F.coalesce("invoice_payment_attempt_id", "commerce_order_id", "platform_fee_charge_id").cast("string")
    kept = whole.withColumn("fact_key", fact).filter(F.pmod(F.xxhash64("attributed_conversion_id"), F.lit(3)) > 0)
    asked = kept.select("conversion_type", "fact_key", "source_data_cutoff_at")
    extra = spark.createDataFrame([("saas_revenue", "404", CUTOFF)], asked.schema)  # no such fact
    got = attribute_at(t, asked.unionByName(asked).unionByName(extra), PARAMS.history_start)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, kept.drop("fact_key").collect()))
    assert got.filter("attribution_result = 'non_direct'").count() > 10


def test_reattribution_of_what_became_known_equals_a_whole_run(spark):
    t = in_memory(spark, _many())
    old, new = at(5, 20), at(6, 8)
    stored = attribute(t, [old], PARAMS.history_start)
    got = reattribute(t, stored, old, new, PARAMS.history_start)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, attribute(t, [new], PARAMS.history_start).collect()))


def _many():
    """Payments and touches of two organizations in many orders of happening and becoming known."""
    rng, rows = random.Random(4), dataset()
    rows["invoice_payment_attempt"] = [
        rows["invoice_payment_attempt"][0] | {"invoice_payment_attempt_id": k, "succeeded_at": at(4 + k % 3, 10) + timedelta(hours=7 * k)}
        for k in range(1, 60)]
    rows["marketing_touch"] = [
        touch(k, when, organization_id=1) | {"processed_at": when + lag, "recorded_at": when + lag}
        for k in range(1, 80) for when, lag in [(at(4 + k % 3, 6) + timedelta(hours=5 * k), timedelta(hours=rng.choice([0, 1, 30, 400, 900])))]]
    return rows
