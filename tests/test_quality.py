"""The sample is clean; changing one field makes exactly the expected rule fail."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import business_rules, quality
from tallyhouse.operators.attribution import attribute
from tallyhouse.operators.rules import CHECKS, REFERENCES, UNIQUE
from tallyhouse.schemas import SCHEMAS, primary_key
from tallyhouse.sources.tables import in_memory
from tests.sample import PARAMS, at, dataset, money, spend

MUTATIONS = [
    ("organization", 0, {"status": "closed"}, "closed_status_time"),
    ("organization", 0, {"closed_at": at(1, 1)}, "closed_time"),
    ("organization_member", 0, {"accepted_at": at(4, 1)}, "invite_order"),
    ("organization_member", 0, {"effective_to": at(4, 22)}, "effective_range"),
    ("consumer", 0, {"closed_at": at(1, 1).replace(year=1990)}, "time_order"),
    ("saas_plan_version", 0, {"recurring_amount": money(-1)}, "amount_nonnegative"),
    ("saas_plan_version", 0, {"billing_interval": "weekly"}, "billing_interval"),
    ("subscription", 0, {"cancellation_effective_at": at(5, 1)}, "cancel_order"),
    ("subscription", 0, {"current_period_started_at": at(5, 1), "current_period_ends_at": at(5, 1)}, "period_order"),
    ("subscription_state_event", 1, {"normalized_mrr_after": money(50)}, "expansion_mrr"),
    ("subscription_state_event", 0, {"status_after": "gone"}, "statuses"),
    ("subscription_invoice", 0, {"total_amount": money(1)}, "amount_total"),
    ("subscription_invoice", 0, {"status": "open"}, "status_times"),
    ("subscription_invoice", 0, {"voided_at": at(5, 11)}, "status_times"),
    ("invoice_payment_attempt", 0, {"failed_at": at(5, 11)}, "status_times"),
    ("invoice_payment_attempt", 0, {"attempted_at": at(5, 11)}, "terminal_order"),
    ("product", 0, {"status": "archived"}, "archived_status_time"),
    ("commerce_order", 0, {"first_paid_at": None, "completed_at": None}, "status_times"),
    ("commerce_order", 0, {"fulfilled_at": at(5, 30)}, "completion_order"),
    ("commerce_order_item", 0, {"quantity": 0}, "quantity_positive"),
    ("commerce_refund", 0, {"tax_refund_amount": money(1)}, "amount_total"),
    ("commerce_refund", 0, {"requested_at": at(6, 3)}, "time_order"),
    ("refund_item_allocation", 0, {"currency_code": "EUR"}, "currency"),
    ("platform_fee_charge", 0, {"status": "pending"}, "status_times"),
    ("marketing_channel", 1, {"channel_code": "none"}, "direct_code"),
    ("marketing_campaign", 0, {"merchant_assignment_id": 1}, "saas_no_merchant"),
    ("marketing_campaign", 0, {"ended_at": at(5, 1)}, "lifecycle_times"),
    ("campaign_daily_spend", 0, {"version_number": 2}, "version_lineage"),
    ("marketing_touch", 0, {"consumer_id": 1}, "subject_xor"),
    ("marketing_touch", 0, {"processed_at": at(5, 30)}, "visibility_times"),
]


def test_rule_counts():
    assert sum(map(len, CHECKS.values())) == 116
    assert len(UNIQUE) == 28 and len(REFERENCES) == 35
    assert set(CHECKS) == set(SCHEMAS) and len(SCHEMAS) == 20


@pytest.fixture(scope="module")
def clean(spark):
    t = in_memory(spark, dataset())
    results = attribute(t, [PARAMS.snapshot_cutoff], PARAMS.history_start)
    return t.replacing(attributed_conversion=spark.createDataFrame(results.collect(), SCHEMAS["attributed_conversion"]))


def test_clean_sample_violates_nothing(clean):
    for report in (quality.check_report, quality.unique_report, quality.foreign_key_report):
        assert [r for r in report(clean).collect() if r["violations"]] == []
    names = [n for n in business_rules.RULES if n != "tables_without_test_rows"]
    assert [r for r in business_rules.rule_report(clean, PARAMS, names).collect() if r["violations"]] == []
    assert business_rules.attribution_differs(clean, PARAMS).count() == 0


@pytest.mark.parametrize("table, index, change, rule", MUTATIONS)
def test_one_changed_field_breaks_one_check(spark, table, index, change, rule):
    rows = dataset()
    rows[table][index] |= change
    broken = quality.check(in_memory(spark, rows)[table], primary_key(table), CHECKS[table]).collect()
    assert rule in {r["rule"] for r in broken}
    assert {r["record_id"] for r in broken} == {str(rows[table][index][primary_key(table)])}


def test_unknown_passes_a_check_and_nulls_never_collide(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 5), (4, 5)], "k int, v int")
    assert quality.check(df, "k", {"positive": "v > 10"}).count() == 2
    assert [tuple(r) for r in quality.unique(df, ["v"]).collect()] == [(5, 2)]
    parents = spark.createDataFrame([(7,)], "id int")
    assert quality.foreign_key(df, "v", parents, "id").count() == 2


def _changed(table, index, **change):
    def apply(rows):
        rows[table][index] |= change

    return apply


def _added(table, **row):
    def apply(rows):
        rows[table].append(rows[table][-1] | row)

    return apply


def _spends(*more):
    def apply(rows):
        rows["campaign_daily_spend"] += more

    return apply


DAY = date(1997, 5, 5)
RULE_MUTATIONS = [
    ("recorded_after_cutoff", _changed("product", 0, recorded_at=at(12, 1))),
    ("overlapping_assignments", _added("merchant", merchant_assignment_id=2, assignment_valid_from=at(1, 1))),
    ("wrong_normalization", _changed("subscription_state_event", 1, billing_interval_after="annual")),
    ("wrong_movement", _changed("subscription_state_event", 1, normalized_mrr_after=money(50))),
    ("subscription_without_event", _added("subscription", subscription_id=9)),
    ("current_state_disagrees", _changed("subscription", 0, current_plan_version_id=1)),
    ("paid_without_payment", _changed("invoice_payment_attempt", 0, status="failed")),
    ("item_of_other_merchant", _changed("product", 0, merchant_assignment_id=2)),
    ("allocation_of_other_order", _changed("refund_item_allocation", 0, commerce_order_item_id=2)),
    ("refund_not_reconciled", _changed("refund_item_allocation", 0, allocated_item_amount=money(29))),
    ("campaign_scope_broken", _changed("marketing_campaign", 0, merchant_assignment_id=1)),
    ("campaign_scope_broken", _changed("marketing_campaign", 1, merchant_assignment_id=None)),
    ("spend_before_final", _changed("campaign_daily_spend", 0, finalized_at=at(6, 1))),
    ("spend_version_gap", _spends(spend(3, 1, DAY, 3, 5, days=2, supersedes=1))),
    ("spend_lineage_broken", _spends(spend(3, 1, DAY, 2, 5, days=2, supersedes=2))),
    ("spend_lineage_broken", _spends(spend(3, 1, DAY, 2, 5, days=1, supersedes=1))),
    ("spend_fork", _spends(spend(3, 1, DAY, 2, 5, days=2, supersedes=1), spend(4, 1, DAY, 2, 5, days=2, supersedes=1))),
    ("spend_never_visible", _changed("campaign_daily_spend", 0, recorded_at=at(12, 1))),
    ("touch_subject_broken", _changed("marketing_touch", 0, organization_id=None)),
    ("touch_type_mismatch", _changed("marketing_touch", 0, touch_type="direct")),
    ("touch_campaign_mismatch", _changed("marketing_touch", 0, marketing_campaign_id=2)),
    ("touch_campaign_mismatch", _changed("marketing_touch", 0, organization_id=2)),
]


@pytest.mark.parametrize("rule, mutate", RULE_MUTATIONS)
def test_one_change_breaks_the_business_rule(spark, rule, mutate):
    rows = dataset()
    mutate(rows)
    assert business_rules.RULES[rule](in_memory(spark, rows), PARAMS).count() > 0


CONVERSION_MUTATIONS = [
    ("conversion_disagrees_with_fact", {"organization_id": 2}),
    ("conversion_disagrees_with_fact", {"conversion_at": at(5, 9)}),
    ("conversion_window_wrong", {"window_started_at": at(5, 1)}),
    ("conversion_window_wrong", {"history_complete": False}),
    ("conversion_leaks_test", {"organization_id": 2}),
    ("conversion_times_wrong", {"source_data_cutoff_at": at(5, 1)}),
    ("conversion_times_wrong", {"recorded_at": at(5, 1)}),
    ("selected_links_disagree", {"marketing_channel_id": 2}),
    ("selected_links_disagree", {"marketing_campaign_id": None}),
    ("direct_channel_wrong", {"attribution_result": "direct"}),
    ("unknown_keeps_links", {"attribution_result": "unknown_unattributed"}),
    ("revision_chain_broken", {"model_version": "v0"}),
]


@pytest.mark.parametrize("rule, change", CONVERSION_MUTATIONS)
def test_one_change_breaks_the_conversion_rule(spark, clean, rule, change):
    kept = [r.asDict() for r in clean["attributed_conversion"].filter("conversion_type = 'saas_revenue'").collect()]
    kept[0] |= change
    t = clean.replacing(attributed_conversion=in_memory(spark, {"attributed_conversion": kept})["attributed_conversion"])
    assert business_rules.RULES[rule](t, PARAMS).count() == 1


def test_wrong_result_is_found_by_a_fresh_run(spark, clean):
    kept = [r.asDict() for r in clean["attributed_conversion"].collect()]
    for number, row in enumerate(kept):
        # ids of a dataset have a form of their own
        row["attributed_conversion_id"] = f"row-{number}"
    kept[0]["reason_code"] = "identity_unresolved"
    t = clean.replacing(attributed_conversion=in_memory(spark, {"attributed_conversion": kept})["attributed_conversion"])
    found = business_rules.attribution_differs(t, PARAMS).collect()
    assert [r["record_id"] for r in found] == [kept[0]["attributed_conversion_id"]]


def test_revisions_must_be_recorded_in_cutoff_order(spark, clean):
    (first,) = [r.asDict() for r in clean["attributed_conversion"].filter("conversion_type = 'saas_revenue'").collect()]
    earlier = first | {"attributed_conversion_id": "x", "source_data_cutoff_at": at(6, 1), "recorded_at": first["recorded_at"] + timedelta(days=1)}
    t = clean.replacing(attributed_conversion=in_memory(spark, {"attributed_conversion": [first, earlier]})["attributed_conversion"])
    assert business_rules.RULES["revision_chain_broken"](t, PARAMS).collect()[0]["record_id"] == first["attributed_conversion_id"]


def test_tables_without_test_rows(clean):
    found = {r["record_id"] for r in business_rules.RULES["tables_without_test_rows"](clean, PARAMS).collect()}
    assert found == set(SCHEMAS) - {"organization"}


def test_text_formats(spark):
    cells = spark.createDataFrame([
        ("a", "recorded_at", "1997-01-01 00:00:00.000000"), ("b", "recorded_at", "1997-01-01 00:00:00"),
        ("c", "recorded_at", "2001-01-01 00:00:00.000000"), ("d", "fee_amount", "1.0000"), ("e", "fee_amount", "1.0"),
        ("f", "normalized_mrr_after", "-1.0000"), ("g", "effective_from", "1997-02-30 00:00:00.000000"), ("h", "status", "x"), ("i", "paid_at", None),
    ], "record_id string, column_name string, value string")
    found = {r["record_id"]: r["problem"] for r in business_rules.format_violations(cells, PARAMS.snapshot_cutoff).collect()}
    assert found == {"b": "not_an_instant", "c": "after_snapshot", "e": "not_money", "f": "not_money", "g": "not_an_instant"}


def test_text_of_a_cell_is_told_once(spark):
    cells = spark.range(3).select(F.col("id").cast("string").alias("record_id"), F.lit("paid_at").alias("column_name"), F.md5(F.col("id").cast("string")).alias("value"))
    found = business_rules.format_violations(cells, PARAMS.snapshot_cutoff)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert {tuple(r) for r in found.collect()} == {(str(i), "paid_at", "not_an_instant") for i in range(3)}


def test_unique_rules_meet_by_number_and_plain_key(clean):
    plan = quality.unique_report(clean)._jdf.queryExecution().optimizedPlan().toString()
    single = sum(len(columns) == 1 for _, _, columns in UNIQUE)
    assert "Aggregate [number#" in plan and plan.count("to_json") <= 2 * (len(UNIQUE) - single)
