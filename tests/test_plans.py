"""Metric rules on the sample: visibility, test owners, fan-out and period edges."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from tallyhouse.operators.attribution import attribute
from tallyhouse.plans import activation, commerce, crossdomain, marketing, saas
from tallyhouse.sources.tables import in_memory
from tests.sample import PARAMS, at, bill, dataset, item, order, spend, state, touch


def run(spark, plan, rows, attributed=False):
    t = in_memory(spark, rows)
    if attributed:
        t = t.replacing(attributed_conversion=attribute(t, [PARAMS.snapshot_cutoff], PARAMS.history_start))
    return [r.asDict() for r in plan(t, PARAMS).collect()]


def test_mrr_by_plan_ranks_before_it_filters(spark):
    rows = dataset()
    assert run(spark, saas.mrr_by_plan_asof, rows) == [
        {"plan_name": "Enterprise", "mrr": 100, "arr": 1200}, {"plan_name": "TOTAL", "mrr": 100, "arr": 1200},
    ]
    rows["subscription_state_event"].append(state(3, 1, at(6, 20), "cancellation_effective", 2, 2, 100, 0, "cancelled"))
    assert run(spark, saas.mrr_by_plan_asof, rows) == [{"plan_name": "TOTAL", "mrr": 0, "arr": 0}]


def test_mrr_bridge_closes(spark):
    rows = dataset()
    rows["subscription"].append(rows["subscription"][0] | {"subscription_id": 2, "external_subscription_id": "s2"})
    rows["subscription_state_event"] += [
        state(5, 2, at(5, 3), "first_activation", None, 1, 0, 80), state(6, 2, at(5, 20), "contraction", 1, 1, 80, 30),
        state(7, 2, at(6, 25), "cancellation_effective", 1, 1, 30, 0, "cancelled"),
    ]
    months = run(spark, saas.mrr_bridge, rows)
    assert [(m["opening_mrr"], m["closing_mrr"]) for m in months] == [(50, 80), (80, 100)]
    for m in months:
        moved = m["opening_mrr"] + m["new_mrr"] + m["expansion_mrr"] - m["contraction_mrr"] - m["churned_mrr"]
        assert moved == m["closing_mrr"]


def test_facts_recorded_late_or_of_test_owners_are_left_out(spark):
    late, owned = dataset(), dataset()
    late["invoice_payment_attempt"][0]["recorded_at"] = at(8, 1)
    owned["organization"][0]["is_test"] = True
    plain = run(spark, saas.paid_revenue_by_period, dataset())
    assert [r["saas_revenue"] for r in plain] == [0, 50, 0]
    for rows in (late, owned):
        assert [r["saas_revenue"] for r in run(spark, saas.paid_revenue_by_period, rows)] == [0, 0, 0]


def test_revenue_counts_the_fee_part_in_its_local_month(spark):
    rows = dataset()
    rows["invoice_payment_attempt"].append(rows["invoice_payment_attempt"][0] | {"invoice_payment_attempt_id": 2, **bill(7), "succeeded_at": PARAMS.month(6)})
    assert [r["saas_revenue"] for r in run(spark, saas.paid_revenue_by_period, rows)] == [0, 50, 7]


def test_logo_is_kept_by_any_other_subscription(spark):
    rows = dataset()
    for event in rows["subscription_state_event"]:
        event["effective_at"] = at(3, 1) if event["subscription_state_event_id"] == 1 else at(3, 2)
    rows["subscription_state_event"].append(state(3, 1, at(6, 20), "cancellation_effective", 2, 2, 100, 0, "cancelled"))
    (gone,) = run(spark, saas.churn_rates_by_plan, rows)
    assert (gone["opening_logos"], gone["churned_logos"], gone["logo_churn_rate"], gone["revenue_churn_rate"]) == (1, 1, 1, 1)
    rows["subscription"].append(rows["subscription"][0] | {"subscription_id": 2, "external_subscription_id": "s2"})
    rows["subscription_state_event"].append(state(9, 2, at(5, 3), "first_activation", None, 1, 0, 80))
    (kept,) = run(spark, saas.churn_rates_by_plan, rows)
    assert (kept["churned_logos"], kept["churned_mrr"]) == (0, 100)


def test_gmv_is_not_multiplied_by_items(spark):
    assert run(spark, commerce.gmv_orders_aov, dataset()) == [{"gmv": 100, "order_count": 1, "aov": 100}]


def test_an_order_of_test_items_counts_only_before_the_items_join(spark):
    rows = dataset()
    rows["commerce_order"].append(order(3, at(6, 12)))
    rows["commerce_order_item"].append(item(9, 3, 5, is_test=True))
    assert run(spark, commerce.gmv_orders_aov, rows)[0]["order_count"] == 2
    assert run(spark, commerce.gmv_trend, rows)[5]["order_count"] == 1


def test_refund_of_a_cancelled_order_counts_and_its_sales_do_not(spark):
    rows = dataset()
    rows["commerce_order"][0] |= {"status": "cancelled", "cancelled_at": at(5, 21), "completed_at": None}
    (row,) = run(spark, commerce.refund_rate_with_prior_month, rows)
    assert (row["refund_amount"], row["gmv"], row["refund_rate"], row["prior_month_order_refund_amount"]) == (30, 100, Decimal("0.3000"), 30)
    (card,) = run(spark, commerce.seller_scorecard, rows)
    assert (card["gmv"], card["merchant_net_sales"], card["platform_transaction_revenue"]) == (100, 70, 6)


def test_net_sales_may_be_negative(spark):
    rows = dataset()
    rows["commerce_order"][1]["status"] = "cancelled"
    (row,) = run(spark, commerce.net_sales_by_seller, rows)
    assert row["merchant_net_sales"] == -30


def test_category_grid_is_dense_and_undefined_without_sales(spark):
    rows = dataset()
    rows["commerce_order_item"].append(item(9, 99, 5, product_category_code="orphans"))
    grid = run(spark, commerce.refund_rate_period_category, rows)
    assert len(grid) == 6
    assert [g["refund_rate"] for g in grid if g["category_code"] == "rings"] == [None, 0, Decimal("0.3000")]


def test_cac_takes_the_highest_visible_spend_version(spark):
    rows = dataset()
    rows["campaign_daily_spend"] += [
        spend(3, 1, date(1997, 5, 5), 2, 35, days=9, supersedes=1), spend(4, 1, date(1997, 5, 5), 3, 999, days=300, supersedes=3),
    ]
    (row,) = run(spark, marketing.cac_by_channel_saas, rows, attributed=True)
    assert (row["channel_code"], row["spend_amount"], row["new_customers"], row["saas_cac"]) == ("search", 35, 1, 35)


def test_revenue_shares_sum_to_one_and_required_rows_appear(spark):
    rows = dataset()
    rows["invoice_payment_attempt"][0]["succeeded_at"] = at(6, 12)
    shares = run(spark, marketing.attributed_revenue_share, rows, attributed=True)
    assert {(s["business_scope"], s["channel_code"]) for s in shares} >= {(a, b) for a in ("saas", "commerce") for b in ("direct", "unknown_unattributed")}
    for scope in ("saas", "commerce"):
        assert sum(s["revenue_share"] for s in shares if s["business_scope"] == scope) == 1


def test_funnel_needs_a_touch_at_or_before_the_payment(spark):
    rows = dataset()
    funnel = {r["business_scope"]: r for r in run(spark, marketing.touch_to_payment_funnel, rows, attributed=True)}
    assert funnel["saas"]["first_payment_subject_count"] == 1
    assert funnel["commerce"]["first_payment_subject_count"] == 0  # paid first in May, touched in June
    rows["marketing_touch"].append(touch(3, at(5, 20), channel_id=2, consumer_id=1, touch_type="direct"))
    again = {r["business_scope"]: r for r in run(spark, marketing.touch_to_payment_funnel, rows, attributed=True)}
    assert (again["commerce"]["touched_subject_count"], again["commerce"]["first_payment_subject_count"]) == (1, 1)


def test_activation_needs_two_kinds_of_condition(spark):
    rows = dataset()
    (row,) = run(spark, activation.activation_rate, rows)
    assert (row["mature_organization_count"], row["activated_organization_count"], row["pending_organization_count"], row["activation_rate"]) == (1, 1, 0, 1)
    rows["marketing_campaign"][0]["created_at"] = at(5, 4)  # exactly 14 days after registration: outside
    assert run(spark, activation.activation_rate, rows)[0]["activated_organization_count"] == 0
    assert [s["organization_count"] for s in run(spark, activation.activation_stages, rows)] == [0, 1, 0]


def test_immature_organizations_are_only_pending(spark):
    rows = dataset()
    rows["organization"][0]["registered_at"] = at(6, 25)
    (row,) = run(spark, activation.activation_rate, rows)
    assert (row["mature_organization_count"], row["pending_organization_count"], row["activation_rate"]) == (0, 1, None)


def test_roas_is_undefined_without_spend(spark):
    rows = dataset()
    (row,) = run(spark, crossdomain.seller_roas, rows, attributed=True)
    assert (row["attributed_commerce_revenue"], row["direct_commerce_revenue"], row["commerce_attributed_roas"]) == (3, 3, Decimal("0.3000"))
    rows["campaign_daily_spend"] = []
    assert run(spark, crossdomain.seller_roas, rows, attributed=True)[0]["commerce_attributed_roas"] is None


def test_streams_stay_apart(spark):
    months = run(spark, crossdomain.revenue_streams_by_period, dataset())
    assert [(m["saas_revenue"], m["commerce_revenue"]) for m in months] == [(0, 0), (50, 3), (0, 3)]


def test_boundary_cases(spark):
    rows = dataset()
    t = in_memory(spark, rows)
    t = t.replacing(attributed_conversion=attribute(t, [at(5, 15), PARAMS.snapshot_cutoff], PARAMS.history_start))
    found = [(r["boundary_case"], r["conversion_type"], r["is_latest_revision"]) for r in marketing.attribution_boundary_cases(t, PARAMS).collect()]
    assert ("late_arriving_re_attribution", "saas_revenue", 0) in found
    assert sum(case == "late_arriving_re_attribution" for case, _, _ in found) == 4
    assert sum(case == "direct_no_eligible_touch" for case, _, _ in found) == 1


def test_empty_dataset_gives_neutral_results(spark):
    empty = {}
    assert run(spark, commerce.gmv_orders_aov, empty) == [{"gmv": 0, "order_count": 0, "aov": None}]
    assert [m["closing_mrr"] for m in run(spark, saas.mrr_bridge, empty)] == [0, 0]
    assert len(run(spark, commerce.gmv_trend, empty)) == 6
    assert [s["cohort_share"] for s in run(spark, activation.activation_stages, empty)] == [None, None, None]


def _plan(spark, plan, t):
    return plan(t, PARAMS)._jdf.queryExecution().executedPlan().toString()


def test_plans_push_the_period_and_avoid_loops_and_python(spark, tmp_path):
    from tallyhouse.sources.tables import read_tables, write_tables

    t = in_memory(spark, dataset())
    t = t.replacing(attributed_conversion=attribute(t, [PARAMS.snapshot_cutoff], PARAMS.history_start))
    root = str(tmp_path / "model")
    write_tables(t, root)
    stored = read_tables(spark, root)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    for plan in (commerce.gmv_orders_aov, commerce.seller_growth_pivot, saas.mrr_bridge, marketing.cac_by_channel_saas,
                 marketing.attributed_revenue_share, crossdomain.seller_growth_quality, activation.activation_rate):
        text = _plan(spark, plan, stored)
        for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
            assert unwanted not in text, plan.__name__
    text = _plan(spark, commerce.gmv_orders_aov, stored)
    assert "GreaterThanOrEqual(first_paid_at" in text and "LessThanOrEqual(recorded_at" in text
    assert plan(stored, PARAMS).collect() == plan(t, PARAMS).collect()
