"""Reports over several domains; each fact is aggregated at its own grain first."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Params, Period
from tallyhouse.functions.money import safe_ratio, total, total_if, yes_no
from tallyhouse.operators.attribution import DIRECT, NON_DIRECT, UNKNOWN, latest_results
from tallyhouse.operators.blocks import bucket_by_period, dense_by_period, exclude_test_chain, real, stack
from tallyhouse.plans.commerce import three_facts, charged_fees, merchant_pivot, real_merchants
from tallyhouse.plans.marketing import campaign_spend, campaigns_on_channels
from tallyhouse.plans.saas import paid_fees

TablesMap = Mapping[str, DataFrame]


def revenue_streams_by_period(t: TablesMap, p: Params) -> DataFrame:
    """SaaS and commerce revenue side by side; they are never added up."""
    periods = p.months(4, 6)
    saas = bucket_by_period(paid_fees(t, p), "succeeded_at", periods).select("period", F.col("amount").alias("saas"))
    # a late order still lends its merchant to the fee's test; its consumer is not tested here
    of_orders = exclude_test_chain(
        t["commerce_order"], [(real_merchants(t), "merchant_assignment_id")]
    ).select("commerce_order_id")
    commerce = charged_fees(t, p, of_orders, periods).select("period", F.col("fee").alias("commerce"))
    measures = {
        "saas_revenue": lambda here: total_if(here, F.col("saas")),
        "commerce_revenue": lambda here: total_if(here, F.col("commerce")),
    }
    return dense_by_period(stack(saas, commerce), "period", periods, measures).orderBy("report_month")


def commerce_campaigns(t: TablesMap) -> DataFrame:
    found = campaigns_on_channels(t).filter("business_scope = 'commerce'")
    return found.select("marketing_campaign_id", "merchant_assignment_id")


def seller_roas(t: TablesMap, p: Params) -> DataFrame:
    """Campaign-attributed fee revenue per spend; direct and unknown revenue are shown apart."""
    spend = campaign_spend(t, p, p.quarter_days(2), commerce_campaigns(t)).select("merchant_assignment_id", "spend_amount")
    newest = latest_results(
        t["attributed_conversion"], p.snapshot_cutoff, ["commerce_revenue"],
        ["marketing_campaign_id", "attribution_result", "conversion_at"],
    ).filter(p.quarter(2).holds(F.col("conversion_at")))
    fees = real(t["platform_fee_charge"]).filter("status = 'succeeded'").select(
        "platform_fee_charge_id", "commerce_order_id", "fee_amount"
    )
    sold = exclude_test_chain(t["commerce_order"], [(t["consumer"], "consumer_id")]).select(
        "commerce_order_id", "merchant_assignment_id"
    )
    revenue = newest.join(fees, "platform_fee_charge_id").join(sold, "commerce_order_id").select(
        "merchant_assignment_id", "fee_amount",
        F.when(F.col("attribution_result") != NON_DIRECT, F.col("attribution_result"))
        .when(F.col("marketing_campaign_id").isNotNull(), NON_DIRECT).alias("result"),
    )
    sums = stack(spend, revenue).groupBy("merchant_assignment_id").agg(
        total(F.col("spend_amount")).alias("marketing_spend"),
        total_if(F.col("result") == NON_DIRECT, F.col("fee_amount")).alias("attributed_commerce_revenue"),
        total_if(F.col("result") == DIRECT, F.col("fee_amount")).alias("direct_commerce_revenue"),
        total_if(F.col("result") == UNKNOWN, F.col("fee_amount")).alias("unknown_commerce_revenue"),
    )
    merchants = real_merchants(t).select("merchant_assignment_id", "merchant_id", "merchant_name")
    return sums.join(merchants, "merchant_assignment_id").select(
        "merchant_id", "merchant_name", "marketing_spend", "attributed_commerce_revenue",
        "direct_commerce_revenue", "unknown_commerce_revenue",
        safe_ratio(F.col("attributed_commerce_revenue"), F.col("marketing_spend")).alias("commerce_attributed_roas"),
    ).orderBy("merchant_id")


def seller_growth_quality(t: TablesMap, p: Params) -> DataFrame:
    """Growth of sales next to growth of refunds and of spend."""
    periods = (p.quarter(1), p.quarter(2))
    days = [p.quarter_days(1), p.quarter_days(2)]
    whole = Period("half", days[0].start, days[1].end)
    spend = bucket_by_period(campaign_spend(t, p, whole, commerce_campaigns(t)), "business_date", days).select(
        "period", "merchant_assignment_id", F.col("spend_amount").alias("spend")
    )
    rows = stack(three_facts(t, p, periods, fees=False), spend)
    wide = merchant_pivot(
        rows, t, periods,
        {"{p}_gmv": "gmv_change", "{p}_refund_amount": "refund_change", "{p}_marketing_spend": "marketing_spend_change"},
        {"{p}_gmv": "gmv", "{p}_refund_amount": "refund", "{p}_marketing_spend": "spend"},
    )
    shown = wide.filter("q1_gmv <> 0 OR q2_gmv <> 0 OR q1_marketing_spend <> 0 OR q2_marketing_spend <> 0")
    all_up = (F.col("gmv_change") > 0) & (F.col("refund_change") > 0) & (F.col("marketing_spend_change") > 0)
    return shown.select(
        "merchant_id", "merchant_name", "q1_gmv", "q2_gmv", "gmv_change", "q1_refund_amount", "q2_refund_amount",
        "refund_change", "q1_marketing_spend", "q2_marketing_spend", "marketing_spend_change",
        yes_no(all_up).alias("all_three_increased"),
    ).orderBy(F.desc("gmv_change"), "merchant_id")

