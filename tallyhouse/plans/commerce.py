"""Marketplace metrics: sales volume, refunds, net sales, platform fees."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Params, Period
from tallyhouse.functions.money import money, safe_ratio, total, total_if
from tallyhouse.operators.blocks import (
    bucket_by_period,
    dense_by_period,
    exclude_test_chain,
    owned_by,
    pivot_change,
    real,
    stack,
    visible,
)

TablesMap = Mapping[str, DataFrame]


def real_merchants(t: TablesMap) -> DataFrame:
    return exclude_test_chain(t["merchant"], [(t["organization"], "organization_id")])


def orders(t: TablesMap, p: Params, merchants: bool = True) -> DataFrame:
    """Visible orders of non-test consumers, by default of non-test merchants too."""
    df = exclude_test_chain(visible(t["commerce_order"], p.snapshot_cutoff), [(t["consumer"], "consumer_id")])
    if merchants:
        df = owned_by(df, real_merchants(t), "merchant_assignment_id")
    return df.select("commerce_order_id", "merchant_assignment_id", "first_paid_at", "status")


def items(t: TablesMap) -> DataFrame:
    """Non-test items; their product is tested later, on the few rows a report keeps."""
    return real(t["commerce_order_item"]).select(
        "commerce_order_item_id", "commerce_order_id", "product_id", "product_category_code",
        F.col("discounted_item_amount").alias("gmv"),
    )


def of_real_products(df: DataFrame, t: TablesMap) -> DataFrame:
    return owned_by(df, real(t["product"]), "product_id")


def sold_items(t: TablesMap, sold: DataFrame) -> DataFrame:
    """Items of not cancelled orders, with the order's columns."""
    lines = items(t).join(sold.filter("status <> 'cancelled'"), "commerce_order_id")
    return of_real_products(lines, t)


def refunded_items(t: TablesMap, p: Params, of_orders: DataFrame, periods: Sequence[Period]) -> DataFrame:
    """Refund allocations by the period in which the refund succeeded; cancelled orders count too.

    Refunds are filtered and labelled before any join, so each large table meets a small side.
    """
    refunds = real(visible(t["commerce_refund"], p.snapshot_cutoff)).filter("status = 'succeeded'")
    refunds = bucket_by_period(refunds, "succeeded_at", periods).select(
        "commerce_refund_id", "commerce_order_id", "period"
    )
    allocations = real(t["refund_item_allocation"]).select(
        "commerce_refund_id", "commerce_order_item_id", F.col("allocated_item_amount").alias("refund")
    )
    lines = (
        refunds.join(of_orders, "commerce_order_id")
        .join(allocations, "commerce_refund_id")
        .join(items(t).select("commerce_order_item_id", "product_id", "product_category_code"), "commerce_order_item_id")
    )
    return of_real_products(lines, t)


def charged_fees(t: TablesMap, p: Params, of_orders: DataFrame, periods: Sequence[Period]) -> DataFrame:
    fees = real(visible(t["platform_fee_charge"], p.snapshot_cutoff)).filter("status = 'succeeded'")
    fees = bucket_by_period(fees, "succeeded_at", periods).select(
        "commerce_order_id", "period", F.col("fee_amount").alias("fee")
    )
    return fees.join(of_orders, "commerce_order_id")


def gmv_orders_aov(t: TablesMap, p: Params) -> DataFrame:
    """Orders are counted before items are joined: an order of test items only still counts."""
    sold = bucket_by_period(orders(t, p), "first_paid_at", p.months(6, 6)).filter("status <> 'cancelled'")
    rows = stack(sold.select("commerce_order_id"), sold_items(t, sold).select("gmv"))
    return rows.agg(total(F.col("gmv")).alias("gmv"), F.count_distinct("commerce_order_id").alias("order_count")).select(
        "gmv", "order_count", safe_ratio(F.col("gmv"), F.col("order_count")).alias("aov")
    )


def refund_rate_with_prior_month(t: TablesMap, p: Params) -> DataFrame:
    june, may = p.months(6, 6), p.months(5, 5)[0]
    known = orders(t, p)
    sold = bucket_by_period(known, "first_paid_at", june)
    refunded = refunded_items(t, p, known, june).withColumn("of_prior", may.holds(F.col("first_paid_at")))
    rows = stack(sold_items(t, sold).select("gmv"), refunded.select("refund", "of_prior"))
    return rows.agg(
        total(F.col("refund")).alias("refund_amount"),
        total(F.col("gmv")).alias("gmv"),
        total_if(F.col("of_prior"), F.col("refund")).alias("prior_month_order_refund_amount"),
    ).withColumn("refund_rate", safe_ratio(F.col("refund_amount"), F.col("gmv"))).select(
        "refund_amount", "gmv", "refund_rate", "prior_month_order_refund_amount"
    )


def _per_merchant(rows: DataFrame, t: TablesMap, *measures: str) -> DataFrame:
    """Sums per merchant assignment first; the merchant is joined to the small result."""
    sums = rows.groupBy("merchant_assignment_id").agg(*[total(F.col(m)).alias(m) for m in measures])
    merchants = real_merchants(t).select("merchant_assignment_id", "merchant_id", "merchant_name")
    return sums.join(merchants, "merchant_assignment_id")


def net_sales_by_seller(t: TablesMap, p: Params) -> DataFrame:
    june = p.months(6, 6)
    known = orders(t, p, merchants=False)  # the merchant test is applied to the sums
    sold = sold_items(t, bucket_by_period(known, "first_paid_at", june)).select("merchant_assignment_id", "gmv")
    # this report counts refunds of orders that became visible later, too
    any_order = exclude_test_chain(t["commerce_order"], [(t["consumer"], "consumer_id")]).select(
        "commerce_order_id", "merchant_assignment_id"
    )
    refunded = refunded_items(t, p, any_order, june).select("merchant_assignment_id", "refund")
    return _per_merchant(stack(sold, refunded), t, "gmv", "refund").select(
        "merchant_id", "merchant_name", "gmv", F.col("refund").alias("refund_amount"),
        money(F.col("gmv") - F.col("refund")).alias("merchant_net_sales"),
    ).orderBy("merchant_id")


def gmv_trend(t: TablesMap, p: Params) -> DataFrame:
    """Here orders are counted after items are joined."""
    periods = p.months(1, 6)
    sold = bucket_by_period(orders(t, p), "first_paid_at", periods)
    per_order = sold_items(t, sold).groupBy("period", "commerce_order_id").agg(F.sum("gmv").alias("gmv"))
    measures = {
        "gmv": lambda here: total_if(here, F.col("gmv")),
        "order_count": lambda here: F.count_if(here),
    }
    dense = dense_by_period(per_order, "period", periods, measures)
    return dense.withColumn("aov", safe_ratio(F.col("gmv"), F.col("order_count"))).orderBy("report_month")


def three_facts(t: TablesMap, p: Params, periods: Sequence[Period], fees: bool = True) -> DataFrame:
    """Sales, refunds and fees per merchant assignment and period, stacked at their own grain."""
    known = orders(t, p, merchants=False)
    sold = sold_items(t, bucket_by_period(known, "first_paid_at", periods))
    parts = [
        sold.select("period", "merchant_assignment_id", "gmv"),
        refunded_items(t, p, known, periods).select("period", "merchant_assignment_id", "refund"),
    ]
    if fees:
        parts.append(charged_fees(t, p, known, periods).select("period", "merchant_assignment_id", "fee"))
    return stack(*parts)


def seller_scorecard(t: TablesMap, p: Params) -> DataFrame:
    rows = three_facts(t, p, [p.quarter(2)])
    return _per_merchant(rows, t, "gmv", "refund", "fee").select(
        "merchant_id", "merchant_name", "gmv", F.col("refund").alias("refund_amount"),
        money(F.col("gmv") - F.col("refund")).alias("merchant_net_sales"),
        F.col("fee").alias("platform_transaction_revenue"),
    ).orderBy("merchant_id")


def refund_rate_period_category(t: TablesMap, p: Params) -> DataFrame:
    """Dense month x category; the categories are those of all non-test items."""
    periods = p.months(4, 6)
    known = orders(t, p)
    sold = sold_items(t, bucket_by_period(known, "first_paid_at", periods))
    refunded = refunded_items(t, p, known, periods)
    categories = real(t["commerce_order_item"]).select("product_category_code").distinct()
    rows = stack(
        categories.withColumn("listed", F.lit(True)),
        sold.select("period", "product_category_code", "gmv"),
        refunded.select("period", "product_category_code", "refund"),
    ).withColumnRenamed("product_category_code", "category_code")
    measures = {
        "gmv": lambda here: total_if(here, F.col("gmv")),
        "refund_amount": lambda here: total_if(here, F.col("refund")),
        "listed": lambda here: F.max("listed"),
    }
    dense = dense_by_period(rows, "period", periods, measures, ["category_code"]).filter("listed")
    return dense.select(
        "report_month", "category_code", "gmv", "refund_amount",
        safe_ratio(F.col("refund_amount"), F.col("gmv")).alias("refund_rate"),
    ).orderBy("report_month", "category_code")


def merchant_pivot(rows: DataFrame, t: TablesMap, periods: tuple[Period, Period], measures: Mapping[str, str],
                   sums: Mapping[str, str]) -> DataFrame:
    """Per assignment and period first, then over the assignments of one merchant."""
    columns = sorted({c for c in rows.columns if c not in ("period", "merchant_assignment_id")})
    small = rows.groupBy("period", "merchant_assignment_id").agg(*[total(F.col(c)).alias(c) for c in columns])
    merchants = real_merchants(t).select("merchant_assignment_id", "merchant_id", "merchant_name")
    named = small.join(merchants, "merchant_assignment_id")
    return pivot_change(
        named, ["merchant_id", "merchant_name"], "period", periods, measures,
        {pattern: F.expr(text) for pattern, text in sums.items()},
    )


def seller_growth_pivot(t: TablesMap, p: Params) -> DataFrame:
    periods = (p.quarter(1), p.quarter(2))
    wide = merchant_pivot(
        three_facts(t, p, periods), t, periods,
        {
            "{p}_gmv": "gmv_change",
            "{p}_merchant_net_sales": "merchant_net_sales_change",
            "{p}_platform_revenue": "platform_revenue_change",
        },
        {"{p}_gmv": "gmv", "{p}_merchant_net_sales": "gmv - refund", "{p}_platform_revenue": "fee"},
    )
    return wide.filter("q1_gmv <> 0 OR q2_gmv <> 0").select(
        "merchant_id", "merchant_name", "q1_gmv", "q2_gmv", "gmv_change",
        "q1_merchant_net_sales", "q2_merchant_net_sales", "merchant_net_sales_change",
        "q1_platform_revenue", "q2_platform_revenue", "platform_revenue_change",
    ).orderBy(F.desc("gmv_change"), "merchant_id")
