"""Marketing metrics over materialised attribution results and the latest visible spend."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Params, Period, instant
from tallyhouse.functions.money import money, safe_ratio, total, total_if, yes_no
from tallyhouse.operators.attribution import (
    DIRECT,
    NON_DIRECT,
    RESULT_ORDER,
    UNKNOWN,
    latest_results,
    with_channel_code,
)
from tallyhouse.operators.blocks import (
    bucket_by_period,
    complete_rows,
    earliest,
    exclude_test_chain,
    inline_rows,
    latest_revision,
    owned_by,
    real,
    share_of_total,
    stack,
    valid_at,
    visible,
)
from tallyhouse.plans.activation import really_paid
from tallyhouse.plans.commerce import real_merchants

TablesMap = Mapping[str, DataFrame]


def visible_spend(t: TablesMap, p: Params, days: Period) -> DataFrame:
    """The highest visible version per campaign and day of the span."""
    in_span = real(t["campaign_daily_spend"]).filter(days.holds(F.col("business_date")))
    return latest_revision(
        in_span, ["marketing_campaign_id", "business_date"], ["version_number"], p.snapshot_cutoff, ["spend_amount"]
    )


def campaign_spend(t: TablesMap, p: Params, days: Period, campaigns: DataFrame) -> DataFrame:
    """Spend summed per campaign and day before the campaign's columns are joined."""
    return visible_spend(t, p, days).join(campaigns, "marketing_campaign_id")


def campaigns_on_channels(t: TablesMap) -> DataFrame:
    channels = real(t["marketing_channel"]).select(F.col("marketing_channel_id").alias("primary_channel_id"), "channel_code")
    return real(t["marketing_campaign"]).join(channels, "primary_channel_id")


def _cac(spend: DataFrame, customers: DataFrame, name: str) -> DataFrame:
    """Spend per new customer by channel; undefined without spend or without customers."""
    rows = stack(spend.select("channel_code", "spend_amount"), customers.select("channel_code", "customer_id"))
    sums = rows.groupBy("channel_code").agg(
        total(F.col("spend_amount")).alias("spend_amount"), F.count_distinct("customer_id").alias("new_customers")
    )
    cac = F.when(F.col("spend_amount") != 0, safe_ratio(F.col("spend_amount"), F.col("new_customers")))
    return sums.withColumn(name, cac).orderBy("channel_code")


def cac_by_channel_saas(t: TablesMap, p: Params) -> DataFrame:
    campaigns = campaigns_on_channels(t).filter("business_scope = 'saas'")
    campaigns = owned_by(campaigns, real(t["organization"]), "organization_id").select("marketing_campaign_id", "channel_code")
    first = latest_results(
        t["attributed_conversion"], p.snapshot_cutoff, ["saas_first_payment"],
        ["organization_id", "marketing_channel_id", "conversion_at"],
    ).filter(p.quarter(2).holds(F.col("conversion_at")))
    first = owned_by(really_paid(first, t), real(t["organization"]), "organization_id")
    customers = with_channel_code(first, t["marketing_channel"]).withColumnRenamed("organization_id", "customer_id")
    return _cac(campaign_spend(t, p, p.quarter_days(2), campaigns), customers, "saas_cac")


def really_ordered(results: DataFrame, t: TablesMap) -> DataFrame:
    """Results of a completed non-test order of a non-test merchant."""
    done = real(t["commerce_order"]).filter("status = 'completed'").select("commerce_order_id", "merchant_assignment_id")
    return owned_by(results.join(done, "commerce_order_id"), real_merchants(t), "merchant_assignment_id")


def cac_by_channel_commerce(t: TablesMap, p: Params) -> DataFrame:
    campaigns = campaigns_on_channels(t).filter("business_scope = 'commerce'")
    campaigns = owned_by(campaigns, real_merchants(t), "merchant_assignment_id").select("marketing_campaign_id", "channel_code")
    first = latest_results(
        t["attributed_conversion"], p.snapshot_cutoff, ["commerce_first_payment"],
        ["consumer_id", "marketing_channel_id", "conversion_at"],
    ).filter(p.quarter(2).holds(F.col("conversion_at")))
    first = owned_by(really_ordered(first, t), real(t["consumer"]), "consumer_id")
    customers = with_channel_code(first, t["marketing_channel"]).withColumnRenamed("consumer_id", "customer_id")
    return _cac(campaign_spend(t, p, p.quarter_days(2), campaigns), customers, "commerce_cac")


def _revenue_results(t: TablesMap, p: Params, kind: str, subject: str, span: Period) -> DataFrame:
    newest = latest_results(
        t["attributed_conversion"], p.snapshot_cutoff, [kind],
        [subject, "marketing_channel_id", "attribution_result", "conversion_at"],
    )
    return newest.filter(span.holds(F.col("conversion_at")))


def attributed_revenue_share(t: TablesMap, p: Params) -> DataFrame:
    """June revenue per scope, channel and result; direct and unknown always appear."""
    june = p.months(6, 6)[0]
    saas = really_paid(_revenue_results(t, p, "saas_revenue", "organization_id", june), t)
    saas = owned_by(saas, real(t["organization"]), "organization_id")
    fees = real(t["platform_fee_charge"]).filter("status = 'succeeded'").select(
        "platform_fee_charge_id", "commerce_order_id", F.col("fee_amount").alias("amount")
    )
    orders = real(t["commerce_order"]).select("commerce_order_id", "merchant_assignment_id")
    commerce = _revenue_results(t, p, "commerce_revenue", "consumer_id", june).join(fees, "platform_fee_charge_id")
    commerce = owned_by(commerce.join(orders, "commerce_order_id"), real_merchants(t), "merchant_assignment_id")
    commerce = owned_by(commerce, real(t["consumer"]), "consumer_id")
    columns = ["marketing_channel_id", "attribution_result", "amount"]
    base = stack(
        saas.select(F.lit("saas").alias("business_scope"), *columns),
        commerce.select(F.lit("commerce").alias("business_scope"), *columns),
    )
    keys = ["business_scope", "channel_code", "attribution_result"]
    by_channel = with_channel_code(base, t["marketing_channel"]).groupBy(*keys).agg(
        money(F.sum("amount")).alias("attributed_revenue")
    )
    spark = by_channel.sparkSession
    required = inline_rows(
        spark, "business_scope string, channel_code string, attribution_result string",
        [(scope, code, code) for scope in ("saas", "commerce") for code in (DIRECT, UNKNOWN)],
    )
    whole = complete_rows(by_channel, required, keys, {"attributed_revenue": money(F.lit(0))})
    share = safe_ratio(F.col("attributed_revenue"), share_of_total("attributed_revenue", ["business_scope"]))
    return whole.withColumn("revenue_share", share).orderBy("business_scope", "attribution_result", "channel_code")


def qualifying_touches(t: TablesMap, p: Params, span: Period) -> DataFrame:
    """Accepted, processed, visible touches of non-test subjects on then-valid channels.

    (business_scope, subject_id, occurred_at)
    """
    touches = visible(t["marketing_touch"], p.snapshot_cutoff, "processed_at", "recorded_at").filter(
        span.holds(F.col("occurred_at")) & (F.col("quality_status") == "accepted")
    )
    touches = exclude_test_chain(
        touches, [], [(t["marketing_campaign"], "marketing_campaign_id"), (t["organization"], "organization_id"), (t["consumer"], "consumer_id")]
    )
    channels = real(t["marketing_channel"]).select("marketing_channel_id", "effective_from", "effective_to")
    touches = touches.join(channels, "marketing_channel_id").filter(
        valid_at(F.col("occurred_at"), F.col("effective_from"), F.col("effective_to"))
    )
    return touches.select(
        F.when(F.col("organization_id").isNotNull(), "saas").otherwise("commerce").alias("business_scope"),
        F.coalesce("organization_id", "consumer_id").alias("subject_id"), "occurred_at",
    )


def touch_to_payment_funnel(t: TablesMap, p: Params) -> DataFrame:
    """Subjects touched in the quarter, and those of them who then paid for the first time.

    "A qualifying touch at or before the payment" holds exactly if the subject's first one is.
    """
    quarter = p.quarter(2)
    touched = qualifying_touches(t, p, quarter).groupBy("business_scope", "subject_id").agg(
        F.min("occurred_at").alias("first_touch_at")
    )
    saas = latest_results(
        t["attributed_conversion"], p.snapshot_cutoff, ["saas_first_payment"], ["organization_id", "conversion_at"]
    )
    saas = owned_by(really_paid(saas, t), real(t["organization"]), "organization_id")
    commerce = latest_results(
        t["attributed_conversion"], p.snapshot_cutoff, ["commerce_first_payment"], ["consumer_id", "conversion_at"]
    )
    commerce = owned_by(really_ordered(commerce, t), real(t["consumer"]), "consumer_id")
    paid = stack(
        saas.select(F.lit("saas").alias("business_scope"), F.col("organization_id").alias("subject_id"), "conversion_at"),
        commerce.select(F.lit("commerce").alias("business_scope"), F.col("consumer_id").alias("subject_id"), "conversion_at"),
    ).filter(quarter.holds(F.col("conversion_at")))
    # the last payment decides: if any is at or after the first touch, that one is
    paid = paid.groupBy("business_scope", "subject_id").agg(F.max("conversion_at").alias("paid_at"))
    both = touched.join(paid, ["business_scope", "subject_id"], "left")
    return both.groupBy("business_scope").agg(
        F.count(F.lit(1)).alias("touched_subject_count"),
        F.count_if(F.col("first_touch_at") <= F.col("paid_at")).alias("first_payment_subject_count"),
    ).orderBy("business_scope")


def spend_up_customers_down(t: TablesMap, p: Params) -> DataFrame:
    days = [Period("may", p.month_day(5), p.month_day(6)), Period("jun", p.month_day(6), p.month_day(7))]
    spans = [Period("may", p.month(5), p.month(6)), Period("jun", p.month(6), p.month(7))]
    campaigns = campaigns_on_channels(t).select("marketing_campaign_id", "business_scope", "channel_code")
    both_months = Period("both", days[0].start, days[1].end)
    spend = bucket_by_period(campaign_spend(t, p, both_months, campaigns), "business_date", days).select(
        "business_scope", "channel_code", "period", "spend_amount"
    )
    kinds = ["saas_first_payment", "commerce_first_payment"]
    # only the result row itself is tested here, not its fact or its channel
    first = latest_results(
        t["attributed_conversion"], p.snapshot_cutoff, kinds,
        ["organization_id", "consumer_id", "marketing_channel_id", "conversion_at"],
    )
    first = with_channel_code(bucket_by_period(first, "conversion_at", spans), t["marketing_channel"], exclude_test=False)
    is_saas = F.col("conversion_type") == "saas_first_payment"
    customers = first.select(
        F.when(is_saas, "saas").otherwise("commerce").alias("business_scope"), "channel_code", "period",
        F.when(is_saas, F.col("organization_id")).otherwise(F.col("consumer_id")).alias("customer_id"),
    )
    in_may, in_jun = F.col("period") == "may", F.col("period") == "jun"
    sums = stack(spend, customers).groupBy("business_scope", "channel_code").agg(
        total_if(in_may, F.col("spend_amount")).alias("may_spend"),
        total_if(in_jun, F.col("spend_amount")).alias("jun_spend"),
        F.count_distinct(F.when(in_may, F.col("customer_id"))).alias("may_customers"),
        F.count_distinct(F.when(in_jun, F.col("customer_id"))).alias("jun_customers"),
    )
    worse = (F.col("jun_spend") > F.col("may_spend")) & (F.col("jun_customers") < F.col("may_customers"))
    return sums.withColumn("spend_up_customers_down", yes_no(worse)).orderBy("business_scope", "channel_code")


def attribution_boundary_cases(t: TablesMap, p: Params) -> DataFrame:
    """Every re-attributed revision, plus one example of each other boundary class and scope.

    A conversion's revisions are one row per cutoff run, so its window stays small.
    """
    results = real(t["attributed_conversion"]).filter(
        (F.col("source_data_cutoff_at") <= instant(p.snapshot_cutoff))
        & (F.col("recorded_at") <= instant(p.snapshot_cutoff))
        & p.quarter(2).holds(F.col("conversion_at"))
    )
    fact = F.coalesce("invoice_payment_attempt_id", "commerce_order_id", "platform_fee_charge_id")
    revisions = Window.partitionBy("conversion_type", fact)
    newest_first = revisions.orderBy(*[F.desc(c) for c in RESULT_ORDER])
    ranked = results.withColumns({
        "is_latest_revision": (F.row_number().over(newest_first) == 1).cast("int"),
        "revision_count": F.count(F.lit(1)).over(revisions),
    })
    channels = t["marketing_channel"].select("marketing_channel_id", "channel_code", F.col("status").alias("channel_status"))
    ranked = ranked.join(channels, "marketing_channel_id", "left")
    case = (
        F.when(~F.col("history_complete"), "history_incomplete_unknown")
        .when(F.col("revision_count") > 1, "late_arriving_re_attribution")
        .when(F.col("window_started_at") == instant(p.history_start), "history_coverage_equality")
        .when((F.col("attribution_result") == NON_DIRECT) & (F.col("channel_status") == "inactive"), "inactive_historical_channel_selected")
        .when(F.col("attribution_result") == DIRECT, "direct_no_eligible_touch")
    )
    ranked = ranked.withColumn("boundary_case", case).filter("boundary_case IS NOT NULL").withColumn(
        "business_scope", F.when(F.col("organization_id").isNotNull(), "saas").otherwise("commerce")
    )
    # a result has one fact: a single join on (kind, id) instead of three on mostly NULL ids
    facts = [
        ("invoice_payment_attempt", "invoice_payment_attempt_id", "external_payment_attempt_id"),
        ("commerce_order", "commerce_order_id", "external_order_id"),
        ("platform_fee_charge", "platform_fee_charge_id", "external_fee_charge_id"),
    ]
    external = stack(*[
        t[table].select(F.lit(table).alias("fact_kind"), F.col(key).alias("fact_id"), F.col(name).alias("authoritative_external_id"))
        for table, key, name in facts
    ])
    kind = F.coalesce(*[F.when(F.col(key).isNotNull(), table) for table, key, _ in facts])
    named = ranked.withColumns({"fact_kind": kind, "fact_id": fact}).join(external, ["fact_kind", "fact_id"], "left")
    kept = [
        "conversion_type", "authoritative_external_id", "conversion_at", "attribution_result", "reason_code",
        "selected_marketing_touch_id", "marketing_campaign_id", "channel_code", "channel_status",
        "source_data_cutoff_at", "is_latest_revision",
    ]
    late = F.col("boundary_case") == "late_arriving_re_attribution"
    groups = ["boundary_case", "business_scope"]
    sampled = earliest(
        named.filter(~late), groups, ["conversion_type", "authoritative_external_id", "source_data_cutoff_at"], kept
    )
    shown = stack(named.filter(late).select(*groups, *kept), sampled)
    touches = t["marketing_touch"].select(F.col("marketing_touch_id").alias("selected_marketing_touch_id"), "source_event_id")
    campaigns = t["marketing_campaign"].select("marketing_campaign_id", "external_campaign_id")
    return (
        shown.join(touches, "selected_marketing_touch_id", "left")
        .join(campaigns, "marketing_campaign_id", "left")
        .select(
            "business_scope", "conversion_type", "authoritative_external_id", "conversion_at", "boundary_case",
            "attribution_result", F.col("reason_code").alias("attribution_reason_code"),
            F.col("source_event_id").alias("selected_touch_source_event_id"),
            F.col("channel_code").alias("selected_channel_code"),
            F.col("channel_status").alias("selected_channel_current_status"),
            F.col("external_campaign_id").alias("selected_campaign_external_id"),
            "source_data_cutoff_at", "is_latest_revision",
        )
        .orderBy("boundary_case", "business_scope", "conversion_type", "authoritative_external_id", "source_data_cutoff_at")
    )
