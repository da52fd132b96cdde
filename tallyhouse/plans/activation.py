"""Activation cohorts: at least two of three conditions within 14 days of registration."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Params, Period, instant, label_of
from tallyhouse.functions.money import safe_ratio
from tallyhouse.operators.attribution import latest_results, with_channel_code
from tallyhouse.operators.blocks import (
    conditions_met,
    exclude_test_chain,
    real,
    stack,
    visible,
)
from tallyhouse.plans.saas import along_paid_chain, succeeded_payments

# Fixed values of the activation rule.
CONDITIONS = ("member_invite", "campaign_created", "completed_order")
WINDOW_DAYS = 14
NEEDED = 2

TablesMap = Mapping[str, DataFrame]


def cohort(t: TablesMap, p: Params, registered: Period) -> DataFrame:
    orgs = real(visible(t["organization"], p.snapshot_cutoff)).filter(registered.holds(F.col("registered_at")))
    ends = F.col("registered_at") + F.expr(f"INTERVAL {WINDOW_DAYS} DAYS")
    return orgs.select(
        "organization_id", "registered_at", ends.alias("window_ends_at"),
        (ends <= instant(p.activation_as_of)).alias("is_mature"),
    )


def condition_events(t: TablesMap, p: Params, registered: Period) -> DataFrame:
    """(organization_id, condition_name, happened_at), seen and happened in time.

    No member's window reaches outside the registration period plus the window's length, so
    that span is filtered at the scans.
    """
    possible = Period("possible", registered.start, min(registered.end + timedelta(days=WINDOW_DAYS), p.activation_as_of))
    invited = real(visible(t["organization_member"], p.snapshot_cutoff)).select(
        "organization_id", F.lit("member_invite").alias("condition_name"), F.col("first_invited_at").alias("happened_at")
    )
    created = real(visible(t["marketing_campaign"], p.snapshot_cutoff)).select(
        "organization_id", F.lit("campaign_created").alias("condition_name"), F.col("created_at").alias("happened_at")
    )
    done = visible(t["commerce_order"], p.snapshot_cutoff).filter("status = 'completed'")
    done = exclude_test_chain(done, [(t["consumer"], "consumer_id")]).join(
        real(t["merchant"]).select("merchant_assignment_id", "organization_id"), "merchant_assignment_id"
    ).select("organization_id", F.lit("completed_order").alias("condition_name"), F.col("completed_at").alias("happened_at"))
    return stack(invited, created, done).filter(possible.holds(F.col("happened_at")))


def activation_counts(t: TablesMap, p: Params, registered: Period) -> DataFrame:
    return conditions_met(
        cohort(t, p, registered), "organization_id", "registered_at", "window_ends_at",
        condition_events(t, p, registered), CONDITIONS,
    )


def _measures() -> list[Column]:
    mature, met = F.col("is_mature"), F.col("condition_count") >= NEEDED
    return [
        F.sum(mature.cast("long")).alias("mature_organization_count"),
        F.sum((mature & met).cast("long")).alias("activated_organization_count"),
        F.sum((~mature).cast("long")).alias("pending_organization_count"),
    ]


def _rate() -> Column:
    return safe_ratio(F.col("activated_organization_count"), F.col("mature_organization_count")).alias("activation_rate")


def activation_rate(t: TablesMap, p: Params) -> DataFrame:
    return activation_counts(t, p, p.quarter(2)).agg(*_measures()).select("*", _rate())


def activation_stages(t: TablesMap, p: Params) -> DataFrame:
    """Mature organizations by number of conditions met, capped at two; empty stages appear."""
    counts = activation_counts(t, p, p.quarter(2)).filter("is_mature")
    stage = F.least("condition_count", F.lit(NEEDED))
    wide = counts.agg(
        F.count(F.lit(1)).alias("cohort_size"), *[F.count_if(stage == s).alias(f"stage_{s}") for s in range(NEEDED + 1)]
    )
    stages = F.array(*[F.struct(F.lit(s).alias("condition_stage"), F.col(f"stage_{s}").alias("organization_count")) for s in range(NEEDED + 1)])
    return wide.select("cohort_size", F.inline(stages)).select(
        "condition_stage", "organization_count",
        safe_ratio(F.col("organization_count"), F.col("cohort_size")).alias("cohort_share"),
    ).orderBy("condition_stage")


def activation_by_cohort(t: TablesMap, p: Params) -> DataFrame:
    months = p.months(5, 6)
    both = Period("both", months[0].start, months[1].end)
    counts = activation_counts(t, p, both).withColumn("cohort_month", label_of(F.col("registered_at"), months))
    return counts.groupBy("cohort_month").agg(
        F.count(F.lit(1)).alias("registered_organization_count"), *_measures()
    ).select("*", _rate()).orderBy("cohort_month")


def activation_by_channel(t: TablesMap, p: Params) -> DataFrame:
    """Mature cohort members that paid for the first time, by the channel of that payment."""
    quarter = p.quarter(2)
    first = latest_results(
        t["attributed_conversion"], p.snapshot_cutoff, ["saas_first_payment"],
        ["organization_id", "marketing_channel_id", "conversion_at"],
    ).filter(quarter.holds(F.col("conversion_at")))
    first = really_paid(first, t)
    first = with_channel_code(first, t["marketing_channel"], exclude_test=False)
    counts = activation_counts(t, p, quarter).filter("is_mature").select("organization_id", "condition_count")
    joined = first.select("organization_id", "channel_code").join(counts, "organization_id")
    activated = F.when(F.col("condition_count") >= NEEDED, F.col("organization_id"))
    return joined.groupBy("channel_code").agg(
        F.count_distinct("organization_id").alias("new_paying_organization_count"),
        F.count_distinct("organization_id").alias("mature_organization_count"),
        F.count_distinct(activated).alias("activated_organization_count"),
    ).select("*", _rate()).orderBy("channel_code")


def really_paid(results: DataFrame, t: TablesMap) -> DataFrame:
    """Results of a succeeded non-test payment along a test-free chain, with its fee `amount`."""
    payments = succeeded_payments(t).select(
        "invoice_payment_attempt_id", "subscription_invoice_id", F.col("subscription_fee_amount").alias("amount")
    )
    return along_paid_chain(results.join(payments, "invoice_payment_attempt_id"), t)
