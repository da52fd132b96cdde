"""Subscription metrics: recurring revenue snapshots, movements, churn, paid revenue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Params, Period, instant, span_of
from tallyhouse.functions.money import money, safe_ratio, total, total_if
from tallyhouse.operators.blocks import (
    append_total,
    bucket_by_period,
    dense_by_period,
    exclude_test_chain,
    owned_by,
    real,
    stack,
    state_as_of,
    states_at,
    visible,
)

# The statuses in which a subscription still counts.
LIVE_STATUSES = ("active", "cancel_scheduled")
STATE_COLUMNS = ("organization_id", "status_after", "plan_version_after_id", "normalized_mrr_after")

MONEY_SUM = "decimal(29,4)"

TablesMap = Mapping[str, DataFrame]


def real_subscriptions(t: TablesMap) -> DataFrame:
    subscriptions = exclude_test_chain(t["subscription"], [(t["organization"], "organization_id")])
    return subscriptions.select("subscription_id", "organization_id")


def state_events(t: TablesMap, p: Params) -> DataFrame:
    """Visible non-test events of non-test subscriptions, with their organization."""
    return real(visible(t["subscription_state_event"], p.snapshot_cutoff)).join(
        real_subscriptions(t), "subscription_id"
    )


def snapshots(events: DataFrame, as_ofs: Mapping, label: str = "as_of") -> DataFrame:
    """State per subscription strictly before each instant, whatever its status is."""
    return state_as_of(
        events, ["subscription_id"], "effective_at", "subscription_state_event_id",
        as_ofs, STATE_COLUMNS, label,
    )


def live(snapshot: DataFrame) -> DataFrame:
    """Applied after ranking: a later cancelled state must hide an earlier active one."""
    return snapshot.filter(_is_live("status_after", "normalized_mrr_after"))


def _is_live(status: str, mrr: str) -> Column:
    return F.col(status).isin(*LIVE_STATUSES) & (F.col(mrr) > 0)


def with_plan(df: DataFrame, t: TablesMap, plan_key: str, *columns: str) -> DataFrame:
    plans = real(t["saas_plan_version"]).select(F.col("saas_plan_version_id").alias(plan_key), *columns)
    return df.join(plans, plan_key)


def cancellations(t: TablesMap, p: Params, events: DataFrame | None = None) -> DataFrame:
    events = state_events(t, p) if events is None else events
    return events.filter("event_type = 'cancellation_effective'")


def along_paid_chain(payments: DataFrame, t: TablesMap) -> DataFrame:
    """Payments whose invoice and subscription are no test data, looked up outwards from the payments."""
    invoices = real(t["subscription_invoice"]).select("subscription_invoice_id", "subscription_id")
    subscriptions = real(t["subscription"]).select("subscription_id", F.col("organization_id").alias("paying_organization_id"))
    return payments.join(invoices, "subscription_invoice_id").join(subscriptions, "subscription_id")


def succeeded_payments(t: TablesMap) -> DataFrame:
    return real(t["invoice_payment_attempt"]).filter("status = 'succeeded'")


def paid_fees(t: TablesMap, p: Params) -> DataFrame:
    """Succeeded subscription payments along a test-free chain: (succeeded_at, amount)."""
    payments = visible(succeeded_payments(t), p.snapshot_cutoff).select(
        "subscription_invoice_id", "succeeded_at", F.col("subscription_fee_amount").alias("amount")
    )
    paid = along_paid_chain(payments, t)
    return owned_by(paid, real(t["organization"]), "paying_organization_id", "organization_id").select("succeeded_at", "amount")


def mrr_by_plan_asof(t: TablesMap, p: Params) -> DataFrame:
    state = live(snapshots(state_events(t, p), {"now": p.month(7)}))
    by_plan = with_plan(state, t, "plan_version_after_id", "plan_name").groupBy("plan_name").agg(
        money(F.sum("normalized_mrr_after")).alias("mrr"),
    ).withColumn("arr", money(F.col("mrr") * 12))
    totals = {"mrr": total(F.col("mrr")), "arr": money(F.coalesce(F.sum("mrr"), F.lit(0)) * 12)}
    return append_total(by_plan, "plan_name", "TOTAL", totals).orderBy("sort_order", "plan_name").drop("sort_order")


def _sum_by_month(df: DataFrame, ts: str, periods: Sequence[Period], amount: str, name: str) -> DataFrame:
    labelled = bucket_by_period(df, ts, periods)
    measures = {name: lambda here: total_if(here, F.col(amount))}
    return dense_by_period(labelled, "period", periods, measures).orderBy("report_month")


def paid_revenue_by_period(t: TablesMap, p: Params) -> DataFrame:
    return _sum_by_month(paid_fees(t, p), "succeeded_at", p.months(4, 6), "amount", "saas_revenue")


def churned_mrr_by_period(t: TablesMap, p: Params) -> DataFrame:
    lost = with_plan(cancellations(t, p), t, "plan_version_before_id")
    return _sum_by_month(lost, "effective_at", p.months(4, 6), "normalized_mrr_before", "churned_mrr")


def mrr_snapshot_trend(t: TablesMap, p: Params) -> DataFrame:
    ends = {m.label: m.end for m in p.months(1, 6)}
    state = live(snapshots(state_events(t, p), ends, "report_month"))
    return (
        with_plan(state, t, "plan_version_after_id", "plan_name")
        .groupBy("report_month", "plan_name")
        .agg(money(F.sum("normalized_mrr_after")).alias("mrr"))
        .withColumn("arr", money(F.col("mrr") * 12))
        .orderBy("report_month", "plan_name")
    )


def mrr_bridge(t: TablesMap, p: Params) -> DataFrame:
    """Opening, movements and closing per month, all from one pass over the events.

    A subscription's states at the edges and its movements are aggregated together; the sums
    over subscriptions then unfold into one row per month.
    """
    periods = p.months(5, 6)
    before, after, kind = F.col("normalized_mrr_before"), F.col("normalized_mrr_after"), F.col("event_type")
    moved = {
        "new_mrr": F.when(kind == "first_activation", after),
        "expansion_mrr": F.when(kind == "expansion", after - before),
        "contraction_mrr": F.when(kind == "contraction", before - after),
        "churned_mrr": F.when(kind == "cancellation_effective", before),
    }
    edges = [("opening_mrr", i, q.start) for i, q in enumerate(periods)] + [("closing_mrr", i, q.end) for i, q in enumerate(periods)]
    states = states_at(
        "effective_at", "subscription_state_event_id", [at for _, _, at in edges], ["status_after", "normalized_mrr_after"]
    )
    happened = [q.holds(F.col("effective_at")) for q in periods]
    per_subscription = (
        state_events(t, p)
        .filter(F.col("effective_at") < instant(span_of(periods).end))
        .groupBy("subscription_id")
        .agg(
            *[state.alias(f"{name}_{i}") for state, (name, i, _) in zip(states, edges)],
            *[F.sum(F.when(happened[i], amount)).alias(f"{name}_{i}") for name, amount in moved.items() for i in range(len(periods))],
        )
    )
    live_mrr = {
        f"{name}_{i}": F.when(_is_live(f"{name}_{i}.status_after", f"{name}_{i}.normalized_mrr_after"), F.col(f"{name}_{i}.normalized_mrr_after"))
        for name, i, _ in edges
    }
    order = ["opening_mrr", *moved, "closing_mrr"]
    months = [
        F.struct(F.lit(q.label).alias("report_month"), *[total(F.col(f"{name}_{i}")).alias(name) for name in order])
        for i, q in enumerate(periods)
    ]
    sums = per_subscription.withColumns(live_mrr).agg(F.array(*months).alias("months"))
    return sums.select(F.inline("months")).orderBy("report_month")


def _churn_rows(t: TablesMap, p: Params, periods: Sequence[Period]) -> DataFrame:
    """Rows of a churn report, the events read once: opening MRR by organization and plan, lost MRR by plan.

    (period, organization_id | NULL, plan_id, opening_mrr, ended_live, churned_mrr)

    A subscription's states at all edges and its cancellations are aggregated together, first per period and plan of the
    cancellation, so that what a subscription carries on is bounded by periods times plans.
    """
    edges = [(q, side, at) for q in periods for side, at in (("open", q.start), ("close", q.end))]
    kept = ["organization_id", "status_after", "plan_version_after_id", "normalized_mrr_after"]
    order = ["effective_at", "subscription_state_event_id"]
    states = {f"s{i}": F.when(F.col("effective_at") < instant(at), F.struct(*order, *kept)) for i, (_, _, at) in enumerate(edges)}
    cancelled = F.col("event_type") == "cancellation_effective"
    lost_in = F.filter(F.array(*[F.when(cancelled & q.holds(F.col("effective_at")), F.lit(q.label)) for q in periods]), lambda x: x.isNotNull())
    by_loss = (
        state_events(t, p).withColumn("lost_in", lost_in)
        .withColumn("lost_plan", F.when(F.size("lost_in") > 0, F.col("plan_version_before_id")))
        .groupBy("subscription_id", "lost_in", "lost_plan")
        .agg(*[F.max(state).alias(name) for name, state in states.items()], F.sum("normalized_mrr_before").alias("lost"))
    )
    losses = F.collect_list(F.when(F.size("lost_in") > 0, F.struct("lost_in", "lost_plan", "lost")))
    per_subscription = by_loss.groupBy("subscription_id").agg(*[F.max(name).alias(name) for name in states], losses.alias("losses"))

    def row(period: Column, organization: Column, plan: Column, opening: Column, ended: Column, lost: Column) -> Column:
        return F.struct(period.alias("period"), organization.cast("long").alias("organization_id"), plan.cast("long").alias("plan_id"),
                        opening.cast(MONEY_SUM).alias("opening_mrr"), ended.cast("boolean").alias("ended_live"), lost.cast(MONEY_SUM).alias("churned_mrr"))

    nothing = F.lit(None)
    found = []
    for i, (q, side, _) in enumerate(edges):
        state = F.col(f"s{i}")
        opening = state["normalized_mrr_after"] if side == "open" else nothing
        ended = nothing if side == "open" else F.lit(True)
        plan = state["plan_version_after_id"] if side == "open" else nothing
        found.append(F.when(_is_live(f"s{i}.status_after", f"s{i}.normalized_mrr_after"),
                            row(F.lit(q.label), state["organization_id"], plan, opening, ended, nothing)))
    lost = F.flatten(F.transform("losses", lambda x: F.transform(
        x["lost_in"], lambda period: row(period, nothing, x["lost_plan"], nothing, nothing, x["lost"]))))
    rows = per_subscription.select(F.inline(F.concat(F.array_compact(F.array(*found)), lost)))
    by_plan = rows.groupBy("period", "organization_id", "plan_id").agg(
        F.sum("opening_mrr").alias("opening_mrr"), F.max("ended_live").alias("ended_live"), F.sum("churned_mrr").alias("churned_mrr"))
    # the plans of one organization
    fate = Window.partitionBy("period", "organization_id")
    opened = F.when(F.col("opening_mrr").isNotNull(), F.col("organization_id"))
    return by_plan.withColumn("ended_live", F.max("ended_live").over(fate)).select(
        "period", opened.alias("organization_id"), "plan_id", "opening_mrr", "ended_live", "churned_mrr")


def _churn_measures() -> list[Column]:
    churned = F.when(F.col("ended_live").isNull(), F.col("organization_id"))
    return [
        F.count_distinct("organization_id").alias("opening_logos"),
        F.count_distinct(churned).alias("churned_logos"),
        total(F.col("opening_mrr")).alias("opening_mrr"),
        total(F.col("churned_mrr")).alias("churned_mrr"),
    ]


def _churn_report(rows: DataFrame, keys: Sequence[str], shown: Sequence[str]) -> DataFrame:
    """Only groups with an opening population are reported."""
    return (
        rows.groupBy(*keys)
        .agg(*_churn_measures())
        .filter("opening_logos > 0")
        .select(
            *keys, "opening_logos", "churned_logos",
            safe_ratio(F.col("churned_logos"), F.col("opening_logos")).alias("logo_churn_rate"),
            "opening_mrr", "churned_mrr",
            safe_ratio(F.col("churned_mrr"), F.col("opening_mrr")).alias("revenue_churn_rate"),
        )
        .orderBy(*(keys if len(keys) == 1 else keys[1:]))
        .select(*shown, "opening_logos", "churned_logos", "logo_churn_rate", "opening_mrr", "churned_mrr", "revenue_churn_rate")
    )


def churn_rates_by_plan(t: TablesMap, p: Params) -> DataFrame:
    rows = with_plan(_churn_rows(t, p, [p.quarter(2)]), t, "plan_id", "plan_name")
    return _churn_report(rows, ["plan_name"], ["plan_name"])


def enterprise_churn_compare(t: TablesMap, p: Params) -> DataFrame:
    """Quarter baseline against two single months; the end-of-period test spans all tiers."""
    periods = [p.quarter(1, "Q1 baseline"), *p.months(5, 6)]
    rows = with_plan(_churn_rows(t, p, periods), t, "plan_id", "tier_code").filter("tier_code = 'enterprise'")
    position = F.array_position(F.array(*[F.lit(q.label) for q in periods]), F.col("period"))
    rows = rows.withColumn("comparison_period", F.col("period")).withColumn("sort_order", position)
    return _churn_report(rows, ["comparison_period", "sort_order"], ["comparison_period"])


def revenue_vs_mrr(t: TablesMap, p: Params) -> DataFrame:
    """Two independent series; they are never added up."""
    periods = p.months(4, 6)
    paid = bucket_by_period(paid_fees(t, p), "succeeded_at", periods).select("period", "amount")
    state = live(snapshots(state_events(t, p), {m.label: m.end for m in periods}, "period"))
    rows = stack(paid, state.select("period", F.col("normalized_mrr_after").alias("mrr")))
    measures = {
        "saas_revenue": lambda here: total_if(here, F.col("amount")),
        "month_end_mrr": lambda here: total_if(here, F.col("mrr")),
    }
    return dense_by_period(rows, "period", periods, measures).orderBy("report_month")
