"""Rules across rows and tables. Each returns its violating rows as (record_id)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Params, instant
from tallyhouse.operators.asof import previous_row
from tallyhouse.operators.attribution import (
    ALL_TYPES,
    DIRECT,
    LOOK_BACK_HOURS,
    MODEL_VERSION,
    UNKNOWN,
    attribute_at,
    conversions,
)
from tallyhouse.operators.blocks import latest, stack, valid_at
from tallyhouse.operators.intervals import overlapping
from tallyhouse.schemas import SCHEMAS, primary_key

TablesMap = Mapping[str, DataFrame]
Rule = Callable[[TablesMap, Params], DataFrame]

# Fixed formats of dataset text: a UTC instant with microseconds, money with four decimals.
INSTANT_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}$"
MONEY_TEXT = r"^[0-9]+\.[0-9]{4}$"


def _ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("record_id"))


def _fact_id() -> Column:
    return F.coalesce("invoice_payment_attempt_id", "commerce_order_id", "platform_fee_charge_id")


_TIME_NAMES = ("effective_from", "effective_to", "assignment_valid_from", "assignment_valid_to")


def has_format(column_name: str) -> bool:
    """Whether dataset text of this column has a fixed form; no other column is checked."""
    return column_name.endswith(("_at", "_amount")) or column_name in _TIME_NAMES or column_name.startswith("normalized_mrr_")


def format_violations(cells: DataFrame, cutoff: datetime) -> DataFrame:
    """Checks dataset text: cells (record_id, column_name, value) -> (record_id, column_name, problem)."""
    name, value = F.col("column_name"), F.col("value")
    is_time = name.endswith("_at") | name.isin(*_TIME_NAMES)
    is_money = name.endswith("_amount") | name.startswith("normalized_mrr_")
    parsed = F.expr("try_cast(value AS timestamp_ntz)")
    problem = (
        F.when(value.isNull(), None)
        .when(is_time & (~value.rlike(INSTANT_TEXT) | parsed.isNull()), "not_an_instant")
        .when((name == "recorded_at") & (parsed > instant(cutoff)), "after_snapshot")
        .when(is_money & ~value.rlike(MONEY_TEXT), "not_money")
        .when(is_money & F.expr("try_cast(value AS decimal(19,4))").isNull(), "not_decimal")
    )
    # unfolded, not selected: a filter on a selected problem is pushed below it with the whole expression of `value` in each of its uses
    return cells.select("record_id", "column_name", F.explode(F.array(problem)).alias("problem")).filter("problem IS NOT NULL")


def text_cells(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A typed table, or the named columns of it, as dataset text, one row per cell."""
    def text(field) -> Column:
        column = F.col(field.name)
        if field.dataType.typeName() == "timestamp_ntz":
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        return column.cast("string")

    wanted = [f for f in df.schema if columns is None or f.name in columns]
    cells = F.array(*[F.struct(F.lit(f.name).alias("column_name"), text(f).alias("value")) for f in wanted])
    return df.select(F.col(key).cast("string").alias("record_id"), F.inline(cells))


def recorded_after_cutoff(t: TablesMap, p: Params) -> DataFrame:
    late = [
        _ids(t[table].filter(F.col("recorded_at") > instant(p.snapshot_cutoff)), primary_key(table))
        for table in SCHEMAS
    ]
    return stack(*late)


def overlapping_assignments(t: TablesMap, p: Params) -> DataFrame:
    """A merchant's assignment starts before any earlier one has ended; equal starts are ordered by id."""
    found = overlapping(t["merchant"], ["merchant_id"], "assignment_valid_from", "assignment_valid_to", "merchant_assignment_id")
    return _ids(found, "merchant_assignment_id")


def wrong_movement(t: TablesMap, p: Params) -> DataFrame:
    before, after, kind = F.col("normalized_mrr_before"), F.col("normalized_mrr_after"), F.col("event_type")
    wrong = (
        ((kind == "expansion") & (after <= before))
        | ((kind == "contraction") & ~((after > 0) & (after < before)))
        | (kind.isin("cancellation_effective", "expiration") & (after != 0))
    )
    return _ids(t["subscription_state_event"].filter(wrong), "subscription_state_event_id")


def wrong_normalization(t: TablesMap, p: Params) -> DataFrame:
    def wrong(side: str) -> Column:
        interval = F.col(f"billing_interval_{side}")
        # compared as twelve months, so that nothing is rounded
        months = F.when(interval == "monthly", F.lit(1)).otherwise(F.lit(12))
        return interval.isNotNull() & (F.col(f"normalized_mrr_{side}") * months != F.col(f"recurring_amount_{side}"))

    return _ids(t["subscription_state_event"].filter(wrong("before") | wrong("after")), "subscription_state_event_id")


def subscription_without_event(t: TablesMap, p: Params) -> DataFrame:
    return _ids(t["subscription"].join(t["subscription_state_event"], "subscription_id", "left_anti"), "subscription_id")


def current_state_disagrees(t: TablesMap, p: Params) -> DataFrame:
    """Current status or plan differs from the latest event's."""
    last = latest(
        t["subscription_state_event"], ["subscription_id"], ["effective_at", "subscription_state_event_id"],
        ["status_after", "plan_version_after_id"],
    )
    same = F.col("current_status").eqNullSafe(F.col("status_after")) & F.col("current_plan_version_id").eqNullSafe(F.col("plan_version_after_id"))
    return _ids(t["subscription"].join(last, "subscription_id").filter(~same), "subscription_id")


def paid_without_payment(t: TablesMap, p: Params) -> DataFrame:
    paid = t["invoice_payment_attempt"].filter("status = 'succeeded'").select("subscription_invoice_id")
    return _ids(t["subscription_invoice"].filter("status = 'paid'").join(paid, "subscription_invoice_id", "left_anti"), "subscription_invoice_id")


def item_of_other_merchant(t: TablesMap, p: Params) -> DataFrame:
    order = t["commerce_order"].select("commerce_order_id", F.col("merchant_assignment_id").alias("order_merchant"))
    product = t["product"].select("product_id", F.col("merchant_assignment_id").alias("product_merchant"))
    joined = t["commerce_order_item"].join(order, "commerce_order_id").join(product, "product_id")
    return _ids(joined.filter("order_merchant <> product_merchant"), "commerce_order_item_id")


def allocation_of_other_order(t: TablesMap, p: Params) -> DataFrame:
    refund = t["commerce_refund"].select("commerce_refund_id", F.col("commerce_order_id").alias("refund_order"))
    item = t["commerce_order_item"].select("commerce_order_item_id", F.col("commerce_order_id").alias("item_order"))
    joined = t["refund_item_allocation"].join(refund, "commerce_refund_id").join(item, "commerce_order_item_id")
    return _ids(joined.filter("refund_order <> item_order"), "refund_item_allocation_id")


def refund_not_reconciled(t: TablesMap, p: Params) -> DataFrame:
    """Allocations do not add up to the refund's item amount; no allocation counts as 0."""
    parts = t["refund_item_allocation"].groupBy("commerce_refund_id").agg(F.sum("allocated_item_amount").alias("parts"))
    joined = t["commerce_refund"].join(parts, "commerce_refund_id", "left")
    return _ids(joined.filter(F.col("item_refund_amount") != F.coalesce("parts", F.lit(0))), "commerce_refund_id")


def campaign_scope_broken(t: TablesMap, p: Params) -> DataFrame:
    """SaaS campaigns name no merchant; commerce ones name one of their own organization."""
    merchant = t["merchant"].select("merchant_assignment_id", F.col("organization_id").alias("merchant_org"))
    joined = t["marketing_campaign"].join(merchant, "merchant_assignment_id", "left")
    saas = F.col("business_scope") == "saas"
    wrong = (saas & F.col("merchant_assignment_id").isNotNull()) | (
        ~saas & ~F.col("merchant_org").eqNullSafe(F.col("organization_id"))
    )
    return _ids(joined.filter(wrong), "marketing_campaign_id")


def spend_before_final(t: TablesMap, p: Params) -> DataFrame:
    return _ids(t["campaign_daily_spend"].filter("finalized_at > recorded_at"), "campaign_daily_spend_id")


def spend_version_gap(t: TablesMap, p: Params) -> DataFrame:
    """Versions of a campaign day are not exactly 1..n, told from aggregates only."""
    chains = t["campaign_daily_spend"].groupBy("marketing_campaign_id", "business_date").agg(
        F.count(F.lit(1)).alias("n"), F.min("version_number").alias("low"), F.max("version_number").alias("high"),
        F.count_distinct("version_number").alias("versions"),
    )
    broken = chains.filter("low <> 1 OR high <> n OR versions <> n")
    return broken.select(F.concat_ws("/", "marketing_campaign_id", "business_date").alias("record_id"))


def spend_lineage_broken(t: TablesMap, p: Params) -> DataFrame:
    """A correction must supersede the version before it, alone, and be recorded later."""
    spend = t["campaign_daily_spend"]
    parent = spend.select(
        F.col("campaign_daily_spend_id").alias("supersedes_campaign_daily_spend_id"),
        F.col("marketing_campaign_id").alias("__campaign"), F.col("business_date").alias("__date"),
        F.col("version_number").alias("__version"), F.col("recorded_at").alias("__recorded"),
    )
    joined = spend.join(parent, "supersedes_campaign_daily_spend_id", "left")
    follows = (
        F.col("__campaign").eqNullSafe(F.col("marketing_campaign_id")) & F.col("__date").eqNullSafe(F.col("business_date"))
        & F.col("__version").eqNullSafe(F.col("version_number") - 1) & (F.col("recorded_at") > F.col("__recorded"))
    )
    first = (F.col("version_number") == 1) & F.col("supersedes_campaign_daily_spend_id").isNull()
    return _ids(joined.filter(~F.coalesce(first | ((F.col("version_number") > 1) & follows), F.lit(False))), "campaign_daily_spend_id")


def spend_fork(t: TablesMap, p: Params) -> DataFrame:
    forks = t["campaign_daily_spend"].filter("supersedes_campaign_daily_spend_id IS NOT NULL").groupBy(
        "supersedes_campaign_daily_spend_id"
    ).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _ids(forks, "supersedes_campaign_daily_spend_id")


def spend_never_visible(t: TablesMap, p: Params) -> DataFrame:
    """No revision of the campaign day is visible at the cutoff."""
    days = t["campaign_daily_spend"].groupBy("marketing_campaign_id", "business_date").agg(F.min("recorded_at").alias("first"))
    hidden = days.filter(F.col("first") > instant(p.snapshot_cutoff))
    return hidden.select(F.concat_ws("/", "marketing_campaign_id", "business_date").alias("record_id"))


def touch_subject_broken(t: TablesMap, p: Params) -> DataFrame:
    both = F.col("organization_id").isNull() == F.col("consumer_id").isNull()
    return _ids(t["marketing_touch"].filter(both), "marketing_touch_id")


def touch_type_mismatch(t: TablesMap, p: Params) -> DataFrame:
    channels = t["marketing_channel"].select("marketing_channel_id", "channel_type")
    joined = t["marketing_touch"].join(channels, "marketing_channel_id")
    return _ids(joined.filter("(touch_type = 'direct') <> (channel_type = 'direct')"), "marketing_touch_id")


def touch_campaign_mismatch(t: TablesMap, p: Params) -> DataFrame:
    """A touch's campaign has another channel, scope or (SaaS) organization."""
    campaigns = t["marketing_campaign"].select(
        "marketing_campaign_id", "primary_channel_id", "business_scope", F.col("organization_id").alias("campaign_org")
    )
    joined = t["marketing_touch"].join(campaigns, "marketing_campaign_id")
    scope = F.when(F.col("organization_id").isNotNull(), "saas").otherwise("commerce")
    wrong = (
        (F.col("primary_channel_id") != F.col("marketing_channel_id"))
        | (F.col("business_scope") != scope)
        | (F.col("organization_id").isNotNull() & (F.col("campaign_org") != F.col("organization_id")))
    )
    return _ids(joined.filter(wrong), "marketing_touch_id")


def _with_fact(t: TablesMap) -> DataFrame:
    """Results next to what their fact says; columns prefixed `fact_` are NULL without a fact."""
    facts = conversions(t, ALL_TYPES).select(
        "conversion_type", _fact_id().alias("fact"), F.col("subject_id").alias("fact_subject"),
        F.col("conversion_at").alias("fact_at"), "fact_is_test",
    )
    results = t["attributed_conversion"].withColumn("fact", _fact_id())
    return results.join(facts, ["conversion_type", "fact"], "left")


def conversion_disagrees_with_fact(t: TablesMap, p: Params) -> DataFrame:
    same = F.coalesce("organization_id", "consumer_id").eqNullSafe(F.col("fact_subject")) & F.col("conversion_at").eqNullSafe(F.col("fact_at"))
    return _ids(_with_fact(t).filter(~same), "attributed_conversion_id")


def conversion_window_wrong(t: TablesMap, p: Params) -> DataFrame:
    start = F.col("conversion_at") - F.expr(f"INTERVAL {LOOK_BACK_HOURS} HOURS")
    right = (F.col("window_started_at") == start) & (F.col("history_complete") == (start >= instant(p.history_start)))
    return _ids(t["attributed_conversion"].filter(~right), "attributed_conversion_id")


def conversion_leaks_test(t: TablesMap, p: Params) -> DataFrame:
    tests = stack(
        t["organization"].filter("is_test").select("organization_id"), t["consumer"].filter("is_test").select("consumer_id")
    )
    orgs = tests.filter("organization_id IS NOT NULL").select("organization_id", F.lit(True).alias("test_org"))
    people = tests.filter("consumer_id IS NOT NULL").select("consumer_id", F.lit(True).alias("test_consumer"))
    lineage = _with_fact(t).join(orgs, "organization_id", "left").join(people, "consumer_id", "left")
    leaked = ~F.col("is_test") & (F.col("fact_is_test") | F.col("test_org").isNotNull() | F.col("test_consumer").isNotNull())
    return _ids(lineage.filter(leaked), "attributed_conversion_id")


def conversion_times_wrong(t: TablesMap, p: Params) -> DataFrame:
    cutoff = F.col("source_data_cutoff_at")
    right = (F.col("conversion_at") <= cutoff) & (cutoff <= F.col("recorded_at")) & (cutoff <= instant(p.snapshot_cutoff))
    return _ids(t["attributed_conversion"].filter(~right), "attributed_conversion_id")


def attribution_differs(t: TablesMap, p: Params) -> DataFrame:
    """Stored results that a fresh run at the row's own cutoff does not give.

    Rows meet by type, fact and cutoff, so the ids of a stored dataset may have any form; cutoffs may be as many as
    there are rows. A row whose fact is missing, or later than its cutoff, counts as different.
    """
    keys = ["conversion_type", "fact", "source_data_cutoff_at"]
    compared = ["attribution_result", "reason_code", "selected_marketing_touch_id", "marketing_channel_id", "marketing_campaign_id"]
    stored = t["attributed_conversion"].withColumn("fact", _fact_id()).select(
        "attributed_conversion_id", *keys, F.struct(*compared).alias("stored")
    )
    asked = stored.select("conversion_type", F.col("fact").cast("string").alias("fact_key"), "source_data_cutoff_at")
    fresh = attribute_at(t, asked, p.history_start)
    expected = fresh.withColumn("fact", _fact_id()).select(*keys, F.struct(*compared).alias("expected"))
    joined = stored.join(expected, keys, "left")
    return _ids(joined.filter(~F.col("stored").eqNullSafe(F.col("expected"))), "attributed_conversion_id")


def selected_links_disagree(t: TablesMap, p: Params) -> DataFrame:
    """Channel and campaign are the touch's; a commerce campaign's merchant is the order's."""
    touch = t["marketing_touch"].select(
        F.col("marketing_touch_id").alias("selected_marketing_touch_id"), F.col("marketing_channel_id").alias("touch_channel"),
        F.col("marketing_campaign_id").alias("touch_campaign"), F.coalesce("organization_id", "consumer_id").alias("touch_subject"),
    )
    campaign = t["marketing_campaign"].select("marketing_campaign_id", F.col("merchant_assignment_id").alias("campaign_merchant"))
    order_merchant = t["commerce_order"].select(F.col("commerce_order_id").alias("fact_order"), F.col("merchant_assignment_id").alias("order_merchant"))
    fee_order = t["platform_fee_charge"].select("platform_fee_charge_id", F.col("commerce_order_id").alias("fee_order"))
    joined = (
        t["attributed_conversion"].filter("selected_marketing_touch_id IS NOT NULL")
        .join(touch, "selected_marketing_touch_id", "left")
        .join(campaign, "marketing_campaign_id", "left")
        .join(fee_order, "platform_fee_charge_id", "left")
        .withColumn("fact_order", F.coalesce("commerce_order_id", "fee_order"))
        .join(order_merchant, "fact_order", "left")
    )
    same = (
        F.coalesce("organization_id", "consumer_id").eqNullSafe(F.col("touch_subject"))
        & F.col("marketing_channel_id").eqNullSafe(F.col("touch_channel"))
        & F.col("marketing_campaign_id").eqNullSafe(F.col("touch_campaign"))
    )
    commerce = F.col("consumer_id").isNotNull() & F.col("touch_campaign").isNotNull()
    right = same & (~commerce | F.col("campaign_merchant").eqNullSafe(F.col("order_merchant")))
    return _ids(joined.filter(~right), "attributed_conversion_id")


def direct_channel_wrong(t: TablesMap, p: Params) -> DataFrame:
    channels = t["marketing_channel"].select("marketing_channel_id", "channel_code", "channel_type", F.col("is_test").alias("channel_test"), "effective_from", "effective_to")
    direct = t["attributed_conversion"].filter(F.col("attribution_result") == DIRECT).join(channels, "marketing_channel_id", "left")
    right = (
        F.col("selected_marketing_touch_id").isNull() & F.col("marketing_campaign_id").isNull()
        & (F.col("channel_code") == "direct") & (F.col("channel_type") == "direct") & ~F.col("channel_test")
        & valid_at(F.col("conversion_at"), F.col("effective_from"), F.col("effective_to"))
    )
    return _ids(direct.filter(~F.coalesce(right, F.lit(False))), "attributed_conversion_id")


def unknown_keeps_links(t: TablesMap, p: Params) -> DataFrame:
    linked = F.coalesce("selected_marketing_touch_id", "marketing_channel_id", "marketing_campaign_id").isNotNull()
    return _ids(t["attributed_conversion"].filter((F.col("attribution_result") == UNKNOWN) & linked), "attributed_conversion_id")


def revision_chain_broken(t: TablesMap, p: Params) -> DataFrame:
    """One model version; cutoffs of a conversion differ; a later cutoff is recorded later."""
    results = t["attributed_conversion"].withColumn("fact", _fact_id())
    keys = ["conversion_type", "fact"]
    slim = results.select("attributed_conversion_id", *keys, "model_version", "source_data_cutoff_at", "recorded_at")
    doubled = slim.groupBy(*keys, "source_data_cutoff_at").agg(F.count(F.lit(1)).alias("n"), F.min("attributed_conversion_id").alias("attributed_conversion_id")).filter("n > 1")
    chained = previous_row(slim, keys, "source_data_cutoff_at", ["recorded_at"])
    wrong = (F.col("model_version") != MODEL_VERSION) | (F.col("recorded_at") <= F.col("previous.recorded_at"))
    return stack(_ids(doubled, "attributed_conversion_id"), _ids(chained.filter(wrong), "attributed_conversion_id"))


def tables_without_test_rows(t: TablesMap, p: Params) -> DataFrame:
    flags = [
        t[table].agg(F.coalesce(F.max("is_test"), F.lit(False)).alias("covered")).select(F.lit(table).alias("record_id"), "covered")
        for table in SCHEMAS
    ]
    return stack(*flags).filter("NOT covered").select("record_id")


RULES: dict[str, Rule] = {
    rule.__name__: rule
    for rule in [
        recorded_after_cutoff, overlapping_assignments, wrong_movement, wrong_normalization, subscription_without_event,
        current_state_disagrees, paid_without_payment, item_of_other_merchant, allocation_of_other_order,
        refund_not_reconciled, campaign_scope_broken, spend_before_final, spend_version_gap, spend_lineage_broken,
        spend_fork, spend_never_visible, touch_subject_broken, touch_type_mismatch, touch_campaign_mismatch,
        conversion_disagrees_with_fact, conversion_window_wrong, conversion_leaks_test, conversion_times_wrong,
        selected_links_disagree, direct_channel_wrong, unknown_keeps_links, revision_chain_broken, tables_without_test_rows,
    ]
}


def rule_report(t: TablesMap, p: Params, names: list[str]) -> DataFrame:
    """(rule, violations) for the named rules."""
    return stack(
        *[
            RULES[name](t, p).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")
            for name in names
        ]
    )
