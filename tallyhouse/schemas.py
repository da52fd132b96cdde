"""Fixed schemas of the twenty business entities."""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, TEXT, DAY, FLAG = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.BooleanType()
INSTANT = T.TimestampNTZType()  # naive UTC, microseconds
MONEY = T.DecimalType(19, 4)

# The columns of the model as (name, type, nullable).
COLUMNS: dict[str, tuple[tuple[str, T.DataType, bool], ...]] = {
    "organization": (
        ("organization_id", LONG, False),
        ("external_organization_id", TEXT, False),
        ("organization_name", TEXT, False),
        ("status", TEXT, False),
        ("registered_at", INSTANT, False),
        ("closed_at", INSTANT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "organization_member": (
        ("organization_member_id", LONG, False),
        ("external_membership_id", TEXT, False),
        ("organization_id", LONG, False),
        ("external_account_id", TEXT, True),
        ("status", TEXT, False),
        ("first_invited_at", INSTANT, True),
        ("accepted_at", INSTANT, True),
        ("effective_from", INSTANT, False),
        ("effective_to", INSTANT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "consumer": (
        ("consumer_id", LONG, False),
        ("external_consumer_id", TEXT, False),
        ("status", TEXT, False),
        ("first_identified_at", INSTANT, False),
        ("created_at", INSTANT, False),
        ("closed_at", INSTANT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "merchant": (
        ("merchant_assignment_id", LONG, False),
        ("merchant_id", LONG, False),
        ("external_merchant_id", TEXT, False),
        ("organization_id", LONG, False),
        ("merchant_name", TEXT, False),
        ("status", TEXT, False),
        ("applied_at", INSTANT, True),
        ("approved_at", INSTANT, True),
        ("activated_at", INSTANT, True),
        ("closed_at", INSTANT, True),
        ("assignment_valid_from", INSTANT, False),
        ("assignment_valid_to", INSTANT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "saas_plan_version": (
        ("saas_plan_version_id", LONG, False),
        ("plan_code", TEXT, False),
        ("version_number", INT, False),
        ("plan_name", TEXT, False),
        ("tier_code", TEXT, False),
        ("billing_interval", TEXT, False),
        ("recurring_amount", MONEY, False),
        ("currency_code", TEXT, False),
        ("status", TEXT, False),
        ("effective_from", INSTANT, False),
        ("effective_to", INSTANT, True),
        ("is_test", FLAG, False),
        ("created_at", INSTANT, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "subscription": (
        ("subscription_id", LONG, False),
        ("external_subscription_id", TEXT, False),
        ("organization_id", LONG, False),
        ("current_plan_version_id", LONG, True),
        ("current_status", TEXT, False),
        ("created_at", INSTANT, False),
        ("first_activated_at", INSTANT, True),
        ("current_period_started_at", INSTANT, True),
        ("current_period_ends_at", INSTANT, True),
        ("cancel_scheduled_at", INSTANT, True),
        ("cancellation_effective_at", INSTANT, True),
        ("expires_at", INSTANT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "subscription_state_event": (
        ("subscription_state_event_id", LONG, False),
        ("source_event_id", TEXT, False),
        ("subscription_id", LONG, False),
        ("event_type", TEXT, False),
        ("status_before", TEXT, True),
        ("status_after", TEXT, True),
        ("plan_version_before_id", LONG, True),
        ("plan_version_after_id", LONG, True),
        ("billing_interval_before", TEXT, True),
        ("billing_interval_after", TEXT, True),
        ("recurring_amount_before", MONEY, False),
        ("recurring_amount_after", MONEY, False),
        ("normalized_mrr_before", MONEY, False),
        ("normalized_mrr_after", MONEY, False),
        ("currency_code", TEXT, False),
        ("effective_at", INSTANT, False),
        ("created_at", INSTANT, False),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
    ),
    "subscription_invoice": (
        ("subscription_invoice_id", LONG, False),
        ("external_invoice_id", TEXT, False),
        ("subscription_id", LONG, False),
        ("status", TEXT, False),
        ("subscription_fee_amount", MONEY, False),
        ("tax_amount", MONEY, False),
        ("one_time_amount", MONEY, False),
        ("total_amount", MONEY, False),
        ("currency_code", TEXT, False),
        ("issued_at", INSTANT, True),
        ("due_at", INSTANT, True),
        ("voided_at", INSTANT, True),
        ("paid_at", INSTANT, True),
        ("created_at", INSTANT, False),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "invoice_payment_attempt": (
        ("invoice_payment_attempt_id", LONG, False),
        ("external_payment_attempt_id", TEXT, False),
        ("provider_transaction_id", TEXT, True),
        ("subscription_invoice_id", LONG, False),
        ("status", TEXT, False),
        ("subscription_fee_amount", MONEY, False),
        ("tax_amount", MONEY, False),
        ("one_time_amount", MONEY, False),
        ("total_amount", MONEY, False),
        ("currency_code", TEXT, False),
        ("attempted_at", INSTANT, False),
        ("succeeded_at", INSTANT, True),
        ("failed_at", INSTANT, True),
        ("cancelled_at", INSTANT, True),
        ("failure_code", TEXT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
    ),
    "product": (
        ("product_id", LONG, False),
        ("external_product_id", TEXT, False),
        ("merchant_assignment_id", LONG, False),
        ("product_title", TEXT, False),
        ("category_code", TEXT, False),
        ("status", TEXT, False),
        ("created_at", INSTANT, False),
        ("first_published_at", INSTANT, True),
        ("archived_at", INSTANT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "commerce_order": (
        ("commerce_order_id", LONG, False),
        ("external_order_id", TEXT, False),
        ("consumer_id", LONG, False),
        ("merchant_assignment_id", LONG, False),
        ("status", TEXT, False),
        ("currency_code", TEXT, False),
        ("created_at", INSTANT, False),
        ("first_paid_at", INSTANT, True),
        ("fulfilled_at", INSTANT, True),
        ("completed_at", INSTANT, True),
        ("cancelled_at", INSTANT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "commerce_order_item": (
        ("commerce_order_item_id", LONG, False),
        ("external_order_item_id", TEXT, False),
        ("commerce_order_id", LONG, False),
        ("product_id", LONG, False),
        ("product_category_code", TEXT, False),
        ("quantity", INT, False),
        ("discounted_item_amount", MONEY, False),
        ("currency_code", TEXT, False),
        ("created_at", INSTANT, False),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
    ),
    "commerce_refund": (
        ("commerce_refund_id", LONG, False),
        ("external_refund_id", TEXT, False),
        ("commerce_order_id", LONG, False),
        ("status", TEXT, False),
        ("item_refund_amount", MONEY, False),
        ("tax_refund_amount", MONEY, False),
        ("shipping_refund_amount", MONEY, False),
        ("total_refund_amount", MONEY, False),
        ("currency_code", TEXT, False),
        ("reason_code", TEXT, True),
        ("requested_at", INSTANT, False),
        ("processed_at", INSTANT, True),
        ("succeeded_at", INSTANT, True),
        ("failed_at", INSTANT, True),
        ("cancelled_at", INSTANT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "refund_item_allocation": (
        ("refund_item_allocation_id", LONG, False),
        ("external_refund_allocation_id", TEXT, False),
        ("commerce_refund_id", LONG, False),
        ("commerce_order_item_id", LONG, False),
        ("allocated_item_amount", MONEY, False),
        ("currency_code", TEXT, False),
        ("created_at", INSTANT, False),
        ("corrected_at", INSTANT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "platform_fee_charge": (
        ("platform_fee_charge_id", LONG, False),
        ("external_fee_charge_id", TEXT, False),
        ("provider_charge_id", TEXT, True),
        ("commerce_order_id", LONG, False),
        ("status", TEXT, False),
        ("fee_amount", MONEY, False),
        ("currency_code", TEXT, False),
        ("attempted_at", INSTANT, False),
        ("succeeded_at", INSTANT, True),
        ("failed_at", INSTANT, True),
        ("cancelled_at", INSTANT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
    ),
    "marketing_channel": (
        ("marketing_channel_id", LONG, False),
        ("channel_code", TEXT, False),
        ("channel_name", TEXT, False),
        ("channel_type", TEXT, False),
        ("status", TEXT, False),
        ("effective_from", INSTANT, False),
        ("effective_to", INSTANT, True),
        ("is_test", FLAG, False),
        ("created_at", INSTANT, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "marketing_campaign": (
        ("marketing_campaign_id", LONG, False),
        ("external_campaign_id", TEXT, False),
        ("organization_id", LONG, False),
        ("merchant_assignment_id", LONG, True),
        ("primary_channel_id", LONG, False),
        ("business_scope", TEXT, False),
        ("campaign_name", TEXT, False),
        ("status", TEXT, False),
        ("created_at", INSTANT, False),
        ("started_at", INSTANT, True),
        ("ended_at", INSTANT, True),
        ("status_updated_at", INSTANT, False),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
        ("updated_at", INSTANT, False),
    ),
    "campaign_daily_spend": (
        ("campaign_daily_spend_id", LONG, False),
        ("marketing_campaign_id", LONG, False),
        ("business_date", DAY, False),
        ("version_number", INT, False),
        ("supersedes_campaign_daily_spend_id", LONG, True),
        ("spend_amount", MONEY, False),
        ("currency_code", TEXT, False),
        ("finalized_at", INSTANT, False),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
    ),
    "marketing_touch": (
        ("marketing_touch_id", LONG, False),
        ("source_event_id", TEXT, False),
        ("marketing_channel_id", LONG, False),
        ("marketing_campaign_id", LONG, True),
        ("organization_id", LONG, True),
        ("consumer_id", LONG, True),
        ("touch_type", TEXT, False),
        ("quality_status", TEXT, False),
        ("occurred_at", INSTANT, False),
        ("received_at", INSTANT, False),
        ("processed_at", INSTANT, True),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
    ),
    "attributed_conversion": (
        ("attributed_conversion_id", TEXT, False),
        ("conversion_type", TEXT, False),
        ("organization_id", LONG, True),
        ("consumer_id", LONG, True),
        ("invoice_payment_attempt_id", LONG, True),
        ("commerce_order_id", LONG, True),
        ("platform_fee_charge_id", LONG, True),
        ("selected_marketing_touch_id", LONG, True),
        ("marketing_channel_id", LONG, True),
        ("marketing_campaign_id", LONG, True),
        ("attribution_result", TEXT, False),
        ("reason_code", TEXT, False),
        ("model_version", TEXT, False),
        ("conversion_at", INSTANT, False),
        ("window_started_at", INSTANT, False),
        ("history_complete", FLAG, False),
        ("source_data_cutoff_at", INSTANT, False),
        ("attributed_at", INSTANT, False),
        ("is_test", FLAG, False),
        ("recorded_at", INSTANT, False),
    ),
}

SCHEMAS: dict[str, T.StructType] = {
    table: T.StructType([T.StructField(*column) for column in columns]) for table, columns in COLUMNS.items()
}


def primary_key(table: str) -> str:
    return SCHEMAS[table].names[0]
