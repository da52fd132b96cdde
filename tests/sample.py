"""A tiny coherent dataset: one SaaS organization, one merchant, one consumer."""

from __future__ import annotations

from copy import deepcopy
from datetime import date, datetime, timedelta
from decimal import Decimal

from tallyhouse.functions.calendar import half_year_params

PARAMS = half_year_params(1997)
START = datetime(1996, 1, 1)


def at(month: int, day: int, hour: int = 12) -> datetime:
    return datetime(1997, month, day, hour)


def money(value) -> Decimal:
    return Decimal(value).quantize(Decimal("0.0001"))


def _times(moment: datetime) -> dict:
    return {"recorded_at": moment, "updated_at": moment, "created_at": moment, "is_test": False}


def bill(fee) -> dict:
    return {"subscription_fee_amount": money(fee), "tax_amount": money(1), "one_time_amount": money(0),
            "total_amount": money(fee) + money(1), "currency_code": "USD"}


def dataset() -> dict[str, list[dict]]:
    paid = at(5, 10)
    rows = {
        "organization": [
            {"organization_id": 1, "external_organization_id": "o1", "organization_name": "A", "status": "active", "registered_at": at(4, 20), **_times(at(4, 20))},
            {"organization_id": 2, "external_organization_id": "o2", "organization_name": "B", "status": "active", "registered_at": START, **_times(START), "is_test": True},
        ],
        "organization_member": [
            {"organization_member_id": 1, "external_membership_id": "m1", "organization_id": 1, "status": "invited", "first_invited_at": at(4, 22), "effective_from": at(4, 22), **_times(at(4, 22))},
        ],
        "consumer": [
            {"consumer_id": 1, "external_consumer_id": "c1", "status": "active", "first_identified_at": START, **_times(START)},
        ],
        "merchant": [
            {"merchant_assignment_id": 1, "merchant_id": 10, "external_merchant_id": "me1", "organization_id": 1, "merchant_name": "Shop", "status": "active", "assignment_valid_from": START, **_times(START)},
        ],
        "saas_plan_version": [
            {"saas_plan_version_id": 1, "plan_code": "s", "version_number": 1, "plan_name": "Starter", "tier_code": "starter", "billing_interval": "monthly", "recurring_amount": money(50), "currency_code": "USD", "status": "active", "effective_from": START, **_times(START)},
            {"saas_plan_version_id": 2, "plan_code": "e", "version_number": 1, "plan_name": "Enterprise", "tier_code": "enterprise", "billing_interval": "annual", "recurring_amount": money(1200), "currency_code": "USD", "status": "active", "effective_from": START, **_times(START)},
        ],
        "subscription": [
            {"subscription_id": 1, "external_subscription_id": "s1", "organization_id": 1, "current_plan_version_id": 2, "current_status": "active", **_times(at(4, 21))},
        ],
        "subscription_state_event": [
            state(1, 1, at(4, 21), "first_activation", None, 1, 0, 50),
            state(2, 1, at(6, 5), "expansion", 1, 2, 50, 100),
        ],
        "subscription_invoice": [
            {"subscription_invoice_id": 1, "external_invoice_id": "i1", "subscription_id": 1, "status": "paid", "issued_at": at(5, 9), "due_at": at(5, 20), "paid_at": paid, **bill(50), **_times(at(5, 9))},
        ],
        "invoice_payment_attempt": [
            {"invoice_payment_attempt_id": 1, "external_payment_attempt_id": "p1", "subscription_invoice_id": 1, "status": "succeeded", "attempted_at": at(5, 9), "succeeded_at": paid, **bill(50), "is_test": False, "recorded_at": paid},
        ],
        "product": [
            {"product_id": 1, "external_product_id": "pr1", "merchant_assignment_id": 1, "product_title": "Ring", "category_code": "rings", "status": "active", **_times(START)},
        ],
        "commerce_order": [order(1, at(5, 20)), order(2, at(6, 10))],
        "commerce_order_item": [item(1, 1, 100), item(2, 2, 60), item(3, 2, 40)],
        "commerce_refund": [
            {"commerce_refund_id": 1, "external_refund_id": "r1", "commerce_order_id": 1, "status": "succeeded", "item_refund_amount": money(30), "tax_refund_amount": money(0), "shipping_refund_amount": money(0), "total_refund_amount": money(30), "currency_code": "USD", "requested_at": at(6, 1), "processed_at": at(6, 2), "succeeded_at": at(6, 2), **_times(at(6, 2))},
        ],
        "refund_item_allocation": [
            {"refund_item_allocation_id": 1, "external_refund_allocation_id": "ra1", "commerce_refund_id": 1, "commerce_order_item_id": 1, "allocated_item_amount": money(30), "currency_code": "USD", **_times(at(6, 2))},
        ],
        "platform_fee_charge": [
            {"platform_fee_charge_id": n, "external_fee_charge_id": f"f{n}", "commerce_order_id": n, "status": "succeeded", "fee_amount": money(3), "currency_code": "USD", "attempted_at": when, "succeeded_at": when, "is_test": False, "recorded_at": when}
            for n, when in ((1, at(5, 20)), (2, at(6, 10)))
        ],
        "marketing_channel": [
            channel(1, "search", "paid"), channel(2, "direct", "direct"),
        ],
        "marketing_campaign": [
            {"marketing_campaign_id": 1, "external_campaign_id": "cs", "organization_id": 1, "primary_channel_id": 1, "business_scope": "saas", "campaign_name": "S", "status": "active", "status_updated_at": at(4, 25), **_times(at(4, 25))},
            {"marketing_campaign_id": 2, "external_campaign_id": "cc", "organization_id": 1, "merchant_assignment_id": 1, "primary_channel_id": 1, "business_scope": "commerce", "campaign_name": "C", "status": "active", "status_updated_at": START, **_times(START)},
        ],
        "campaign_daily_spend": [spend(1, 1, date(1997, 5, 5), 1, 20), spend(2, 2, date(1997, 5, 6), 1, 10)],
        "marketing_touch": [touch(1, at(5, 8), organization_id=1, campaign=1), touch(2, at(6, 8), consumer_id=1, campaign=2)],
        "attributed_conversion": [],
    }
    return deepcopy(rows)


def state(event: int, subscription: int, when: datetime, kind: str, plan_before, plan_after, before, after, status="active") -> dict:
    return {
        "subscription_state_event_id": event, "source_event_id": f"e{event}", "subscription_id": subscription, "event_type": kind,
        "status_before": "active" if plan_before else None, "status_after": status,
        "plan_version_before_id": plan_before, "plan_version_after_id": plan_after,
        "billing_interval_before": "monthly" if plan_before else None, "billing_interval_after": "monthly",
        "recurring_amount_before": money(before), "recurring_amount_after": money(after),
        "normalized_mrr_before": money(before), "normalized_mrr_after": money(after), "currency_code": "USD",
        "effective_at": when, "created_at": when, "is_test": False, "recorded_at": when,
    }


def order(number: int, paid_at: datetime, status: str = "completed", consumer: int = 1) -> dict:
    done = paid_at + timedelta(hours=1)
    return {
        "commerce_order_id": number, "external_order_id": f"or{number}", "consumer_id": consumer, "merchant_assignment_id": 1,
        "status": status, "currency_code": "USD", "first_paid_at": paid_at,
        "completed_at": done if status == "completed" else None, "cancelled_at": done if status == "cancelled" else None,
        **_times(paid_at),
    }


def item(number: int, order_id: int, amount, **other) -> dict:
    return {"commerce_order_item_id": number, "external_order_item_id": f"it{number}", "commerce_order_id": order_id, "product_id": 1,
            "product_category_code": "rings", "quantity": 1, "discounted_item_amount": money(amount), "currency_code": "USD",
            "created_at": START, "is_test": False, "recorded_at": START, **other}


def channel(number: int, code: str, kind: str, **other) -> dict:
    return {"marketing_channel_id": number, "channel_code": code, "channel_name": code, "channel_type": kind, "status": "active",
            "effective_from": START, **_times(START), **other}


def touch(number: int, when: datetime, channel_id: int = 1, campaign=None, **other) -> dict:
    return {"marketing_touch_id": number, "source_event_id": f"t{number}", "marketing_channel_id": channel_id, "marketing_campaign_id": campaign,
            "touch_type": "non_direct", "quality_status": "accepted", "occurred_at": when, "received_at": when, "processed_at": when,
            "is_test": False, "recorded_at": when, **other}


def spend(number: int, campaign: int, day: date, version: int, amount, days: int = 1, supersedes=None) -> dict:
    final = datetime(day.year, day.month, day.day) + timedelta(days=days)
    return {"campaign_daily_spend_id": number, "marketing_campaign_id": campaign, "business_date": day, "version_number": version,
            "supersedes_campaign_daily_spend_id": supersedes, "spend_amount": money(amount), "currency_code": "USD",
            "finalized_at": final, "is_test": False, "recorded_at": final}
