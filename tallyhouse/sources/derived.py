"""The business model derived from the driver's TPC-H-like tables.

Each definition is one SELECT that Spark and DuckDB read the same way, so the oracle can put
the same text into a CTE. `{name}` marks a source table. All but the spend definitions are
row-by-row projections: no shuffle is spent on building the model. Event times are
stretched six-fold onto January to June 1997, where the orders also lie.

Line-grain surrogate ids are text because the source has no numeric line key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.sources.tables import Tables

_EVENT_TIME = "TIMESTAMP '1997-01-01 00:00:00' + (ts - TIMESTAMP '2024-01-01 00:00:00') * 6"
_REGISTERED = "TIMESTAMP '1997-01-15 00:00:00' + INTERVAL '1' HOUR * ({key} * 31 % 4000)"
_LINE = "CONCAT(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey)"
_LINE_AMOUNT = (
    "CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (CAST(1 AS DECIMAL(3,2)) "
    "- CAST(l_discount AS DECIMAL(3,2))) AS DECIMAL(19,4))"
)
_MERCHANT = "CAST((o_custkey - o_custkey % 15) / 15 AS BIGINT)"
_PAID_AT = "o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 24)"
_NO_TIME = "CAST(NULL AS TIMESTAMP)"
_ZERO = "CAST(0 AS DECIMAL(19,4))"


def _registered(key: str) -> str:
    return _REGISTERED.replace("{key}", key)


# signup and purchase events after registration each start one subscription
_SUBSCRIBING = f"event_type IN ('signup', 'purchase') AND {_EVENT_TIME} >= {_registered('user_id')}"
_BASE_MRR = "CAST(24 + event_id % 80 AS DECIMAL(19,4))"
_CHANGED_MRR = (
    f"CAST(CASE WHEN event_id % 3 = 0 THEN {_BASE_MRR} * 2 WHEN event_id % 3 = 1 "
    f"THEN {_BASE_MRR} / 4 ELSE {_BASE_MRR} END AS DECIMAL(19,4))"
)
_PLAN = "CASE WHEN event_id % 97 = 5 THEN 4 ELSE (user_id + event_id) % 4 END"
_CHANGED_PLAN = f"CASE WHEN event_id % 3 = 0 THEN (user_id + event_id + 1) % 4 ELSE {_PLAN} END"
_STATE_COLUMNS = """
    event_id % 89 = 3 AS is_test,
    effective_at + INTERVAL '1' HOUR * (event_id % 72) AS recorded_at,
    effective_at AS created_at, 'USD' AS currency_code,
    CASE WHEN plan_version_before_id = 3 THEN 'annual'
         WHEN plan_version_before_id IS NOT NULL THEN 'monthly' END AS billing_interval_before,
    CASE WHEN plan_version_after_id = 3 THEN 'annual' ELSE 'monthly' END AS billing_interval_after,
    CAST(CASE WHEN plan_version_before_id = 3 THEN normalized_mrr_before * 12
         ELSE normalized_mrr_before END AS DECIMAL(19,4)) AS recurring_amount_before,
    CAST(CASE WHEN plan_version_after_id = 3 THEN normalized_mrr_after * 12
         ELSE normalized_mrr_after END AS DECIMAL(19,4)) AS recurring_amount_after
"""


def _state_step(step: int, kind: str, after_days: str, where: str, before: tuple, after: tuple) -> str:
    (status_b, plan_b, mrr_b), (status_a, plan_a, mrr_a) = before, after
    return f"""
  SELECT event_id * 4 + {step} AS subscription_state_event_id,
    CONCAT('SE-', event_id, '-{step}') AS source_event_id, event_id AS subscription_id,
    {kind} AS event_type, {status_b} AS status_before, {status_a} AS status_after,
    {plan_b} AS plan_version_before_id, {plan_a} AS plan_version_after_id,
    {mrr_b} AS normalized_mrr_before, {mrr_a} AS normalized_mrr_after,
    {_EVENT_TIME} + INTERVAL '1' DAY * ({after_days}) AS effective_at, {_STATE_COLUMNS}
  FROM {{events}} WHERE {_SUBSCRIBING} AND {where}"""


_CHANGED_STATUS = "CASE WHEN event_id % 6 = 1 THEN 'cancel_scheduled' ELSE 'active' END"

_STATE_EVENT = " UNION ALL ".join(
    [
        _state_step(0, "'first_activation'", "0", "TRUE",
                    ("CAST(NULL AS STRING)", "CAST(NULL AS BIGINT)", _ZERO),
                    ("'active'", _PLAN, _BASE_MRR)),
        _state_step(1, "CASE WHEN event_id % 3 = 0 THEN 'expansion' ELSE 'contraction' END",
                    "10 + event_id % 30", "event_id % 3 < 2",
                    ("'active'", _PLAN, _BASE_MRR), (_CHANGED_STATUS, _CHANGED_PLAN, _CHANGED_MRR)),
        _state_step(2, "'pause'", "41 + event_id % 5", "event_id % 20 = 2",
                    (_CHANGED_STATUS, _CHANGED_PLAN, _CHANGED_MRR),
                    ("'paused'", _CHANGED_PLAN, _ZERO)),
        _state_step(3, "'cancellation_effective'", "46 + event_id % 60", "event_id % 4 IN (1, 3)",
                    (_CHANGED_STATUS, _CHANGED_PLAN, _CHANGED_MRR),
                    ("'cancelled'", _CHANGED_PLAN, _ZERO)),
    ]
)


_PAY_SUCCEEDED = "(event_id + {k}) % 9 <> 4"
_FEE = f"CAST(CASE WHEN ({_PLAN}) = 3 THEN {_BASE_MRR} * 12 ELSE {_BASE_MRR} END AS DECIMAL(19,4))"


def _bill_columns(k: int) -> str:
    return f"""
    {_FEE} AS subscription_fee_amount,
    CAST({_FEE} / 8 AS DECIMAL(19,4)) AS tax_amount,
    CAST({5 if k == 0 else 0} AS DECIMAL(19,4)) AS one_time_amount,
    CAST(subscription_fee_amount + tax_amount + one_time_amount AS DECIMAL(19,4)) AS total_amount,
    'USD' AS currency_code"""


def _invoice(k: int) -> str:
    paid = _PAY_SUCCEEDED.replace("{k}", str(k))
    return f"""
  SELECT event_id * 4 + {k} AS subscription_invoice_id,
    CONCAT('INV-', event_id, '-{k}') AS external_invoice_id, event_id AS subscription_id,
    CASE WHEN {paid} OR event_id % 193 = 0 THEN 'paid' ELSE 'open' END AS status, {_bill_columns(k)},
    {_EVENT_TIME} + INTERVAL '1' DAY * {30 * k} AS issued_at,
    issued_at + INTERVAL '1' DAY * 14 AS due_at, {_NO_TIME} AS voided_at,
    CASE WHEN {paid} OR event_id % 193 = 0 THEN issued_at + INTERVAL '1' HOUR * 6 END AS paid_at,
    issued_at AS created_at, event_id % 113 = 4 AS is_test, issued_at AS recorded_at,
    issued_at AS updated_at
  FROM {{events}} WHERE {_SUBSCRIBING}"""


def _payment(k: int) -> str:
    paid = _PAY_SUCCEEDED.replace("{k}", str(k))
    return f"""
  SELECT event_id * 4 + {k} AS invoice_payment_attempt_id,
    CONCAT('PAY-', event_id, '-{k}') AS external_payment_attempt_id,
    CASE WHEN {paid} THEN CONCAT('TX-', event_id, '-{k}') END AS provider_transaction_id,
    event_id * 4 + {k} AS subscription_invoice_id,
    CASE WHEN {paid} THEN 'succeeded' ELSE 'failed' END AS status, {_bill_columns(k)},
    {_EVENT_TIME} + INTERVAL '1' DAY * {30 * k} AS attempted_at,
    CASE WHEN {paid} THEN attempted_at + INTERVAL '1' HOUR * 6 END AS succeeded_at,
    CASE WHEN {paid} THEN {_NO_TIME} ELSE attempted_at + INTERVAL '1' HOUR * 6 END AS failed_at,
    {_NO_TIME} AS cancelled_at, CASE WHEN {paid} THEN NULL ELSE 'card_declined' END AS failure_code,
    event_id % 101 = 5 AS is_test, attempted_at + INTERVAL '1' HOUR * (6 + event_id % 72) AS recorded_at
  FROM {{events}} WHERE {_SUBSCRIBING}"""


_REFUND_TIME = "l_shipdate + INTERVAL '1' HOUR * (l_partkey % 24)"


def _spend_version(version: int, rate: str, days: int, where: str) -> str:
    supersedes = "NULL" if version == 1 else f"{{id}} + {version - 1}"
    key = "marketing_campaign_id * 1000000000 + (YEAR(business_date) * 10000 + MONTH(business_date) * 100 + DAY(business_date)) * 10"
    return f"""
  SELECT {key} + {version} AS campaign_daily_spend_id, marketing_campaign_id, business_date,
    {version} AS version_number, CAST({supersedes.replace("{id}", key)} AS BIGINT) AS supersedes_campaign_daily_spend_id,
    CAST(n * CAST({rate} AS DECIMAL(4,2)) AS DECIMAL(19,4)) AS spend_amount, 'USD' AS currency_code,
    CAST(business_date AS TIMESTAMP) + INTERVAL '1' DAY AS finalized_at,
    marketing_campaign_id % 71 = 9 AS is_test,
    CAST(business_date AS TIMESTAMP) + INTERVAL '1' DAY * {days} AS recorded_at
  FROM daily WHERE {where}"""


_SPEND = f"""
WITH daily AS (
  SELECT user_id * 2 + 1 AS marketing_campaign_id, CAST({_EVENT_TIME} AS DATE) AS business_date, COUNT(*) AS n
  FROM {{events}} WHERE event_type IN ('click', 'view') GROUP BY 1, 2
  UNION ALL
  SELECT {_MERCHANT} * 2, CAST(o_orderdate AS DATE), COUNT(*) FROM {{orders}} GROUP BY 1, 2
)
{_spend_version(1, "15.5", 2, "TRUE")}
UNION ALL
{_spend_version(2, "17.25", 9, "(DAY(business_date) + n) % 3 = 0")}
UNION ALL
{_spend_version(3, "12.75", 40, "(DAY(business_date) + n) % 6 = 0")}
"""

_TOUCH = f"""
SELECT event_id * 2 AS marketing_touch_id, CONCAT('TE-', LPAD(CAST(event_id AS STRING), 12, '0')) AS source_event_id,
  CASE WHEN event_id % 211 = 0 THEN 5 WHEN event_type = 'view' AND event_id % 10 = 0 THEN 4
       WHEN event_id % 2 = 0 THEN 1 + user_id % 3 ELSE 1 + event_id % 3 END AS marketing_channel_id,
  CASE WHEN event_id % 211 <> 0 AND event_id % 2 = 0 AND NOT (event_type = 'view' AND event_id % 10 = 0)
       THEN user_id * 2 + 1 END AS marketing_campaign_id,
  user_id AS organization_id, CAST(NULL AS BIGINT) AS consumer_id,
  CASE WHEN event_type = 'view' AND event_id % 10 = 0 AND event_id % 211 <> 0 THEN 'direct' ELSE 'non_direct' END AS touch_type,
  CASE WHEN event_id % 13 = 6 THEN 'rejected' ELSE 'accepted' END AS quality_status,
  {_EVENT_TIME} AS occurred_at, occurred_at + INTERVAL '1' MINUTE AS received_at,
  CASE WHEN event_id % 17 = 0 THEN {_NO_TIME} ELSE occurred_at + INTERVAL '1' MINUTE * 10 END AS processed_at,
  event_id % 307 = 1 AS is_test,
  occurred_at + INTERVAL '1' HOUR * (CASE WHEN event_id % 23 = 0 THEN 900 ELSE 1 END) AS recorded_at
FROM {{events}} WHERE event_type IN ('click', 'view')
UNION ALL
SELECT o_orderkey * 2 + 1, CONCAT('TO-', LPAD(CAST(o_orderkey AS STRING), 12, '0')),
  CASE WHEN o_orderkey % 2 = 0 THEN 1 + {_MERCHANT} % 3 ELSE 1 + o_orderkey % 3 END,
  CASE WHEN o_orderkey % 2 = 0 THEN {_MERCHANT} * 2 END,
  CAST(NULL AS BIGINT), o_custkey, 'non_direct',
  CASE WHEN o_orderkey % 13 = 6 THEN 'rejected' ELSE 'accepted' END,
  {_PAID_AT} - INTERVAL '1' HOUR * (o_orderkey * 7 % 400) AS occurred_at, occurred_at + INTERVAL '1' MINUTE,
  CASE WHEN o_orderkey % 17 = 0 THEN {_NO_TIME} ELSE occurred_at + INTERVAL '1' MINUTE * 10 END,
  o_orderkey % 307 = 1,
  occurred_at + INTERVAL '1' HOUR * (CASE WHEN o_orderkey % 23 = 0 THEN 900 ELSE 1 END)
FROM {{orders}}
"""

DEFINITIONS: dict[str, str] = {
    "organization": f"""
SELECT c_custkey AS organization_id, CONCAT('ORG-', c_custkey) AS external_organization_id,
  c_name AS organization_name, CASE WHEN c_custkey % 37 = 5 THEN 'closed' ELSE 'active' END AS status,
  {_registered('c_custkey')} AS registered_at,
  CASE WHEN c_custkey % 37 = 5 THEN registered_at + INTERVAL '1' DAY * 300 END AS closed_at,
  c_custkey % 50 = 7 AS is_test,
  registered_at + INTERVAL '1' HOUR * (CASE WHEN c_custkey % 23 = 4 THEN 2000 ELSE 1 END) AS recorded_at,
  recorded_at AS updated_at
FROM {{customer}}""",
    "organization_member": f"""
SELECT event_id AS organization_member_id, CONCAT('MEM-', event_id) AS external_membership_id,
  user_id AS organization_id, CASE WHEN event_id % 3 = 0 THEN CONCAT('ACC-', event_id) END AS external_account_id,
  CASE WHEN event_id % 3 = 0 THEN 'active' ELSE 'invited' END AS status,
  {_EVENT_TIME} AS first_invited_at,
  CASE WHEN event_id % 3 = 0 THEN first_invited_at + INTERVAL '1' DAY END AS accepted_at,
  first_invited_at AS effective_from, {_NO_TIME} AS effective_to, event_id % 83 = 2 AS is_test,
  first_invited_at + INTERVAL '1' HOUR AS recorded_at, recorded_at AS updated_at
FROM {{events}} WHERE event_type = 'signup'""",
    "consumer": """
SELECT c_custkey AS consumer_id, CONCAT('CON-', c_custkey) AS external_consumer_id, 'active' AS status,
  TIMESTAMP '1994-06-01 00:00:00' AS first_identified_at, TIMESTAMP '1994-06-01 00:00:00' AS created_at,
  CAST(NULL AS TIMESTAMP) AS closed_at, c_custkey % 50 = 11 AS is_test,
  TIMESTAMP '1994-06-01 00:00:00' AS recorded_at, TIMESTAMP '1994-06-01 00:00:00' AS updated_at
FROM {customer}""",
    "merchant": f"""
SELECT s_suppkey AS merchant_assignment_id, s_suppkey - (CASE WHEN s_suppkey % 10 = 9 THEN 1 ELSE 0 END) AS merchant_id,
  CONCAT('MER-', merchant_id) AS external_merchant_id, s_suppkey AS organization_id,
  CONCAT('Merchant ', merchant_id) AS merchant_name, 'active' AS status,
  TIMESTAMP '1994-06-01 00:00:00' AS applied_at, TIMESTAMP '1994-06-02 00:00:00' AS approved_at,
  TIMESTAMP '1994-06-03 00:00:00' AS activated_at, {_NO_TIME} AS closed_at,
  CASE WHEN s_suppkey % 10 = 9 THEN TIMESTAMP '1997-05-01 07:00:00' ELSE TIMESTAMP '1994-06-03 00:00:00' END AS assignment_valid_from,
  CASE WHEN s_suppkey % 20 = 8 THEN TIMESTAMP '1997-05-09 07:00:00'
       WHEN s_suppkey % 10 = 8 THEN TIMESTAMP '1997-05-01 07:00:00' END AS assignment_valid_to,
  s_suppkey % 25 = 3 AS is_test, TIMESTAMP '1994-06-03 00:00:00' AS recorded_at,
  TIMESTAMP '1994-06-03 00:00:00' AS updated_at
FROM {{supplier}}""",
    "saas_plan_version": """
SELECT CAST(n_nationkey AS BIGINT) AS saas_plan_version_id,
  CASE n_nationkey WHEN 0 THEN 'starter-m' WHEN 1 THEN 'growth-m' WHEN 2 THEN 'ent-m' WHEN 3 THEN 'ent-a' ELSE 'sandbox' END AS plan_code,
  1 AS version_number,
  CASE n_nationkey WHEN 0 THEN 'Starter Monthly' WHEN 1 THEN 'Growth Monthly' WHEN 2 THEN 'Enterprise Monthly'
       WHEN 3 THEN 'Enterprise Annual' ELSE 'Sandbox' END AS plan_name,
  CASE n_nationkey WHEN 0 THEN 'starter' WHEN 1 THEN 'growth' WHEN 4 THEN 'sandbox' ELSE 'enterprise' END AS tier_code,
  CASE n_nationkey WHEN 3 THEN 'annual' ELSE 'monthly' END AS billing_interval,
  CAST(20 * (n_nationkey + 1) AS DECIMAL(19,4)) AS recurring_amount, 'USD' AS currency_code, 'active' AS status,
  TIMESTAMP '1994-06-01 00:00:00' AS effective_from, CAST(NULL AS TIMESTAMP) AS effective_to,
  n_nationkey = 4 AS is_test, TIMESTAMP '1994-06-01 00:00:00' AS created_at,
  TIMESTAMP '1994-06-01 00:00:00' AS recorded_at, TIMESTAMP '1994-06-01 00:00:00' AS updated_at
FROM {nation} WHERE n_nationkey < 5""",
    "subscription": f"""
SELECT event_id AS subscription_id, CONCAT('SUB-', event_id) AS external_subscription_id,
  user_id AS organization_id, {_CHANGED_PLAN} AS current_plan_version_id,
  CASE WHEN event_id % 4 IN (1, 3) THEN 'cancelled' WHEN event_id % 20 = 2 THEN 'paused' ELSE 'active' END AS current_status,
  {_EVENT_TIME} AS created_at, created_at AS first_activated_at, created_at AS current_period_started_at,
  created_at + INTERVAL '1' DAY * 30 AS current_period_ends_at,
  CASE WHEN event_id % 4 IN (1, 3) THEN created_at + INTERVAL '1' DAY * 45 END AS cancel_scheduled_at,
  CASE WHEN event_id % 4 IN (1, 3) THEN created_at + INTERVAL '1' DAY * (46 + event_id % 60) END AS cancellation_effective_at,
  {_NO_TIME} AS expires_at, event_id % 59 = 17 AS is_test, created_at AS recorded_at, created_at AS updated_at
FROM {{events}} WHERE {_SUBSCRIBING}""",
    "subscription_state_event": _STATE_EVENT,
    "subscription_invoice": " UNION ALL ".join(_invoice(k) for k in range(3)),
    "invoice_payment_attempt": " UNION ALL ".join(_payment(k) for k in range(3)),
    "product": """
SELECT p_partkey AS product_id, CONCAT('PRO-', p_partkey) AS external_product_id,
  CAST((p_partkey - p_partkey % 20) / 20 AS BIGINT) AS merchant_assignment_id, p_name AS product_title,
  CONCAT(p_type, '-', p_partkey % 3) AS category_code, 'active' AS status,
  TIMESTAMP '1994-06-01 00:00:00' AS created_at, TIMESTAMP '1994-06-02 00:00:00' AS first_published_at,
  CAST(NULL AS TIMESTAMP) AS archived_at, p_partkey % 40 = 11 AS is_test,
  TIMESTAMP '1994-06-02 00:00:00' AS recorded_at, TIMESTAMP '1994-06-02 00:00:00' AS updated_at
FROM {part}""",
    "commerce_order": f"""
SELECT o_orderkey AS commerce_order_id, CONCAT('ORD-', o_orderkey) AS external_order_id, o_custkey AS consumer_id,
  {_MERCHANT} AS merchant_assignment_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'paid' ELSE 'cancelled' END AS status,
  'USD' AS currency_code, o_orderdate AS created_at, {_PAID_AT} AS first_paid_at,
  CASE WHEN o_orderstatus = 'F' THEN first_paid_at + INTERVAL '1' DAY * 2 END AS fulfilled_at,
  CASE WHEN o_orderstatus = 'F' THEN first_paid_at + INTERVAL '1' DAY * 3 END AS completed_at,
  CASE WHEN o_orderstatus = 'P' THEN first_paid_at + INTERVAL '1' DAY * 1 END AS cancelled_at,
  o_orderkey % 100 = 13 AS is_test, first_paid_at + INTERVAL '1' DAY * (o_orderkey % 40) AS recorded_at,
  recorded_at AS updated_at
FROM {{orders}}""",
    "commerce_order_item": f"""
SELECT {_LINE} AS commerce_order_item_id, CONCAT('ITEM-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS external_order_item_id,
  l_orderkey AS commerce_order_id, l_partkey AS product_id, CONCAT('CAT-', l_partkey % 12) AS product_category_code,
  CAST(l_quantity AS INT) AS quantity, {_LINE_AMOUNT} AS discounted_item_amount, 'USD' AS currency_code,
  l_shipdate AS created_at, (l_linenumber = 7 AND l_partkey % 10 = 0) AS is_test, l_shipdate AS recorded_at
FROM {{lineitem}}""",
    "commerce_refund": f"""
SELECT {_LINE} AS commerce_refund_id, CONCAT('REF-', {_LINE}) AS external_refund_id, l_orderkey AS commerce_order_id,
  CASE l_linestatus WHEN 'F' THEN 'succeeded' ELSE 'pending' END AS status,
  {_LINE_AMOUNT} AS item_refund_amount, CAST(0 AS DECIMAL(19,4)) AS tax_refund_amount,
  CAST(0 AS DECIMAL(19,4)) AS shipping_refund_amount, {_LINE_AMOUNT} AS total_refund_amount, 'USD' AS currency_code,
  'returned' AS reason_code, l_shipdate - INTERVAL '1' DAY * 2 AS requested_at,
  CASE l_linestatus WHEN 'F' THEN l_shipdate END AS processed_at,
  CASE l_linestatus WHEN 'F' THEN {_REFUND_TIME} END AS succeeded_at,
  {_NO_TIME} AS failed_at, {_NO_TIME} AS cancelled_at, l_partkey % 60 = 5 AS is_test,
  {_REFUND_TIME} + INTERVAL '1' DAY * (l_orderkey % 30) AS recorded_at, recorded_at AS updated_at
FROM {{lineitem}} WHERE l_returnflag = 'R'""",
    "refund_item_allocation": f"""
SELECT CONCAT('A-', {_LINE}) AS refund_item_allocation_id, CONCAT('ALL-', {_LINE}) AS external_refund_allocation_id,
  {_LINE} AS commerce_refund_id, {_LINE} AS commerce_order_item_id,
  CAST(CASE WHEN l_partkey % 97 = 0 AND {_LINE_AMOUNT} > 1 THEN {_LINE_AMOUNT} - 1 ELSE {_LINE_AMOUNT} END AS DECIMAL(19,4)) AS allocated_item_amount,
  'USD' AS currency_code, l_shipdate AS created_at, {_NO_TIME} AS corrected_at, l_partkey % 120 = 6 AS is_test,
  l_shipdate AS recorded_at, l_shipdate AS updated_at
FROM {{lineitem}} WHERE l_returnflag = 'R'""",
    "platform_fee_charge": f"""
SELECT o_orderkey * 2 AS platform_fee_charge_id, CONCAT('FEE-', o_orderkey) AS external_fee_charge_id,
  CASE WHEN o_orderkey % 10 <> 0 THEN CONCAT('PFC-', o_orderkey) END AS provider_charge_id,
  o_orderkey AS commerce_order_id, CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'succeeded' END AS status,
  CAST(CAST(o_totalprice AS DECIMAL(15,2)) * CAST(0.02 AS DECIMAL(3,2)) AS DECIMAL(19,4)) AS fee_amount,
  'USD' AS currency_code, {_PAID_AT} AS attempted_at,
  CASE WHEN o_orderkey % 10 <> 0 THEN attempted_at + INTERVAL '1' HOUR * 2 END AS succeeded_at,
  CASE WHEN o_orderkey % 10 = 0 THEN attempted_at + INTERVAL '1' HOUR * 2 END AS failed_at,
  {_NO_TIME} AS cancelled_at, o_orderkey % 70 = 9 AS is_test,
  attempted_at + INTERVAL '1' HOUR * (2 + o_orderkey % 600) AS recorded_at
FROM {{orders}}""",
    "marketing_channel": """
SELECT CAST(r_regionkey + 1 AS BIGINT) AS marketing_channel_id,
  CASE r_regionkey WHEN 0 THEN 'paid_search' WHEN 1 THEN 'paid_social' WHEN 2 THEN 'organic' WHEN 3 THEN 'direct' ELSE 'test_paid' END AS channel_code,
  CASE r_regionkey WHEN 0 THEN 'Paid search' WHEN 1 THEN 'Paid social' WHEN 2 THEN 'Organic' WHEN 3 THEN 'Direct' ELSE 'Test' END AS channel_name,
  CASE r_regionkey WHEN 2 THEN 'organic' WHEN 3 THEN 'direct' ELSE 'paid' END AS channel_type,
  CASE r_regionkey WHEN 1 THEN 'inactive' ELSE 'active' END AS status,
  TIMESTAMP '1994-06-01 00:00:00' AS effective_from,
  CASE WHEN r_regionkey = 1 THEN TIMESTAMP '1997-05-20 12:00:00' END AS effective_to,
  r_regionkey = 4 AS is_test, TIMESTAMP '1994-06-01 00:00:00' AS created_at,
  TIMESTAMP '1994-06-01 00:00:00' AS recorded_at, TIMESTAMP '1994-06-01 00:00:00' AS updated_at
FROM {region} WHERE r_regionkey < 5""",
    "marketing_campaign": f"""
SELECT c_custkey * 2 + 1 AS marketing_campaign_id, CONCAT('CMP-S-', c_custkey) AS external_campaign_id,
  c_custkey AS organization_id, CAST(NULL AS BIGINT) AS merchant_assignment_id, 1 + c_custkey % 3 AS primary_channel_id,
  'saas' AS business_scope, CONCAT('SaaS campaign ', c_custkey) AS campaign_name, 'active' AS status,
  {_registered('c_custkey')} + INTERVAL '1' DAY * (c_custkey % 25) AS created_at, created_at AS started_at,
  {_NO_TIME} AS ended_at, created_at AS status_updated_at, c_custkey % 41 = 6 AS is_test,
  created_at + INTERVAL '1' HOUR AS recorded_at, created_at AS updated_at
FROM {{customer}}
UNION ALL
SELECT s_suppkey * 2, CONCAT('CMP-C-', s_suppkey), s_suppkey, s_suppkey, 1 + s_suppkey % 3, 'commerce',
  CONCAT('Commerce campaign ', s_suppkey), 'active', TIMESTAMP '1994-07-01 00:00:00', TIMESTAMP '1994-07-01 00:00:00',
  {_NO_TIME}, TIMESTAMP '1994-07-01 00:00:00', s_suppkey % 41 = 6, TIMESTAMP '1994-07-01 00:00:00', TIMESTAMP '1994-07-01 00:00:00'
FROM {{supplier}}""",
    "campaign_daily_spend": _SPEND,
    "marketing_touch": _TOUCH,
}

# The driver's schemas, so that reading a table needs no inference job.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}
DRIVER_TABLES = tuple(DRIVER_SCHEMAS)


def definition_for_spark(name: str) -> str:
    """Spark's plain TIMESTAMP is zoned; the model's instants are naive UTC."""
    text = DEFINITIONS[name]
    return text.replace("TIMESTAMP '", "TIMESTAMP_NTZ '").replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")


def derived_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazily derived entities; a table that no plan asks for is never read."""
    def scan(name: str) -> DataFrame:
        return spark.read.schema(DRIVER_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    def load(name: str) -> DataFrame:
        text = definition_for_spark(name)
        used = [t for t in DRIVER_TABLES if "{" + t + "}" in text]
        return spark.sql(text, **{t: scan(t) for t in used})

    return Tables(load, DEFINITIONS.keys())
