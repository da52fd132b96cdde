"""DuckDB statements for the single operators and the data-quality reports."""

from __future__ import annotations

from oracles.entities import months, query
from oracles.metrics import _CLEAN, _EVENTS, _MONEY, _RETURNS, _SEEN_SPEND, _SHOP, _BACK, _SPEND, _SUBS, _m
from tallyhouse.operators.rules import CHECKS, REFERENCES, UNIQUE
from tallyhouse.schemas import SCHEMAS, primary_key

_ALL = [name for name in SCHEMAS if name != "attributed_conversion"]
_FACT = "COALESCE(invoice_payment_attempt_id, commerce_order_id, platform_fee_charge_id)"

# the planted faults of the result table, restated
_FAULTY = f"""
faulty AS (SELECT * REPLACE (
    CASE WHEN {_FACT} % 501 = 1 THEN conversion_at - INTERVAL 1 HOUR ELSE conversion_at END AS conversion_at,
    is_test AND {_FACT} % 13 <> 2 AS is_test,
    CASE WHEN {_FACT} % 401 = 3 THEN 5 ELSE marketing_channel_id END AS marketing_channel_id,
    CASE WHEN source_data_cutoff_at = @cutoff AND {_FACT} % 301 = 4 THEN @early ELSE recorded_at END AS recorded_at,
    CASE WHEN {_FACT} % 601 = 5 THEN 0 ELSE selected_marketing_touch_id END AS selected_marketing_touch_id)
  FROM attributed_conversion)
"""


def _table(name: str) -> str:
    return "faulty" if name == "attributed_conversion" else name


def _report(parts: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST(({sql}) AS BIGINT) AS violations" for rule, sql in parts.items())


def _digit(table: str) -> str:
    key = f"CAST({primary_key(table)} AS VARCHAR)"
    return f"COALESCE(TRY_CAST({key} AS BIGINT) % 16, CAST('0x' || substr(md5({key}), 1, 1) AS INTEGER))"


def _spoiled(table: str) -> str:
    """The planted faults, restated by SQL type name and place."""
    parts, d = [], _digit(table)
    for place, field in enumerate(SCHEMAS[table]):
        name, kind = field.name, field.dataType.simpleString()
        if place == 0:
            continue
        if kind == "decimal(19,4)":
            parts.append(f"CAST(CASE WHEN {d} < 6 THEN -1 - {name} ELSE {name} END AS DECIMAL(19,4)) AS {name}")
        elif kind == "string":
            parts.append(f"CASE WHEN {d} BETWEEN 3 AND 5 THEN '' ELSE {name} END AS {name}")
        elif kind == "int":
            parts.append(f"CASE WHEN {d} BETWEEN 3 AND 5 THEN 0 ELSE {name} END AS {name}")
        elif kind == "timestamp_ntz":
            gone = f"WHEN {d} BETWEEN 9 AND 11 THEN NULL WHEN {d} = 15 THEN TIMESTAMP '1990-01-01'" if field.nullable else ""
            parts.append(f"CASE WHEN {d} BETWEEN 6 AND 8 THEN {name} - INTERVAL {400 * place} DAY {gone} ELSE {name} END AS {name}")
        elif kind == "bigint" and field.nullable:
            parts.append(f"CASE WHEN {d} BETWEEN 12 AND 14 THEN 7 ELSE {name} END AS {name}")
    return f"(SELECT * REPLACE ({', '.join(parts)}) FROM {table})"


def _checks() -> str:
    """One pass per table: all its counts, unfolded."""
    parts = []
    for table, rules in CHECKS.items():
        names = ", ".join(f"'{rule}'" for rule in rules)
        counts = ", ".join(f"COUNT(*) FILTER (({predicate}) = FALSE)" for predicate in rules.values())
        parts.append(f"SELECT '{table}' AS table_name, UNNEST([{names}]) AS rule, UNNEST([{counts}]) AS violations FROM {_spoiled(table)}")
    return " UNION ALL ".join(parts)


def _check_rows() -> str:
    parts = [
        f"SELECT '{rule}' AS rule, attributed_conversion_id AS record_id FROM faulty WHERE ({predicate}) = FALSE"
        for rule, predicate in CHECKS["attributed_conversion"].items()
    ]
    return ", " + _FAULTY.strip() + " " + " UNION ALL ".join(parts)


def _uniques() -> str:
    parts = []
    for table, rule, columns in UNIQUE:
        names = columns
        present = " AND ".join(f"{c} IS NOT NULL" for c in names)
        parts.append(
            f"SELECT '{table}' AS table_name, '{rule}' AS rule, COUNT(*) AS violations FROM "
            f"(SELECT 1 FROM (FROM {table} UNION ALL FROM {table} WHERE {_digit(table)} < 3) WHERE {present} GROUP BY {', '.join(names)} HAVING COUNT(*) > 1)"
        )
    return " UNION ALL ".join(parts)


def _keys() -> str:
    parts = [
        f"SELECT '{child}' AS table_name, '{column}' AS rule, COUNT(*) AS violations FROM {child} c WHERE c.{column} IS NOT NULL AND {_digit(child).replace(primary_key(child), 'c.' + primary_key(child))} >= 3 "
        f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{primary_key(parent)} = c.{column} AND {_digit(parent).replace(primary_key(parent), 'p.' + primary_key(parent))} >= 3)"
        for child, column, parent in REFERENCES
    ]
    return " UNION ALL ".join(parts)


_STORED = """
stored AS (SELECT * REPLACE (CASE WHEN commerce_order_id % 50 = 1 THEN 'created' ELSE status END AS status)
    FROM commerce_order WHERE commerce_order_id % 5 <> 0
  UNION ALL SELECT * REPLACE (-commerce_order_id - 1 AS commerce_order_id, 'X-' || external_order_id AS external_order_id)
    FROM commerce_order WHERE commerce_order_id % 100 = 2)
"""
_VARIANTS = """
base AS (SELECT external_order_id AS k, merchant_assignment_id AS m, status AS s, completed_at AS c FROM commerce_order),
n AS (SELECT COUNT(*) FILTER (m % 7 = 3) AS hit, COUNT(*) FILTER (m % 7 = 3 AND c IS NOT NULL) AS nulled, COUNT(*) AS whole FROM base),
v AS (SELECT UNNEST([
  {'variant': 'same', 'failure_code': NULL},
  {'variant': 'fewer_rows', 'failure_code': CASE WHEN hit > 0 THEN 'ROW_COUNT_MISMATCH' END},
  {'variant': 'null_for_value', 'failure_code': CASE WHEN nulled > 0 THEN 'NULL_MISMATCH' END},
  {'variant': 'other_type', 'failure_code': CASE WHEN whole > 0 THEN 'TYPE_MISMATCH' END},
  {'variant': 'other_value', 'failure_code': CASE WHEN hit > 0 THEN '@value' END},
  {'variant': 'other_name', 'failure_code': 'COLUMN_NAME_MISMATCH'},
  {'variant': 'other_order', 'failure_code': 'COLUMN_ORDER_MISMATCH'},
  {'variant': 'fewer_columns', 'failure_code': 'COLUMN_COUNT_MISMATCH'}]) AS r FROM n)
"""
_COMPARED = "SELECT r.variant AS variant, r.failure_code IS NULL AS matches, r.failure_code AS failure_code FROM v"

_FACTS = f"""
, {_FAULTY.strip()},
stated AS (SELECT f.*, c.kind IS NOT NULL AS known, c.subject AS fs, c.ats AS fa, c.fact_test AS ft FROM faulty f
  LEFT JOIN fact c ON c.kind = f.conversion_type AND COALESCE(c.pay, c.ord, c.fee) = {_FACT.replace('invoice', 'f.invoice').replace('commerce_order', 'f.commerce_order').replace('platform', 'f.platform')}),
linked AS (SELECT f.*, t.marketing_touch_id AS tt, t.marketing_channel_id AS tc, t.marketing_campaign_id AS tg,
    COALESCE(t.organization_id, t.consumer_id) AS ts, g.merchant_assignment_id AS gm, o.merchant_assignment_id AS om
  FROM faulty f LEFT JOIN marketing_touch t ON t.marketing_touch_id = f.selected_marketing_touch_id
  LEFT JOIN marketing_campaign g ON g.marketing_campaign_id = f.marketing_campaign_id
  LEFT JOIN platform_fee_charge e ON e.platform_fee_charge_id = f.platform_fee_charge_id
  LEFT JOIN commerce_order o ON o.commerce_order_id = COALESCE(f.commerce_order_id, e.commerce_order_id)
  WHERE f.selected_marketing_touch_id IS NOT NULL)
"""

OPERATORS: dict[str, str] = {
    "state_asof_multi": query(_SUBS, f"""
SELECT report_month AS as_of, subscription_id, organization_id, status_after, plan_version_after_id, normalized_mrr_after
FROM state JOIN {months(1, 6)} ON as_of = b""", ctes=_EVENTS),
    "latest_spend_revision": query(_SPEND, """
SELECT marketing_campaign_id, business_date, amount AS spend_amount FROM seen
WHERE business_date >= DATE '1997-04-01' AND business_date < DATE '1997-07-01'""", ctes=_SEEN_SPEND),
    "attribution_last_touch": query([], "SELECT * FROM attributed_conversion WHERE source_data_cutoff_at = @cutoff", attribution=True),
    "attribution_incremental": query([], "SELECT * FROM attributed_conversion WHERE source_data_cutoff_at = @cutoff", attribution=True),
    "attribution_two_cutoffs": query([], "SELECT * FROM attributed_conversion", attribution=True),
    "attribution_own_cutoffs": query([], "SELECT * FROM attributed_conversion", attribution=True, cutoffs="""
(SELECT i AS day, j AS hour, @early + INTERVAL (i) DAY + INTERVAL (j) HOUR AS cutoff FROM range(50) a(i), range(7) b(j)) c
  ON c.day = COALESCE(f.pay, f.ord, f.fee) % 50 AND c.hour = COALESCE(f.pay, f.ord, f.fee) % 7 AND f.ats <= c.cutoff"""),
    "attribution_latest": query([], f"""
SELECT conversion_type, attributed_conversion_id, attribution_result, marketing_channel_id, source_data_cutoff_at
FROM attributed_conversion WHERE NOT is_test
QUALIFY ROW_NUMBER() OVER (PARTITION BY conversion_type, {_FACT} ORDER BY source_data_cutoff_at DESC) = 1""", attribution=True),
    "densify_periods": query(_SHOP, f"""
SELECT k.merchant_assignment_id, report_month, COUNT(commerce_order_id) AS order_count
FROM (SELECT DISTINCT merchant_assignment_id FROM ord WHERE first_paid_at >= @apr AND first_paid_at < @jul) k CROSS JOIN {months(4, 6)}
LEFT JOIN ord o ON o.merchant_assignment_id = k.merchant_assignment_id AND first_paid_at >= a AND first_paid_at < b GROUP BY ALL""", ctes=_CLEAN),
    "key_union": query([*_SHOP, *_BACK, "platform_fee_charge"], f"""
SELECT merchant_assignment_id, {_m('SUM(g)')} AS gmv, {_m('SUM(r)')} AS refund FROM (
  SELECT merchant_assignment_id, amount AS g, 0 AS r FROM sale WHERE first_paid_at >= @jun AND first_paid_at < @jul
  UNION ALL SELECT merchant_assignment_id, 0, amount FROM refund WHERE succeeded_at >= @jun AND succeeded_at < @jul) GROUP BY 1""", ctes=_CLEAN + _RETURNS),
    "total_row": query(_SHOP, f"""
SELECT COALESCE(product_category_code, 'TOTAL') AS product_category_code, CAST(SUM(discounted_item_amount) AS {_MONEY}) AS gmv
FROM line GROUP BY ROLLUP (product_category_code)""", ctes=_CLEAN),
    "required_rows": query(_SHOP, f"""
SELECT m.merchant_assignment_id, {_m('SUM(amount)')} AS gmv FROM shop m
LEFT JOIN sale s ON s.merchant_assignment_id = m.merchant_assignment_id AND first_paid_at >= @jun AND first_paid_at < @jul GROUP BY 1""", ctes=_CLEAN),
    "merchants_without_sales": query(_SHOP, """
SELECT merchant_assignment_id, merchant_name FROM shop WHERE merchant_assignment_id NOT IN
  (SELECT merchant_assignment_id FROM sale WHERE first_paid_at >= @jun AND first_paid_at < @jul)""", ctes=_CLEAN),
    "window_partition_count": query([], f"""
SELECT attributed_conversion_id, CASE WHEN conversion_at <= @early THEN 2 ELSE 1 END AS revision_count FROM attributed_conversion""", attribution=True),
    "class_representative": query([], """
SELECT conversion_type, attribution_result, attributed_conversion_id, conversion_at FROM attributed_conversion
QUALIFY ROW_NUMBER() OVER (PARTITION BY conversion_type, attribution_result ORDER BY conversion_at, attributed_conversion_id) = 1""", attribution=True),
    "dq_checks": query(_ALL, _checks(), attribution=True),
    "dq_check_rows": query([], _check_rows(), attribution=True),
    "dq_unique": query(_ALL, _uniques(), attribution=True),
    "dq_line_key": query(["commerce_order_item"], """
SELECT commerce_order_id, product_id, COUNT(*) AS row_count FROM commerce_order_item GROUP BY 1, 2 HAVING COUNT(*) > 1"""),
    "dq_foreign_key": query(_ALL, _keys(), attribution=True),
    "dq_interval_overlap": query(["merchant"], _report({"overlapping_assignments": """
SELECT COUNT(DISTINCT b.merchant_assignment_id) FROM merchant a JOIN merchant b ON a.merchant_id = b.merchant_id
  AND (a.assignment_valid_from, a.merchant_assignment_id) < (b.assignment_valid_from, b.merchant_assignment_id)
WHERE b.assignment_valid_from < COALESCE(a.assignment_valid_to, TIMESTAMP '9999-01-01')"""})),
    "dq_version_gap": query(["campaign_daily_spend"], _report({
        "spend_version_gap": """SELECT COUNT(*) FROM (SELECT list_sort(list(version_number)) AS v FROM campaign_daily_spend
          GROUP BY marketing_campaign_id, business_date) WHERE v <> range(1, len(v) + 1)""",
        "spend_lineage_broken": """SELECT COUNT(*) FROM campaign_daily_spend s LEFT JOIN campaign_daily_spend b
          ON b.campaign_daily_spend_id = s.supersedes_campaign_daily_spend_id
          WHERE NOT CASE WHEN s.version_number = 1 THEN s.supersedes_campaign_daily_spend_id IS NULL
            ELSE COALESCE(b.marketing_campaign_id = s.marketing_campaign_id AND b.business_date = s.business_date
              AND b.version_number + 1 = s.version_number AND b.recorded_at < s.recorded_at, FALSE) END""",
        "spend_fork": """SELECT COUNT(*) FROM (SELECT 1 FROM campaign_daily_spend WHERE supersedes_campaign_daily_spend_id IS NOT NULL
          GROUP BY supersedes_campaign_daily_spend_id HAVING COUNT(*) > 1)""",
        "spend_before_final": "SELECT COUNT(*) FROM campaign_daily_spend WHERE finalized_at > recorded_at",
        "spend_never_visible": """SELECT COUNT(*) FROM (SELECT 1 FROM campaign_daily_spend GROUP BY marketing_campaign_id, business_date
          HAVING BOOL_AND(recorded_at > @cutoff))""",
    })),
    "dq_sequence": query([], ", " + _FAULTY.strip() + " " + _report({"revision_chain_broken": f"""
SELECT COUNT(*) FROM faulty b WHERE EXISTS (SELECT 1 FROM faulty a WHERE a.conversion_type = b.conversion_type
  AND {_FACT.replace('invoice', 'a.invoice').replace('commerce_order', 'a.commerce_order').replace('platform', 'a.platform')}
    = {_FACT.replace('invoice', 'b.invoice').replace('commerce_order', 'b.commerce_order').replace('platform', 'b.platform')}
  AND a.source_data_cutoff_at < b.source_data_cutoff_at AND b.recorded_at <= a.recorded_at)"""}), attribution=True),
    "dq_subscription_history": query([*_SUBS, "subscription_invoice", "invoice_payment_attempt"], _report({
        "wrong_movement": """SELECT COUNT(*) FROM subscription_state_event WHERE NOT CASE event_type
          WHEN 'expansion' THEN normalized_mrr_after > normalized_mrr_before
          WHEN 'contraction' THEN normalized_mrr_after > 0 AND normalized_mrr_after < normalized_mrr_before
          WHEN 'cancellation_effective' THEN normalized_mrr_after = 0 ELSE TRUE END""",
        "wrong_normalization": """SELECT COUNT(*) FROM subscription_state_event
          WHERE recurring_amount_before <> normalized_mrr_before * CASE billing_interval_before WHEN 'annual' THEN 12 ELSE 1 END
            OR recurring_amount_after <> normalized_mrr_after * CASE billing_interval_after WHEN 'annual' THEN 12 ELSE 1 END""",
        "subscription_without_event": """SELECT COUNT(*) FROM subscription WHERE subscription_id NOT IN (SELECT subscription_id FROM subscription_state_event)""",
        "current_state_disagrees": """SELECT COUNT(*) FROM subscription s JOIN (SELECT subscription_id,
            arg_max({'s': status_after, 'p': plan_version_after_id}, (effective_at, subscription_state_event_id)) AS l
          FROM subscription_state_event GROUP BY 1) e USING (subscription_id)
          WHERE s.current_status IS DISTINCT FROM l.s OR s.current_plan_version_id IS DISTINCT FROM l.p""",
        "paid_without_payment": """SELECT COUNT(*) FROM subscription_invoice i WHERE status = 'paid' AND NOT EXISTS
          (SELECT 1 FROM invoice_payment_attempt p WHERE p.subscription_invoice_id = i.subscription_invoice_id AND p.status = 'succeeded')""",
    })),
    "dq_owner_mismatch": query([*_SHOP, *_BACK, "marketing_campaign"], _report({
        "item_of_other_merchant": """SELECT COUNT(*) FROM commerce_order_item JOIN commerce_order o USING (commerce_order_id)
          JOIN product p USING (product_id) WHERE o.merchant_assignment_id <> p.merchant_assignment_id""",
        "allocation_of_other_order": """SELECT COUNT(*) FROM refund_item_allocation JOIN commerce_refund r USING (commerce_refund_id)
          JOIN commerce_order_item i USING (commerce_order_item_id) WHERE r.commerce_order_id <> i.commerce_order_id""",
        "campaign_scope_broken": """SELECT COUNT(*) FROM marketing_campaign g LEFT JOIN merchant m USING (merchant_assignment_id)
          WHERE CASE business_scope WHEN 'saas' THEN g.merchant_assignment_id IS NOT NULL ELSE m.organization_id IS DISTINCT FROM g.organization_id END""",
    })),
    "dq_sum_reconcile": query(_BACK, _report({"refund_not_reconciled": """
SELECT COUNT(*) FROM commerce_refund r LEFT JOIN (SELECT commerce_refund_id, SUM(allocated_item_amount) AS v FROM refund_item_allocation GROUP BY 1) a
USING (commerce_refund_id) WHERE COALESCE(a.v, 0) <> r.item_refund_amount"""})),
    "dq_touch": query(["marketing_touch", "marketing_channel", "marketing_campaign"], _report({
        "touch_subject_broken": "SELECT COUNT(*) FROM marketing_touch WHERE (organization_id IS NULL) = (consumer_id IS NULL)",
        "touch_type_mismatch": """SELECT COUNT(*) FROM marketing_touch JOIN marketing_channel h USING (marketing_channel_id)
          WHERE (h.channel_type = 'direct') <> (touch_type = 'direct')""",
        "touch_campaign_mismatch": """SELECT COUNT(*) FROM marketing_touch t JOIN marketing_campaign g USING (marketing_campaign_id)
          WHERE g.primary_channel_id <> t.marketing_channel_id OR (g.business_scope = 'saas') <> (t.organization_id IS NOT NULL)
            OR g.organization_id <> t.organization_id""",
    })),
    "dq_conversion": query(["merchant"], _FACTS + _report({
        "conversion_disagrees_with_fact": "SELECT COUNT(*) FROM stated WHERE NOT COALESCE(COALESCE(organization_id, consumer_id) = fs AND conversion_at = fa, FALSE)",
        "conversion_window_wrong": """SELECT COUNT(*) FROM faulty WHERE window_started_at <> conversion_at - INTERVAL 168 HOUR
          OR history_complete <> (conversion_at - INTERVAL 168 HOUR >= @history)""",
        "conversion_leaks_test": """SELECT COUNT(*) FROM stated s WHERE NOT s.is_test AND (COALESCE(ft, FALSE)
          OR organization_id IN (SELECT organization_id FROM organization WHERE is_test)
          OR consumer_id IN (SELECT consumer_id FROM consumer WHERE is_test))""",
        "conversion_times_wrong": """SELECT COUNT(*) FROM faulty WHERE conversion_at > source_data_cutoff_at
          OR source_data_cutoff_at > recorded_at OR source_data_cutoff_at > @cutoff""",
        "selected_links_disagree": """SELECT COUNT(*) FROM linked WHERE COALESCE(organization_id, consumer_id) IS DISTINCT FROM ts
          OR marketing_channel_id IS DISTINCT FROM tc OR marketing_campaign_id IS DISTINCT FROM tg
          OR (consumer_id IS NOT NULL AND tg IS NOT NULL AND gm IS DISTINCT FROM om)""",
        "direct_channel_wrong": """SELECT COUNT(*) FROM faulty f LEFT JOIN marketing_channel h USING (marketing_channel_id)
          WHERE attribution_result = 'direct' AND NOT COALESCE(selected_marketing_touch_id IS NULL AND marketing_campaign_id IS NULL
            AND h.channel_code = 'direct' AND h.channel_type = 'direct' AND NOT h.is_test AND h.effective_from <= conversion_at
            AND COALESCE(conversion_at < h.effective_to, TRUE), FALSE)""",
        "unknown_keeps_links": """SELECT COUNT(*) FROM faulty WHERE attribution_result = 'unknown_unattributed'
          AND (selected_marketing_touch_id IS NOT NULL OR marketing_channel_id IS NOT NULL OR marketing_campaign_id IS NOT NULL)""",
    }), attribution=True),
    "dq_visibility": query(_ALL, ", " + _FAULTY.strip() + " " + _report({
        "recorded_after_cutoff": "SELECT SUM(n) FROM (" + " UNION ALL ".join(
            f"SELECT COUNT(*) AS n FROM {_table(name)} WHERE recorded_at > @cutoff" for name in SCHEMAS) + ")",
        "tables_without_test_rows": "SELECT COUNT(*) FROM (" + " UNION ALL ".join(
            f"SELECT COALESCE(BOOL_OR(is_test), FALSE) AS t FROM {_table(name)}" for name in SCHEMAS) + ") WHERE NOT t",
    }), attribution=True),
    "dq_attribution_recheck": query([], ", " + _FAULTY.strip() + """
SELECT f.attributed_conversion_id AS record_id FROM faulty f JOIN attributed_conversion a USING (attributed_conversion_id)
WHERE (f.marketing_channel_id, f.selected_marketing_touch_id) IS DISTINCT FROM (a.marketing_channel_id, a.selected_marketing_touch_id)""", attribution=True),
    "dq_text_formats": query(["commerce_refund"], """
SELECT commerce_refund_id AS record_id, column_name, problem FROM (
  SELECT commerce_refund_id, 'requested_at' AS column_name, 'not_an_instant' AS problem FROM commerce_refund WHERE length(commerce_refund_id) % 7 = 1
  UNION ALL SELECT commerce_refund_id, 'item_refund_amount', 'not_money' FROM commerce_refund WHERE length(commerce_refund_id) % 9 = 2
  UNION ALL SELECT commerce_refund_id, 'recorded_at', 'after_snapshot' FROM commerce_refund WHERE recorded_at > @cutoff)"""),
    "load_upsert_check": query(["commerce_order"], """
SELECT UNNEST(['append', 'unchanged', 'conflict']) AS outcome, UNNEST([
  COUNT(*) FILTER (commerce_order_id % 5 = 0),
  COUNT(*) FILTER (commerce_order_id % 5 <> 0 AND NOT (commerce_order_id % 50 = 1)),
  COUNT(*) FILTER (commerce_order_id % 50 = 1)]) AS row_count FROM commerce_order"""),
    "verify_rows": query(["commerce_order"], """
SELECT COALESCE(a.external_order_id, b.external_order_id) AS external_order_id,
  CASE WHEN b.external_order_id IS NULL THEN 'missing' WHEN a.external_order_id IS NULL THEN 'excess' ELSE 'differs' END AS problem
FROM commerce_order a FULL JOIN stored b ON a.external_order_id = b.external_order_id
WHERE a.commerce_order_id IS DISTINCT FROM b.commerce_order_id OR a.status IS DISTINCT FROM b.status""", ctes=_STORED),
    "unload_rows": query(["commerce_order"], """
SELECT commerce_order_id, external_order_id, status FROM stored s
WHERE NOT EXISTS (SELECT 1 FROM commerce_order o WHERE o.external_order_id = s.external_order_id AND o.status = s.status)""", ctes=_STORED),
    "content_counts": query(_ALL, " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS row_count FROM {name}" for name in SCHEMAS), attribution=True),
    "ambiguous_match_keys": query(["marketing_touch"], """
SELECT organization_id, marketing_channel_id, COUNT(*) AS row_count FROM marketing_touch GROUP BY ALL HAVING COUNT(*) > 1"""),
    "compare_multiset": query(["commerce_order"], _COMPARED, ctes=_VARIANTS.replace("@value", "UNORDERED_MULTISET_MISMATCH")),
    "compare_ordered": query(["commerce_order"], _COMPARED, ctes=_VARIANTS.replace("@value", "VALUE_MISMATCH")),
    "suite_counts": query(["commerce_order"], """
SELECT UNNEST(['PASS', 'FAIL_ACTION', 'FAIL_STRUCTURE', 'FAIL_EXECUTION', 'FAIL_RESULT', 'NOT_EVALUATED']) AS status,
  UNNEST([COUNT(*) FILTER (status = 'completed'), 0, 0, 0, COUNT(*) FILTER (status = 'paid'), COUNT(*) FILTER (status = 'cancelled')]) AS cases
FROM commerce_order"""),
}

OPERATORS["response_completeness"] = query(["commerce_order", "platform_fee_charge"], """
SELECT commerce_order_id AS case_id, CASE WHEN commerce_order_id % 11 = 4 THEN 'unknown' WHEN o.status = 'cancelled' THEN 'forbidden' ELSE 'missing' END AS problem
FROM commerce_order o JOIN platform_fee_charge f USING (commerce_order_id)
WHERE CASE WHEN commerce_order_id % 11 = 4 THEN f.status = 'succeeded' WHEN o.status = 'cancelled' THEN f.status = 'succeeded' ELSE f.status <> 'succeeded' END""")


def _cell(kind: str, text: str, nullable: bool = False) -> str:
    shown = f"COALESCE('\"' || {text} || '\"', 'null')"
    label = f"CASE WHEN {text} IS NULL THEN 'null' ELSE '{kind}' END" if nullable else f"'{kind}'"
    return f"'{{\"kind\":\"' || {label} || '\",\"text\":' || {shown} || '}}'"


_STAMP = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
_CELLS = " || ',' || ".join([
    *[_cell(kind, text.format(name), nullable) for name, kind, text, nullable in [
        ("commerce_order_id", "integer", "CAST({} AS VARCHAR)", False),
        ("external_order_id", "string", "{}", False),
        ("consumer_id", "integer", "CAST({} AS VARCHAR)", False),
        ("merchant_assignment_id", "integer", "CAST({} AS VARCHAR)", False),
        ("status", "string", "{}", False),
        ("currency_code", "string", "{}", False),
        ("created_at", "datetime", _STAMP, False),
        ("first_paid_at", "datetime", _STAMP, True),
        ("fulfilled_at", "datetime", _STAMP, True),
        ("completed_at", "datetime", _STAMP, True),
        ("cancelled_at", "datetime", _STAMP, True),
        ("is_test", "boolean", "CASE WHEN {} THEN 'true' ELSE 'false' END", False),
        ("recorded_at", "datetime", _STAMP, False),
        ("updated_at", "datetime", _STAMP, False),
    ]],
])
_NAMES = "commerce_order_id,external_order_id,consumer_id,merchant_assignment_id,status,currency_code,created_at,first_paid_at,fulfilled_at,completed_at,cancelled_at,is_test,recorded_at,updated_at"
_PARTS = ", ".join(f"SUM(CAST('0x' || substr(x, {1 + 12 * i}, 12) AS BIGINT)) AS s{i}" for i in range(4))
OPERATORS["table_digest"] = query(["commerce_order"], f"""
SELECT n AS row_count, sha256(concat_ws('|', '{_NAMES}', n, s0, s1, s2, s3)) AS content_digest
FROM (SELECT COUNT(*) AS n, {_PARTS} FROM (SELECT sha256('{{"row":[' || {_CELLS} || ']}}') AS x FROM commerce_order))""")


def _digest(at: str, period: str) -> str:
    """Digests per merchant of a month's orders, spelt out: the sums of four slices of each row's hash."""
    row = f"""sha256('{{"at":' || {at} || ',"cells":[' || {_cell("string", "external_order_id")} || ',' || {_cell("string", "status")} || ']}}')"""
    return f"""SELECT CAST(m AS VARCHAR) AS case_id, sha256(concat_ws('|', n, s0, s1, s2, s3)) AS d FROM (
  SELECT m, COUNT(*) AS n, {_PARTS} FROM (SELECT merchant_assignment_id AS m, {row} AS x FROM commerce_order WHERE {period}) GROUP BY m)"""


_MAY, _JUNE = "first_paid_at >= @may AND first_paid_at < @jun", "first_paid_at >= @jun AND first_paid_at < @jul"
_DELTA = f"""
ob AS ({_digest("'null'", _MAY)}), oe AS ({_digest("commerce_order_id", _MAY)}),
nb AS ({_digest("'null'", _JUNE)}), ne AS ({_digest("commerce_order_id", _JUNE)}),
delta AS (SELECT case_id, ob.d AS old_business_digest, oe.d AS old_expected_digest, nb.d AS new_business_digest, ne.d AS new_expected_digest
  FROM ob JOIN oe USING (case_id) FULL JOIN (nb JOIN ne USING (case_id)) USING (case_id))
"""
OPERATORS["case_delta"] = query(["commerce_order"], """
SELECT *, COALESCE(old_expected_digest <> new_expected_digest, FALSE) AS changed, old_business_digest IS NULL AS is_new,
  new_business_digest IS NULL AS is_gone FROM delta""", ctes=_DELTA)
OPERATORS["case_reviews"] = query(["commerce_order"], """
SELECT case_id, CASE WHEN good THEN 'expected growth' END AS change_reason, CASE WHEN good THEN 'may,june' ELSE '' END AS scenario_ids,
  CASE WHEN good THEN 'matches_reviewed' ELSE 'review_required' END AS review_status
FROM (SELECT case_id, CAST(case_id AS BIGINT) % 2 = 0 AS good FROM delta)""", ctes=_DELTA)
OPERATORS["suite_report"] = query(["commerce_order"], """
SELECT CAST(c AS VARCHAR) AS case_id,
  CASE WHEN w = 0 THEN 'deferred' WHEN w <= 3 THEN 'request_clarification' ELSE 'execute_sql' END AS expected_action,
  CASE WHEN w = 7 THEN NULL WHEN w IN (1, 2, 4) THEN 'request_clarification' ELSE 'execute_sql' END AS actual_action,
  CASE WHEN w IN (0, 7) THEN 'NOT_EVALUATED' WHEN w IN (2, 3, 4) THEN 'FAIL_ACTION' WHEN w = 5 THEN 'FAIL_STRUCTURE'
    WHEN w = 6 THEN 'FAIL_EXECUTION' WHEN w IN (8, 9, 10) OR spoilt THEN 'FAIL_RESULT' ELSE 'PASS' END AS status,
  CASE WHEN w IN (2, 3, 4) THEN 'action' WHEN w = 5 THEN 'structure' WHEN w = 6 THEN 'execution'
    WHEN w IN (8, 9, 10) OR spoilt THEN 'comparison' END AS failed_stage,
  CASE w WHEN 0 THEN 'DEFERRED_SCHEMA_DEPENDENCY' WHEN 7 THEN 'MISSING_RESPONSE' WHEN 2 THEN 'CLARIFICATION_CODE_MISMATCH'
    WHEN 3 THEN 'EXPECTED_REQUEST_CLARIFICATION' WHEN 4 THEN 'EXPECTED_EXECUTE_SQL' WHEN 5 THEN 'UNKNOWN_TABLE' WHEN 6 THEN 'QUERY_TIMEOUT'
    WHEN 8 THEN 'COLUMN_COUNT_MISMATCH' WHEN 9 THEN 'COLUMN_NAME_MISMATCH' WHEN 10 THEN 'COLUMN_ORDER_MISMATCH'
    ELSE CASE WHEN spoilt THEN CASE w WHEN 11 THEN 'ROW_COUNT_MISMATCH' WHEN 12 THEN 'NULL_MISMATCH' WHEN 13 THEN 'TYPE_MISMATCH'
      WHEN 14 THEN CASE WHEN c // 16 % 2 = 0 THEN 'VALUE_MISMATCH' ELSE 'UNORDERED_MULTISET_MISMATCH' END END END END AS failure_code,
  CASE WHEN w = 5 THEN 'WILDCARD_SELECT' ELSE '' END AS secondary_codes, NOT spoilt AS same_rows
FROM (SELECT consumer_id AS c, consumer_id % 16 AS w, CASE consumer_id % 16 WHEN 11 THEN BOOL_OR(third) WHEN 13 THEN BOOL_OR(third)
    WHEN 14 THEN BOOL_OR(third) WHEN 12 THEN BOOL_OR(third AND completed_at IS NOT NULL) ELSE FALSE END AS spoilt
  FROM (SELECT *, commerce_order_id % 3 = 0 AS third FROM commerce_order) GROUP BY 1)""")
OPERATORS["result_sink"] = query(["commerce_order", "commerce_refund"], f"""
SELECT 'refunds' AS case_id, 'total_refund_amount,commerce_refund_id,succeeded_at' AS columns,
  ROW_NUMBER() OVER (ORDER BY total_refund_amount, commerce_refund_id) - 1 AS position,
  'decimal:' || CAST(total_refund_amount AS VARCHAR) || '|string:' || commerce_refund_id || '|' ||
    COALESCE('datetime:' || {_STAMP.format("succeeded_at")}, 'null') AS row FROM commerce_refund
UNION ALL SELECT 'sales', 'first_paid_at,commerce_order_id,is_test', ROW_NUMBER() OVER (ORDER BY first_paid_at NULLS FIRST, commerce_order_id) - 1,
  COALESCE('datetime:' || {_STAMP.format("first_paid_at")}, 'null') || '|integer:' || commerce_order_id || '|boolean:' ||
    CASE WHEN is_test THEN 'true' ELSE 'false' END FROM commerce_order""")
OPERATORS["load_then_read"] = query(["commerce_order", "consumer"], """
SELECT version, table_name, COUNT(*) AS row_count, CAST(SUM(id) AS BIGINT) AS id_sum FROM (
  SELECT 'consumer' AS table_name, consumer_id AS id, consumer_id % 3 <> 0 AS first FROM consumer
  UNION ALL SELECT 'commerce_order', commerce_order_id, consumer_id % 3 <> 0 FROM commerce_order
) JOIN (VALUES (1), (2), (3)) v(version) ON CASE version WHEN 1 THEN first WHEN 2 THEN TRUE ELSE table_name = 'consumer' OR NOT first END
GROUP BY ALL""")
OPERATORS["nested_dataset"] = query(["commerce_order", "consumer"], """
SELECT external_order_id, external_consumer_id, first_identified_at, o.status, first_paid_at, o.is_test
FROM commerce_order o JOIN consumer c USING (consumer_id)""")


def _text_formats() -> str:
    parts = []
    for table in SCHEMAS:
        key = f"CAST({primary_key(table)} AS VARCHAR)"
        for field in SCHEMAS[table]:
            name = field.name
            mark = f"substr(md5({key} || ':{name}'), 1, 2)"
            row = f"SELECT '{name}' AS column_name, '{{}}' AS problem, COUNT(*) AS cells, '{table}' AS table_name FROM {table} WHERE {name} IS NOT NULL AND {{}} HAVING COUNT(*) > 0"
            if name.endswith("_at") or name in ("effective_from", "effective_to", "assignment_valid_from", "assignment_valid_to"):
                parts.append(row.format("not_an_instant", f"{mark} IN ('a1', 'b2')"))
                if name == "recorded_at":
                    parts.append(row.format("after_snapshot", f"{mark} NOT IN ('a1', 'b2') AND recorded_at > @cutoff"))
            elif name.endswith("_amount") or name.startswith("normalized_mrr_"):
                parts.append(row.format("not_money", f"{mark} = 'b2'"))
    return " UNION ALL ".join(parts)


OPERATORS["dq_text_formats_all"] = query(_ALL, _text_formats(), attribution=True)
OPERATORS["decode_results"] = query(["commerce_refund"], "SELECT commerce_refund_id, total_refund_amount, succeeded_at, is_test FROM commerce_refund")
OPERATORS["net_changes"] = query(["subscription_state_event"], """
SELECT subscription_id, date_trunc('day', effective_at) AS day,
  arg_min(normalized_mrr_before, (effective_at, subscription_state_event_id)) AS normalized_mrr_before,
  arg_max(normalized_mrr_after, (effective_at, subscription_state_event_id)) AS normalized_mrr_after
FROM subscription_state_event GROUP BY 1, 2""")
OPERATORS["largest_refunds"] = query(["commerce_refund"], """
SELECT commerce_refund_id, total_refund_amount FROM commerce_refund ORDER BY total_refund_amount DESC, commerce_refund_id LIMIT 100""")
