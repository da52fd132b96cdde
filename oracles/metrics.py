"""One DuckDB statement per metric, written from the metric's definition."""

from __future__ import annotations

from oracles.entities import months, query, ratio

_SUBS = ["subscription_state_event", "subscription", "organization", "saas_plan_version"]
_PAY = ["invoice_payment_attempt", "subscription_invoice", "subscription", "organization"]
_SHOP = ["commerce_order", "commerce_order_item", "product", "consumer", "merchant", "organization"]
_BACK = ["commerce_refund", "refund_item_allocation"]
_SPEND = ["campaign_daily_spend", "marketing_campaign", "marketing_channel"]
_ACT = ["organization", "organization_member", "marketing_campaign", "commerce_order", "merchant", "consumer"]

_MONEY = "DECIMAL(19,4)"


def _m(expression: str) -> str:
    return f"CAST(COALESCE({expression}, 0) AS {_MONEY})"


_EVENTS = """
ev AS (SELECT e.*, s.organization_id FROM subscription_state_event e
  JOIN subscription s ON s.subscription_id = e.subscription_id AND NOT s.is_test
  JOIN organization o ON o.organization_id = s.organization_id AND NOT o.is_test
  WHERE NOT e.is_test AND e.recorded_at <= @cutoff),
edge AS (SELECT * FROM (VALUES (@jan), (@feb), (@mar), (@apr), (@may), (@jun), (@jul)) AS x(as_of)),
state AS (SELECT x.as_of, e.* FROM edge x JOIN ev e ON e.effective_at < x.as_of
  QUALIFY ROW_NUMBER() OVER (PARTITION BY x.as_of, e.subscription_id
    ORDER BY e.effective_at DESC, e.subscription_state_event_id DESC) = 1),
alive AS (SELECT * FROM state WHERE status_after IN ('active', 'cancel_scheduled') AND normalized_mrr_after > 0),
plan AS (SELECT saas_plan_version_id AS plan_id, plan_name, tier_code FROM saas_plan_version WHERE NOT is_test)
"""

_PAID = """
paid AS (SELECT p.succeeded_at, p.subscription_fee_amount AS amount FROM invoice_payment_attempt p
  JOIN subscription_invoice i USING (subscription_invoice_id) JOIN subscription s USING (subscription_id)
  JOIN organization o ON o.organization_id = s.organization_id
  WHERE p.status = 'succeeded' AND p.recorded_at <= @cutoff
    AND NOT (p.is_test OR i.is_test OR s.is_test OR o.is_test))
"""

_CHURN = """
span AS (SELECT * FROM (VALUES ('q2', 0, @apr, @jul), ('Q1 baseline', 1, @jan, @apr), ('1997-05', 2, @may, @jun), ('1997-06', 3, @jun, @jul)) AS x(span, pos, a, b)),
opened AS (SELECT span, pos, organization_id, plan_name, tier_code, normalized_mrr_after AS mrr,
    NOT EXISTS (SELECT 1 FROM alive z WHERE z.as_of = span.b AND z.organization_id = l.organization_id) AS gone
  FROM span JOIN alive l ON l.as_of = span.a JOIN plan ON plan_id = l.plan_version_after_id),
lost AS (SELECT span, plan_name, tier_code, e.normalized_mrr_before AS mrr FROM span
  JOIN ev e ON e.effective_at >= span.a AND e.effective_at < span.b AND e.event_type = 'cancellation_effective'
  JOIN plan ON plan_id = e.plan_version_before_id)
"""


def _churn(group: str, where: str, order: str) -> str:
    return f"""
, o AS (SELECT {group} AS g, MIN(pos) AS pos, COUNT(DISTINCT organization_id) AS logos,
    COUNT(DISTINCT organization_id) FILTER (gone) AS gone, SUM(mrr) AS mrr FROM opened WHERE {where} GROUP BY 1),
c AS (SELECT {group} AS g, SUM(mrr) AS mrr FROM lost WHERE {where} GROUP BY 1)
SELECT o.g AS {order}, logos AS opening_logos, gone AS churned_logos, {ratio('gone', 'logos')} AS logo_churn_rate,
  CAST(o.mrr AS {_MONEY}) AS opening_mrr, {_m('c.mrr')} AS churned_mrr, {ratio(_m('c.mrr'), 'o.mrr')} AS revenue_churn_rate
FROM o LEFT JOIN c USING (g) ORDER BY {'o.g' if order == 'plan_name' else 'o.pos'}"""


_CLEAN = """
shop AS (SELECT m.* FROM merchant m JOIN organization o ON o.organization_id = m.organization_id
  WHERE NOT m.is_test AND NOT o.is_test),
line AS (SELECT i.* FROM commerce_order_item i JOIN product p USING (product_id) WHERE NOT i.is_test AND NOT p.is_test),
anyord AS (SELECT o.* FROM commerce_order o JOIN consumer c USING (consumer_id) WHERE NOT o.is_test AND NOT c.is_test),
ord AS (SELECT * FROM anyord WHERE recorded_at <= @cutoff
  AND merchant_assignment_id IN (SELECT merchant_assignment_id FROM shop)),
sale AS (SELECT o.commerce_order_id, o.merchant_assignment_id, o.first_paid_at, l.product_category_code AS cat,
    l.discounted_item_amount AS amount FROM ord o JOIN line l USING (commerce_order_id) WHERE o.status <> 'cancelled')
"""
_RETURNS = """,
back AS (SELECT r.succeeded_at, r.commerce_order_id, l.product_category_code AS cat, a.allocated_item_amount AS amount
  FROM commerce_refund r JOIN refund_item_allocation a USING (commerce_refund_id) JOIN line l USING (commerce_order_item_id)
  WHERE r.status = 'succeeded' AND r.recorded_at <= @cutoff AND NOT r.is_test AND NOT a.is_test),
fee AS (SELECT o.merchant_assignment_id, f.succeeded_at, f.fee_amount AS amount FROM platform_fee_charge f JOIN ord o USING (commerce_order_id)
  WHERE f.status = 'succeeded' AND f.recorded_at <= @cutoff AND NOT f.is_test),
refund AS (SELECT o.merchant_assignment_id, o.first_paid_at, b.* FROM back b JOIN ord o USING (commerce_order_id))
"""


def _by_merchant(source: str, ts: str, a: str, b: str, name: str = "") -> str:
    where = f"{ts} >= @{a} AND {ts} < @{b}"
    return f"(SELECT merchant_assignment_id AS k, SUM(amount) AS v FROM {source} WHERE {where} GROUP BY 1) {name}"


_SEEN_SPEND = """
seen AS (SELECT s.marketing_campaign_id, s.business_date, arg_max(s.spend_amount, s.version_number) AS amount
  FROM campaign_daily_spend s WHERE NOT s.is_test AND s.recorded_at <= @cutoff GROUP BY ALL),
cost AS (SELECT g.business_scope, h.channel_code, g.organization_id, g.merchant_assignment_id, seen.business_date, seen.amount
  FROM seen JOIN marketing_campaign g USING (marketing_campaign_id)
  JOIN marketing_channel h ON h.marketing_channel_id = g.primary_channel_id WHERE NOT g.is_test AND NOT h.is_test)
"""
_NEWEST = """
newest AS (SELECT * FROM attributed_conversion WHERE NOT is_test AND source_data_cutoff_at <= @cutoff AND recorded_at <= @cutoff
  QUALIFY ROW_NUMBER() OVER (PARTITION BY conversion_type, COALESCE(invoice_payment_attempt_id, commerce_order_id, platform_fee_charge_id)
    ORDER BY source_data_cutoff_at DESC, recorded_at DESC, attributed_conversion_id DESC) = 1),
goodpay AS (SELECT p.* FROM invoice_payment_attempt p JOIN subscription_invoice i USING (subscription_invoice_id)
  JOIN subscription s USING (subscription_id) WHERE p.status = 'succeeded' AND NOT (p.is_test OR i.is_test OR s.is_test)),
coded AS (SELECT n.*, COALESCE(h.channel_code, 'unknown_unattributed') AS code, COALESCE(h.is_test, FALSE) AS channel_test
  FROM newest n LEFT JOIN marketing_channel h USING (marketing_channel_id))
"""
_SHOPS = """
shop AS (SELECT m.* FROM merchant m JOIN organization o ON o.organization_id = m.organization_id
  WHERE NOT m.is_test AND NOT o.is_test)
"""


def _cac(name: str, cost: str, customers: str) -> str:
    return f"""
SELECT channel_code, {_m('spend')} AS spend_amount, COALESCE(n, 0) AS new_customers,
  CASE WHEN COALESCE(spend, 0) = 0 OR COALESCE(n, 0) = 0 THEN NULL ELSE {ratio('spend', 'n')} END AS {name}
FROM (SELECT channel_code, SUM(amount) AS spend FROM cost WHERE business_date >= DATE '1997-04-01' AND business_date < DATE '1997-07-01' AND {cost} GROUP BY 1) s
FULL JOIN ({customers}) c USING (channel_code) ORDER BY channel_code"""


def _activation(a: str, b: str) -> str:
    return f"""
member AS (SELECT organization_id, registered_at, registered_at + INTERVAL 14 DAY AS until_at,
    registered_at + INTERVAL 14 DAY <= @jul AS mature FROM organization
  WHERE NOT is_test AND recorded_at <= @cutoff AND registered_at >= @{a} AND registered_at < @{b}),
signal AS (
  SELECT organization_id, 1 AS cond, first_invited_at AS ats FROM organization_member WHERE NOT is_test AND recorded_at <= @cutoff
  UNION ALL SELECT organization_id, 2, created_at FROM marketing_campaign WHERE NOT is_test AND recorded_at <= @cutoff
  UNION ALL SELECT m.organization_id, 3, o.completed_at FROM commerce_order o JOIN merchant m USING (merchant_assignment_id)
    JOIN consumer c USING (consumer_id)
    WHERE o.status = 'completed' AND o.recorded_at <= @cutoff AND NOT (o.is_test OR m.is_test OR c.is_test)),
scored AS (SELECT m.*, (SELECT COUNT(DISTINCT s.cond) FROM signal s WHERE s.organization_id = m.organization_id
    AND s.ats >= m.registered_at AND s.ats < m.until_at AND s.ats < @jul) AS met FROM member m)"""


_ACT_COLS = f"""CAST(SUM(CASE WHEN mature THEN 1 ELSE 0 END) AS BIGINT) AS mature_organization_count,
  CAST(SUM(CASE WHEN mature AND met >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS activated_organization_count,
  CAST(SUM(CASE WHEN mature THEN 0 ELSE 1 END) AS BIGINT) AS pending_organization_count,
  {ratio('COUNT(*) FILTER (mature AND met >= 2)', 'COUNT(*) FILTER (mature)')} AS activation_rate"""

METRICS: dict[str, str] = {
    "mrr_by_plan_asof": query(_SUBS, f"""
SELECT plan_name, {_m('SUM(mrr)')} AS mrr, {_m('SUM(mrr) * 12')} AS arr FROM (
  SELECT plan_name, normalized_mrr_after AS mrr FROM alive JOIN plan ON plan_id = plan_version_after_id WHERE as_of = @jul
  UNION ALL SELECT 'TOTAL', normalized_mrr_after FROM alive JOIN plan ON plan_id = plan_version_after_id WHERE as_of = @jul
  UNION ALL SELECT 'TOTAL', 0) GROUP BY 1 ORDER BY plan_name = 'TOTAL', plan_name""", ctes=_EVENTS),
    "paid_revenue_by_period": query(_PAY, f"""
SELECT report_month, {_m('(SELECT SUM(amount) FROM paid WHERE succeeded_at >= a AND succeeded_at < b)')} AS saas_revenue
FROM {months(4, 6)} ORDER BY 1""", ctes=_PAID),
    "churned_mrr_by_period": query(_SUBS, f"""
SELECT report_month, {_m("(SELECT SUM(normalized_mrr_before) FROM ev JOIN plan ON plan_id = plan_version_before_id WHERE event_type = 'cancellation_effective' AND effective_at >= a AND effective_at < b)")} AS churned_mrr
FROM {months(4, 6)} ORDER BY 1""", ctes=_EVENTS),
    "mrr_snapshot_trend": query(_SUBS, f"""
SELECT report_month, plan_name, CAST(SUM(normalized_mrr_after) AS {_MONEY}) AS mrr, CAST(SUM(normalized_mrr_after) * 12 AS {_MONEY}) AS arr
FROM {months(1, 6)} JOIN alive ON as_of = b JOIN plan ON plan_id = plan_version_after_id GROUP BY 1, 2 ORDER BY 1, 2""", ctes=_EVENTS),
    "mrr_bridge": query(_SUBS, f"""
SELECT report_month,
  {_m('(SELECT SUM(normalized_mrr_after) FROM alive WHERE as_of = a)')} AS opening_mrr,
  {_m("SUM(normalized_mrr_after) FILTER (event_type = 'first_activation')")} AS new_mrr,
  {_m("SUM(normalized_mrr_after - normalized_mrr_before) FILTER (event_type = 'expansion')")} AS expansion_mrr,
  {_m("SUM(normalized_mrr_before - normalized_mrr_after) FILTER (event_type = 'contraction')")} AS contraction_mrr,
  {_m("SUM(normalized_mrr_before) FILTER (event_type = 'cancellation_effective')")} AS churned_mrr,
  {_m('(SELECT SUM(normalized_mrr_after) FROM alive WHERE as_of = b)')} AS closing_mrr
FROM {months(5, 6)} LEFT JOIN ev ON effective_at >= a AND effective_at < b GROUP BY report_month, a, b ORDER BY 1""", ctes=_EVENTS),
    "churn_rates_by_plan": query(_SUBS, _churn("plan_name", "span = 'q2'", "plan_name"), ctes=_EVENTS + "," + _CHURN),
    "enterprise_churn_compare": query(_SUBS, _churn("span", "span <> 'q2' AND tier_code = 'enterprise'", "comparison_period"), ctes=_EVENTS + "," + _CHURN),
    "revenue_vs_mrr": query([*_SUBS, *_PAY], f"""
SELECT report_month, {_m('(SELECT SUM(amount) FROM paid WHERE succeeded_at >= a AND succeeded_at < b)')} AS saas_revenue,
  {_m('(SELECT SUM(normalized_mrr_after) FROM alive WHERE as_of = b)')} AS month_end_mrr
FROM {months(4, 6)} ORDER BY 1""", ctes=_EVENTS + "," + _PAID),
    "gmv_orders_aov": query(_SHOP, f"""
, n AS (SELECT COUNT(DISTINCT commerce_order_id) AS n FROM ord WHERE status <> 'cancelled' AND first_paid_at >= @jun AND first_paid_at < @jul),
g AS (SELECT {_m('SUM(amount)')} AS g FROM sale WHERE first_paid_at >= @jun AND first_paid_at < @jul)
SELECT g AS gmv, n AS order_count, {ratio('g', 'n')} AS aov FROM n, g""", ctes=_CLEAN),
    "refund_rate_with_prior_month": query([*_SHOP, *_BACK, "platform_fee_charge"], f"""
, r AS (SELECT {_m('SUM(amount)')} AS r, {_m('SUM(amount) FILTER (first_paid_at >= @may AND first_paid_at < @jun)')} AS prior
  FROM refund WHERE succeeded_at >= @jun AND succeeded_at < @jul),
g AS (SELECT {_m('SUM(amount)')} AS g FROM sale WHERE first_paid_at >= @jun AND first_paid_at < @jul)
SELECT r AS refund_amount, g AS gmv, {ratio('r', 'g')} AS refund_rate, prior AS prior_month_order_refund_amount FROM r, g""", ctes=_CLEAN + _RETURNS),
    "net_sales_by_seller": query([*_SHOP, *_BACK, "platform_fee_charge"], f"""
SELECT merchant_id, merchant_name, {_m('g.v')} AS gmv, {_m('r.v')} AS refund_amount, CAST({_m('g.v')} - {_m('r.v')} AS {_MONEY}) AS merchant_net_sales
FROM shop LEFT JOIN {_by_merchant('sale', 'first_paid_at', 'jun', 'jul', 'g')} ON g.k = merchant_assignment_id
LEFT JOIN (SELECT o.merchant_assignment_id AS k, SUM(b.amount) AS v FROM back b JOIN anyord o USING (commerce_order_id)
  WHERE b.succeeded_at >= @jun AND b.succeeded_at < @jul GROUP BY 1) r ON r.k = merchant_assignment_id
WHERE g.v IS NOT NULL OR r.v IS NOT NULL ORDER BY merchant_id""", ctes=_CLEAN + _RETURNS),
    "gmv_trend": query(_SHOP, f"""
SELECT report_month, {_m('SUM(amount)')} AS gmv, COUNT(DISTINCT commerce_order_id) AS order_count,
  {ratio('SUM(amount)', 'COUNT(DISTINCT commerce_order_id)')} AS aov
FROM {months(1, 6)} LEFT JOIN sale ON first_paid_at >= a AND first_paid_at < b GROUP BY 1 ORDER BY 1""", ctes=_CLEAN),
    "seller_scorecard": query([*_SHOP, *_BACK, "platform_fee_charge"], f"""
SELECT merchant_id, merchant_name, {_m('g.v')} AS gmv, {_m('r.v')} AS refund_amount, CAST({_m('g.v')} - {_m('r.v')} AS {_MONEY}) AS merchant_net_sales,
  {_m('f.v')} AS platform_transaction_revenue
FROM shop LEFT JOIN {_by_merchant('sale', 'first_paid_at', 'apr', 'jul', 'g')} ON g.k = merchant_assignment_id
LEFT JOIN {_by_merchant('refund', 'succeeded_at', 'apr', 'jul', 'r')} ON r.k = merchant_assignment_id
LEFT JOIN {_by_merchant('fee', 'succeeded_at', 'apr', 'jul', 'f')} ON f.k = merchant_assignment_id
WHERE COALESCE(g.v, r.v, f.v) IS NOT NULL ORDER BY merchant_id""", ctes=_CLEAN + _RETURNS),
    "refund_rate_period_category": query([*_SHOP, *_BACK, "platform_fee_charge"], f"""
SELECT report_month, c.cat AS category_code, {_m('g.v')} AS gmv, {_m('r.v')} AS refund_amount, {ratio(_m('r.v'), 'g.v')} AS refund_rate
FROM {months(4, 6)} CROSS JOIN (SELECT DISTINCT product_category_code AS cat FROM commerce_order_item WHERE NOT is_test) c
LEFT JOIN (SELECT report_month, cat, SUM(amount) AS v FROM {months(4, 6)} JOIN sale ON first_paid_at >= a AND first_paid_at < b GROUP BY ALL) g USING (report_month, cat)
LEFT JOIN (SELECT report_month, cat, SUM(amount) AS v FROM {months(4, 6)} JOIN refund ON succeeded_at >= a AND succeeded_at < b GROUP BY ALL) r USING (report_month, cat)
ORDER BY 1, 2""", ctes=_CLEAN + _RETURNS),
    "seller_growth_pivot": query([*_SHOP, *_BACK, "platform_fee_charge"], f"""
, wide AS (SELECT merchant_id, merchant_name, {_m('SUM(g1.v)')} AS g1, {_m('SUM(g2.v)')} AS g2, {_m('SUM(r1.v)')} AS r1, {_m('SUM(r2.v)')} AS r2,
    {_m('SUM(f1.v)')} AS f1, {_m('SUM(f2.v)')} AS f2 FROM shop s
  {' '.join(f"LEFT JOIN {_by_merchant(src, ts, a, b, n)} ON {n}.k = s.merchant_assignment_id" for src, ts, c in [('sale', 'first_paid_at', 'g'), ('refund', 'succeeded_at', 'r'), ('fee', 'succeeded_at', 'f')] for n, a, b in [(c + '1', 'jan', 'apr'), (c + '2', 'apr', 'jul')])}
  GROUP BY 1, 2)
SELECT merchant_id, merchant_name, g1 AS q1_gmv, g2 AS q2_gmv, CAST(g2 - g1 AS {_MONEY}) AS gmv_change,
  CAST(g1 - r1 AS {_MONEY}) AS q1_merchant_net_sales, CAST(g2 - r2 AS {_MONEY}) AS q2_merchant_net_sales,
  CAST(g2 - r2 - g1 + r1 AS {_MONEY}) AS merchant_net_sales_change, f1 AS q1_platform_revenue, f2 AS q2_platform_revenue,
  CAST(f2 - f1 AS {_MONEY}) AS platform_revenue_change
FROM wide WHERE g1 <> 0 OR g2 <> 0 ORDER BY gmv_change DESC, merchant_id""", ctes=_CLEAN + _RETURNS),
    "cac_by_channel_saas": query([*_SPEND, *_PAY], _cac(
        "saas_cac", "business_scope = 'saas' AND organization_id IN (SELECT organization_id FROM organization WHERE NOT is_test)",
        """SELECT code AS channel_code, COUNT(DISTINCT organization_id) AS n FROM coded WHERE conversion_type = 'saas_first_payment'
  AND NOT channel_test AND conversion_at >= @apr AND conversion_at < @jul
  AND invoice_payment_attempt_id IN (SELECT invoice_payment_attempt_id FROM goodpay)
  AND organization_id IN (SELECT organization_id FROM organization WHERE NOT is_test) GROUP BY 1"""),
        attribution=True, ctes=_SEEN_SPEND + "," + _NEWEST),
    "cac_by_channel_commerce": query([*_SPEND, "merchant", "organization", "consumer"], _cac(
        "commerce_cac", "business_scope = 'commerce' AND merchant_assignment_id IN (SELECT merchant_assignment_id FROM shop)",
        """SELECT code AS channel_code, COUNT(DISTINCT c.consumer_id) AS n FROM coded c
  JOIN commerce_order o USING (commerce_order_id) JOIN consumer u ON u.consumer_id = c.consumer_id
  WHERE conversion_type = 'commerce_first_payment' AND NOT channel_test AND conversion_at >= @apr AND conversion_at < @jul
  AND o.status = 'completed' AND NOT o.is_test AND NOT u.is_test AND o.merchant_assignment_id IN (SELECT merchant_assignment_id FROM shop) GROUP BY 1"""),
        attribution=True, ctes=_SEEN_SPEND + "," + _NEWEST + "," + _SHOPS),
    "attributed_revenue_share": query(["merchant"], f"""
, base AS (SELECT 'saas' AS s, code, attribution_result AS res, p.subscription_fee_amount AS amount FROM coded
    JOIN goodpay p USING (invoice_payment_attempt_id) JOIN organization o ON o.organization_id = coded.organization_id
    WHERE conversion_type = 'saas_revenue' AND NOT channel_test AND conversion_at >= @jun AND conversion_at < @jul AND NOT o.is_test
  UNION ALL SELECT 'commerce', code, attribution_result, f.fee_amount FROM coded
    JOIN platform_fee_charge f USING (platform_fee_charge_id) JOIN commerce_order o ON o.commerce_order_id = f.commerce_order_id
    JOIN consumer u ON u.consumer_id = coded.consumer_id
    WHERE conversion_type = 'commerce_revenue' AND NOT channel_test AND conversion_at >= @jun AND conversion_at < @jul
      AND f.status = 'succeeded' AND NOT (f.is_test OR o.is_test OR u.is_test)
      AND o.merchant_assignment_id IN (SELECT merchant_assignment_id FROM shop)),
padded AS (SELECT * FROM base UNION ALL SELECT s, c, c, 0 FROM (VALUES ('saas'), ('commerce')) x(s), (VALUES ('direct'), ('unknown_unattributed')) y(c)),
g AS (SELECT s, code, res, {_m('SUM(amount)')} AS v, SUM(SUM(amount)) OVER (PARTITION BY s) AS whole FROM padded GROUP BY 1, 2, 3)
SELECT s AS business_scope, code AS channel_code, res AS attribution_result, v AS attributed_revenue, {ratio('v', 'whole')} AS revenue_share
FROM g ORDER BY 1, 3, 2""", attribution=True, ctes=_NEWEST + "," + _SHOPS),
    "touch_to_payment_funnel": query(["merchant"], """
, hit AS (SELECT CASE WHEN t.organization_id IS NULL THEN 'commerce' ELSE 'saas' END AS s, COALESCE(t.organization_id, t.consumer_id) AS k, t.occurred_at
  FROM marketing_touch t JOIN marketing_channel h USING (marketing_channel_id)
  WHERE t.occurred_at >= @apr AND t.occurred_at < @jul AND t.quality_status = 'accepted' AND t.processed_at <= @cutoff AND t.recorded_at <= @cutoff
    AND NOT t.is_test AND NOT h.is_test AND h.effective_from <= t.occurred_at AND COALESCE(t.occurred_at < h.effective_to, TRUE)
    AND NOT EXISTS (SELECT 1 FROM marketing_campaign g WHERE g.is_test AND g.marketing_campaign_id = t.marketing_campaign_id)
    AND NOT EXISTS (SELECT 1 FROM organization o WHERE o.is_test AND o.organization_id = t.organization_id)
    AND NOT EXISTS (SELECT 1 FROM consumer u WHERE u.is_test AND u.consumer_id = t.consumer_id)),
pay AS (SELECT 'saas' AS s, n.organization_id AS k, conversion_at AS ats FROM newest n JOIN goodpay USING (invoice_payment_attempt_id)
    JOIN organization o ON o.organization_id = n.organization_id WHERE conversion_type = 'saas_first_payment' AND NOT o.is_test
  UNION ALL SELECT 'commerce', n.consumer_id, conversion_at FROM newest n JOIN commerce_order o ON o.commerce_order_id = n.commerce_order_id
    JOIN consumer u ON u.consumer_id = n.consumer_id
    WHERE conversion_type = 'commerce_first_payment' AND o.status = 'completed' AND NOT o.is_test AND NOT u.is_test
      AND o.merchant_assignment_id IN (SELECT merchant_assignment_id FROM shop))
SELECT h.s AS business_scope, COUNT(DISTINCT h.k) AS touched_subject_count,
  COUNT(DISTINCT p.k) AS first_payment_subject_count
FROM hit h LEFT JOIN pay p ON p.s = h.s AND p.k = h.k AND h.occurred_at <= p.ats AND p.ats >= @apr AND p.ats < @jul
GROUP BY 1 ORDER BY 1""", attribution=True, ctes=_NEWEST + "," + _SHOPS),
    "spend_up_customers_down": query(_SPEND, f"""
, s AS (SELECT business_scope, channel_code, {_m("SUM(amount) FILTER (business_date < DATE '1997-06-01')")} AS m, {_m("SUM(amount) FILTER (business_date >= DATE '1997-06-01')")} AS j
  FROM cost WHERE business_date >= DATE '1997-05-01' AND business_date < DATE '1997-07-01' GROUP BY 1, 2),
c AS (SELECT CASE WHEN organization_id IS NULL THEN 'commerce' ELSE 'saas' END AS business_scope, code AS channel_code,
    COUNT(DISTINCT COALESCE(organization_id, consumer_id)) FILTER (conversion_at < @jun) AS m,
    COUNT(DISTINCT COALESCE(organization_id, consumer_id)) FILTER (conversion_at >= @jun) AS j
  FROM coded WHERE conversion_type LIKE '%_first_payment' AND conversion_at >= @may AND conversion_at < @jul GROUP BY 1, 2)
SELECT business_scope, channel_code, {_m('s.m')} AS may_spend, {_m('s.j')} AS jun_spend, COALESCE(c.m, 0) AS may_customers, COALESCE(c.j, 0) AS jun_customers,
  CASE WHEN {_m('s.j')} > {_m('s.m')} AND COALESCE(c.j, 0) < COALESCE(c.m, 0) THEN 'yes' ELSE 'no' END AS spend_up_customers_down
FROM s FULL JOIN c USING (business_scope, channel_code) ORDER BY 1, 2""", attribution=True, ctes=_SEEN_SPEND + "," + _NEWEST),
    "attribution_boundary_cases": query([], """
, v AS (SELECT a.*, COALESCE(invoice_payment_attempt_id, a.commerce_order_id, platform_fee_charge_id) AS fact, h.channel_code, h.status AS channel_status,
    COUNT(*) OVER w AS revisions, ROW_NUMBER() OVER (w ORDER BY source_data_cutoff_at DESC, a.recorded_at DESC, attributed_conversion_id DESC) AS newest_rank
  FROM attributed_conversion a LEFT JOIN marketing_channel h USING (marketing_channel_id)
  WHERE NOT a.is_test AND source_data_cutoff_at <= @cutoff AND a.recorded_at <= @cutoff AND conversion_at >= @apr AND conversion_at < @jul
  WINDOW w AS (PARTITION BY conversion_type, COALESCE(invoice_payment_attempt_id, a.commerce_order_id, platform_fee_charge_id))),
b AS (SELECT CASE WHEN v.organization_id IS NULL THEN 'commerce' ELSE 'saas' END AS business_scope, conversion_type,
    COALESCE(external_payment_attempt_id, external_order_id, external_fee_charge_id) AS authoritative_external_id, conversion_at,
    CASE WHEN NOT history_complete THEN 'history_incomplete_unknown' WHEN revisions > 1 THEN 'late_arriving_re_attribution'
      WHEN window_started_at = @history THEN 'history_coverage_equality'
      WHEN attribution_result = 'non_direct' AND channel_status = 'inactive' THEN 'inactive_historical_channel_selected'
      WHEN attribution_result = 'direct' THEN 'direct_no_eligible_touch' ELSE 'other' END AS boundary_case,
    attribution_result, reason_code AS attribution_reason_code, t.source_event_id AS selected_touch_source_event_id,
    channel_code AS selected_channel_code, channel_status AS selected_channel_current_status, g.external_campaign_id AS selected_campaign_external_id,
    source_data_cutoff_at, CAST(newest_rank = 1 AS INTEGER) AS is_latest_revision
  FROM v LEFT JOIN invoice_payment_attempt p ON p.invoice_payment_attempt_id = v.invoice_payment_attempt_id
  LEFT JOIN commerce_order o ON o.commerce_order_id = v.commerce_order_id
  LEFT JOIN platform_fee_charge f ON f.platform_fee_charge_id = v.platform_fee_charge_id
  LEFT JOIN marketing_touch t ON t.marketing_touch_id = v.selected_marketing_touch_id
  LEFT JOIN marketing_campaign g ON g.marketing_campaign_id = v.marketing_campaign_id)
SELECT * FROM b WHERE boundary_case <> 'other'
QUALIFY boundary_case = 'late_arriving_re_attribution' OR ROW_NUMBER() OVER (PARTITION BY boundary_case, business_scope
  ORDER BY conversion_type, authoritative_external_id, source_data_cutoff_at) = 1
ORDER BY boundary_case, business_scope, conversion_type, authoritative_external_id, source_data_cutoff_at""", attribution=True),
    "activation_rate": query(_ACT, f"SELECT {_ACT_COLS} FROM scored", ctes=_activation("apr", "jul")),
    "activation_stages": query(_ACT, f"""
SELECT stage AS condition_stage, COUNT(organization_id) AS organization_count,
  {ratio('COUNT(organization_id)', '(SELECT COUNT(*) FROM scored WHERE mature)')} AS cohort_share
FROM (VALUES (0), (1), (2)) x(stage) LEFT JOIN scored ON mature AND LEAST(met, 2) = stage GROUP BY 1 ORDER BY 1""", ctes=_activation("apr", "jul")),
    "activation_by_cohort": query(_ACT, f"""
SELECT CASE WHEN registered_at < @jun THEN '1997-05' ELSE '1997-06' END AS cohort_month, COUNT(*) AS registered_organization_count, {_ACT_COLS}
FROM scored GROUP BY 1 ORDER BY 1""", ctes=_activation("may", "jul")),
    "activation_by_channel": query(_ACT, f"""
SELECT code AS channel_code, COUNT(DISTINCT c.organization_id) AS new_paying_organization_count, COUNT(DISTINCT c.organization_id) AS mature_organization_count,
  COUNT(DISTINCT c.organization_id) FILTER (met >= 2) AS activated_organization_count,
  {ratio('COUNT(DISTINCT c.organization_id) FILTER (met >= 2)', 'COUNT(DISTINCT c.organization_id)')} AS activation_rate
FROM coded c JOIN goodpay USING (invoice_payment_attempt_id) JOIN scored ON scored.organization_id = c.organization_id AND mature
WHERE conversion_type = 'saas_first_payment' AND conversion_at >= @apr AND conversion_at < @jul GROUP BY 1 ORDER BY 1""",
        attribution=True, ctes=_NEWEST + "," + _activation("apr", "jul")),
    "revenue_streams_by_period": query([*_PAY, "platform_fee_charge", "commerce_order", "merchant"], f"""
, streams AS (SELECT 's' AS k, succeeded_at AS ats, amount FROM paid
  UNION ALL SELECT 'c', f.succeeded_at, f.fee_amount FROM platform_fee_charge f JOIN commerce_order o USING (commerce_order_id)
  WHERE f.status = 'succeeded' AND NOT f.is_test AND f.recorded_at <= @cutoff AND NOT o.is_test
    AND o.merchant_assignment_id IN (SELECT merchant_assignment_id FROM shop))
SELECT report_month, {_m("SUM(amount) FILTER (k = 's')")} AS saas_revenue, {_m("SUM(amount) FILTER (k = 'c')")} AS commerce_revenue
FROM {months(4, 6)} LEFT JOIN streams ON ats >= a AND ats < b GROUP BY 1 ORDER BY 1""", ctes=_PAID + "," + _SHOPS),
    "seller_roas": query([*_SPEND, "merchant"], f"""
, s AS (SELECT merchant_assignment_id AS k, SUM(amount) AS v FROM cost WHERE business_scope = 'commerce' AND business_date >= DATE '1997-04-01' AND business_date < DATE '1997-07-01' GROUP BY 1),
r AS (SELECT o.merchant_assignment_id AS k,
    SUM(fee_amount) FILTER (attribution_result = 'non_direct' AND marketing_campaign_id IS NOT NULL) AS n,
    SUM(fee_amount) FILTER (attribution_result = 'direct') AS d, SUM(fee_amount) FILTER (attribution_result = 'unknown_unattributed') AS u
  FROM newest JOIN platform_fee_charge f USING (platform_fee_charge_id) JOIN commerce_order o ON o.commerce_order_id = f.commerce_order_id
  JOIN consumer c ON c.consumer_id = o.consumer_id
  WHERE conversion_type = 'commerce_revenue' AND conversion_at >= @apr AND conversion_at < @jul AND f.status = 'succeeded' AND NOT (f.is_test OR o.is_test OR c.is_test) GROUP BY 1)
SELECT merchant_id, merchant_name, {_m('s.v')} AS marketing_spend, {_m('n')} AS attributed_commerce_revenue, {_m('d')} AS direct_commerce_revenue,
  {_m('u')} AS unknown_commerce_revenue, {ratio(_m('n'), _m('s.v'))} AS commerce_attributed_roas
FROM s FULL JOIN r USING (k) JOIN shop ON shop.merchant_assignment_id = k ORDER BY merchant_id""", attribution=True, ctes=_SEEN_SPEND + "," + _NEWEST + "," + _SHOPS),
    "seller_growth_quality": query([*_SHOP, *_BACK, *_SPEND, "platform_fee_charge"], f"""
, mk AS (SELECT merchant_assignment_id, CAST(business_date AS TIMESTAMP) AS ats, amount FROM cost WHERE business_scope = 'commerce'),
wide AS (SELECT merchant_id, merchant_name, {_m('SUM(g1.v)')} AS g1, {_m('SUM(g2.v)')} AS g2, {_m('SUM(r1.v)')} AS r1, {_m('SUM(r2.v)')} AS r2,
    {_m('SUM(f1.v)')} AS f1, {_m('SUM(f2.v)')} AS f2 FROM shop s
  {' '.join(f"LEFT JOIN {_by_merchant(src, ts, a, b, n)} ON {n}.k = s.merchant_assignment_id" for src, ts, c in [('sale', 'first_paid_at', 'g'), ('refund', 'succeeded_at', 'r')] for n, a, b in [(c + '1', 'jan', 'apr'), (c + '2', 'apr', 'jul')])}
  LEFT JOIN (SELECT merchant_assignment_id AS k, SUM(amount) AS v FROM mk WHERE ats >= TIMESTAMP '1997-01-01' AND ats < TIMESTAMP '1997-04-01' GROUP BY 1) f1 ON f1.k = s.merchant_assignment_id
  LEFT JOIN (SELECT merchant_assignment_id AS k, SUM(amount) AS v FROM mk WHERE ats >= TIMESTAMP '1997-04-01' AND ats < TIMESTAMP '1997-07-01' GROUP BY 1) f2 ON f2.k = s.merchant_assignment_id
  GROUP BY 1, 2)
SELECT merchant_id, merchant_name, g1 AS q1_gmv, g2 AS q2_gmv, CAST(g2 - g1 AS {_MONEY}) AS gmv_change, r1 AS q1_refund_amount, r2 AS q2_refund_amount,
  CAST(r2 - r1 AS {_MONEY}) AS refund_change, f1 AS q1_marketing_spend, f2 AS q2_marketing_spend, CAST(f2 - f1 AS {_MONEY}) AS marketing_spend_change,
  CASE WHEN g2 > g1 AND r2 > r1 AND f2 > f1 THEN 'yes' ELSE 'no' END AS all_three_increased
FROM wide WHERE g1 <> 0 OR g2 <> 0 OR f1 <> 0 OR f2 <> 0 ORDER BY gmv_change DESC, merchant_id""", ctes=_CLEAN + _RETURNS + "," + _SEEN_SPEND),
}
