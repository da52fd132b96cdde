"""DuckDB texts: the derived entities and the attribution result as CTEs."""

from __future__ import annotations

from tallyhouse.sources.derived import DEFINITIONS, DRIVER_TABLES

# Written out by hand, so that the calendar helper is checked too: local midnights in Los Angeles
# as UTC. Daylight saving started on 6 April 1997.
INSTANTS = {
    "jan": "1997-01-01 08:00:00", "feb": "1997-02-01 08:00:00", "mar": "1997-03-01 08:00:00",
    "apr": "1997-04-01 08:00:00", "may": "1997-05-01 07:00:00", "jun": "1997-06-01 07:00:00",
    "jul": "1997-07-01 07:00:00", "cutoff": "1997-07-15 07:00:00", "history": "1997-04-08 07:00:00",
    "early": "1997-05-15 07:00:00",
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul"]


def bind(sql: str) -> str:
    """@name is an instant."""
    for name, value in INSTANTS.items():
        sql = sql.replace(f"@{name}", f"TIMESTAMP '{value}'")
    return sql


def entity(name: str) -> str:
    return DEFINITIONS[name].format(**{t: t for t in DRIVER_TABLES})


def months(first: int, last: int) -> str:
    """Rows (report_month, a, b) of half-open months as a subquery."""
    rows = [f"('1997-{m:02d}', @{MONTHS[m - 1]}, @{MONTHS[m]})" for m in range(first, last + 1)]
    return f"(VALUES {', '.join(rows)}) AS p(report_month, a, b)"


def ratio(numerator: str, denominator: str) -> str:
    """Exact half-up quotient of two non-negative values with at most four digits."""
    n, d = (f"CAST(CAST({x} AS DECIMAL(30,4)) * 10000 AS HUGEINT)" for x in (numerator, denominator))
    return (
        f"CASE WHEN {d} = 0 OR {numerator} IS NULL THEN NULL ELSE "
        f"CAST(CAST(({n} * 20000 + {d}) // (2 * {d}) AS DECIMAL(30,0)) / 10000 AS DECIMAL(19,4)) END"
    )


ATTRIBUTION_ENTITIES = [
    "organization", "consumer", "invoice_payment_attempt", "subscription_invoice", "subscription", "commerce_order",
    "platform_fee_charge", "marketing_channel", "marketing_campaign", "marketing_touch",
]

# materialised, so that a filter on the result cannot turn the joins into something slower
_ATTRIBUTION = """
paid_fact AS (
  SELECT 'saas' AS scope, organization_id AS subject, invoice_payment_attempt_id AS pay, NULL::BIGINT AS ord,
    NULL::BIGINT AS fee, succeeded_at AS ats, pa.is_test AS fact_test
  FROM invoice_payment_attempt pa JOIN subscription_invoice USING (subscription_invoice_id)
  JOIN subscription USING (subscription_id) WHERE pa.status = 'succeeded'),
order_fact AS (
  SELECT 'commerce' AS scope, consumer_id AS subject, NULL::BIGINT AS pay, commerce_order_id AS ord,
    NULL::BIGINT AS fee, first_paid_at AS ats, is_test AS fact_test
  FROM commerce_order WHERE status = 'completed'),
fee_fact AS (
  SELECT 'commerce' AS scope, o.consumer_id AS subject, NULL::BIGINT AS pay, NULL::BIGINT AS ord,
    platform_fee_charge_id AS fee, succeeded_at AS ats, f.is_test AS fact_test
  FROM platform_fee_charge f JOIN commerce_order o USING (commerce_order_id) WHERE f.status = 'succeeded'),
fact AS MATERIALIZED (
  SELECT 'saas_revenue' AS kind, * FROM paid_fact
  UNION ALL (SELECT 'saas_first_payment', * FROM paid_fact
    QUALIFY ROW_NUMBER() OVER (PARTITION BY subject ORDER BY ats, CAST(pay AS VARCHAR)) = 1)
  UNION ALL SELECT 'attributed_gmv', * FROM order_fact
  UNION ALL (SELECT 'commerce_first_payment', * FROM order_fact
    QUALIFY ROW_NUMBER() OVER (PARTITION BY subject ORDER BY ats, CAST(ord AS VARCHAR)) = 1)
  UNION ALL SELECT 'commerce_revenue', * FROM fee_fact),
candidate AS MATERIALIZED (
  SELECT t.marketing_touch_id AS touch, t.source_event_id AS src, t.marketing_channel_id AS channel,
    t.marketing_campaign_id AS campaign, t.occurred_at, t.processed_at, t.recorded_at,
    CASE WHEN t.organization_id IS NULL THEN 'commerce' ELSE 'saas' END AS scope,
    COALESCE(t.organization_id, t.consumer_id) AS subject
  FROM marketing_touch t JOIN marketing_channel h USING (marketing_channel_id)
  LEFT JOIN marketing_campaign g USING (marketing_campaign_id)
  WHERE t.quality_status = 'accepted' AND t.touch_type = 'non_direct' AND NOT t.is_test
    AND NOT h.is_test AND h.channel_type <> 'direct' AND h.effective_from <= t.occurred_at
    AND COALESCE(t.occurred_at < h.effective_to, TRUE)
    AND (t.marketing_campaign_id IS NULL OR (NOT g.is_test AND g.primary_channel_id = t.marketing_channel_id
      AND g.business_scope = CASE WHEN t.organization_id IS NULL THEN 'commerce' ELSE 'saas' END
      AND (t.organization_id IS NULL OR g.organization_id = t.organization_id)))),
run AS MATERIALIZED (
  SELECT f.*, c.cutoff, f.ats - INTERVAL 168 HOUR AS win,
    f.fact_test OR COALESCE(o.is_test, u.is_test, FALSE) AS is_test
  FROM fact f JOIN {cutoffs}
  LEFT JOIN organization o ON f.scope = 'saas' AND o.organization_id = f.subject
  LEFT JOIN consumer u ON f.scope = 'commerce' AND u.consumer_id = f.subject),
won AS MATERIALIZED (
  SELECT r.kind, r.pay, r.ord, r.fee, r.cutoff, arg_max(k, (k.occurred_at, k.src)) AS k
  FROM run r JOIN candidate k ON k.scope = r.scope AND k.subject = r.subject
    AND k.occurred_at BETWEEN r.win AND r.ats AND k.processed_at <= r.cutoff AND k.recorded_at <= r.cutoff
  WHERE r.win >= @history GROUP BY ALL),
attributed_conversion AS MATERIALIZED (
  SELECT r.kind || ':' || COALESCE(r.pay, r.ord, r.fee) || ':' || strftime(r.cutoff, '%Y%m%d%H%M%S%f') AS attributed_conversion_id,
    r.kind AS conversion_type,
    CASE WHEN r.scope = 'saas' THEN r.subject END AS organization_id,
    CASE WHEN r.scope = 'commerce' THEN r.subject END AS consumer_id,
    r.pay AS invoice_payment_attempt_id, r.ord AS commerce_order_id, r.fee AS platform_fee_charge_id,
    w.k.touch AS selected_marketing_touch_id,
    CASE WHEN w.k IS NOT NULL THEN w.k.channel WHEN r.win >= @history THEN d.marketing_channel_id END AS marketing_channel_id,
    w.k.campaign AS marketing_campaign_id,
    CASE WHEN r.win < @history THEN 'unknown_unattributed' WHEN w.k IS NULL THEN 'direct' ELSE 'non_direct' END AS attribution_result,
    CASE WHEN r.win < @history THEN 'window_history_incomplete' WHEN w.k IS NULL THEN 'no_eligible_non_direct_touch'
         ELSE 'selected_last_non_direct' END AS reason_code,
    'last_non_direct_168h_v1' AS model_version, r.ats AS conversion_at, r.win AS window_started_at,
    r.win >= @history AS history_complete, r.cutoff AS source_data_cutoff_at, r.cutoff AS attributed_at,
    r.is_test, r.cutoff AS recorded_at
  FROM run r LEFT JOIN won w ON w.kind = r.kind AND w.cutoff = r.cutoff
    AND w.pay IS NOT DISTINCT FROM r.pay AND w.ord IS NOT DISTINCT FROM r.ord AND w.fee IS NOT DISTINCT FROM r.fee
  LEFT JOIN marketing_channel d ON d.channel_code = 'direct' AND NOT d.is_test)
"""


TWO_CUTOFFS = "(VALUES (@early), (@cutoff)) AS c(cutoff) ON f.ats <= c.cutoff"


def query(entities: list[str], sql: str, attribution: bool = False, ctes: str = "", cutoffs: str = TWO_CUTOFFS) -> str:
    """A statement over the named entities; extra CTEs may follow them."""
    names = list(dict.fromkeys(entities + (ATTRIBUTION_ENTITIES if attribution else [])))
    parts = [f"{name} AS ({entity(name)})" for name in names]
    if attribution:
        parts.append(_ATTRIBUTION.strip().replace("{cutoffs}", cutoffs))
    if ctes:
        parts.append(ctes.strip())
    return bind(f"WITH {', '.join(parts)} {sql}")
