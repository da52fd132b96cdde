"""Every registered query by name, run over the derived business model."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from tallyhouse.functions.calendar import Params, half_year_params
from tallyhouse.operators.attribution import ALL_TYPES, attribute
from tallyhouse.plans import activation, commerce, crossdomain, marketing, saas, shapes
from tallyhouse.schemas import SCHEMAS
from tallyhouse.session import shared_dir, tune
from tallyhouse.sources.derived import derived_tables
from tallyhouse.sources.tables import Tables

REPORT = half_year_params(1997)

Query = Callable[[SparkSession, str], DataFrame]
Plan = Callable[[Tables, Params], DataFrame]

PLANS: dict[str, Plan] = {
    plan.__name__: plan
    for plan in [
        saas.mrr_by_plan_asof, saas.paid_revenue_by_period, saas.churned_mrr_by_period, saas.mrr_snapshot_trend,
        saas.mrr_bridge, saas.churn_rates_by_plan, saas.revenue_vs_mrr, saas.enterprise_churn_compare,
        commerce.gmv_orders_aov, commerce.refund_rate_with_prior_month, commerce.net_sales_by_seller,
        commerce.gmv_trend, commerce.seller_scorecard, commerce.refund_rate_period_category,
        commerce.seller_growth_pivot, activation.activation_rate, activation.activation_stages,
        activation.activation_by_cohort, crossdomain.revenue_streams_by_period, crossdomain.seller_growth_quality,
    ]
}

# plans over materialised attribution
ATTRIBUTED_PLANS: dict[str, Plan] = {
    plan.__name__: plan
    for plan in [
        marketing.cac_by_channel_saas, marketing.cac_by_channel_commerce, marketing.attributed_revenue_share,
        marketing.touch_to_payment_funnel, marketing.spend_up_customers_down, marketing.attribution_boundary_cases,
        activation.activation_by_channel, crossdomain.seller_roas,
    ]
}


def attributed(t: Tables, types: tuple[str, ...] = ALL_TYPES) -> DataFrame:
    return attribute(t, [shapes.EARLY_CUTOFF, REPORT.snapshot_cutoff], REPORT.history_start, types)


# per (application, input): the planned tables, and the folder of the written attribution table
_PLANNED: dict[tuple[str, str], Tables] = {}
_ATTRIBUTION: dict[tuple[str, str], str] = {}


def plain_tables(spark: SparkSession, sf_dir: str) -> Tables:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANNED:
        _PLANNED[key] = derived_tables(spark, sf_dir)
    return _PLANNED[key]


def attributed_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived tables plus the written attribution results, prunable by conversion type.

    The attribution job runs once per application and input; metrics only read its table.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    t = plain_tables(spark, sf_dir)
    if key not in _ATTRIBUTION:
        folder = f"{shared_dir(spark)}/attribution-{uuid4().hex}"
        attributed(t).write.partitionBy("conversion_type").parquet(folder)
        _ATTRIBUTION[key] = folder
    results = spark.read.schema(SCHEMAS["attributed_conversion"]).parquet(_ATTRIBUTION[key])
    return t.replacing(attributed_conversion=results)


def _plan_query(plan: Plan) -> Query:
    return lambda spark, sf_dir: plan(plain_tables(tune(spark), sf_dir), REPORT)


def _attributed_query(plan: Plan) -> Query:
    return lambda spark, sf_dir: plan(attributed_tables(tune(spark), sf_dir), REPORT)


def queries() -> dict[str, Query]:
    found = {name: _plan_query(plan) for name, plan in PLANS.items()}
    found |= {plan.__name__: _plan_query(plan) for plan in shapes.PLAIN}
    found |= {name: _plan_query(plan) for name, plan in shapes.PLAIN_RULES.items()}
    found |= {name: _attributed_query(plan) for name, plan in (ATTRIBUTED_PLANS | shapes.ATTRIBUTED).items()}
    return found
