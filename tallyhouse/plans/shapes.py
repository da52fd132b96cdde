"""Single operators run over whole tables of the business model.

Where an operator looks for faults, faults are planted by formula in the derived rows, so that
both outcomes occur.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import Params
from tallyhouse.functions.money import money, total
from tallyhouse.operators import business_rules, lifecycle, quality, suite
from tallyhouse.operators.attribution import ALL_TYPES, append_results, attribute, attribute_at, conversions, latest_results, reattribute
from tallyhouse.operators.blocks import (
    append_total,
    bounded,
    bucket_by_period,
    complete_rows,
    dense_by_period,
    earliest,
    key_union_join,
    net_by_instant,
    stack,
)
from tallyhouse.operators.compare import _cells as cells_of
from tallyhouse.operators.compare import cell_text, compare, decode, digest, response_gaps, suite_rollup
from tallyhouse.operators.versions import Store
from tallyhouse.plans.commerce import items, of_real_products, orders, real_merchants, refunded_items, sold_items
from tallyhouse.plans.marketing import visible_spend
from tallyhouse.plans.saas import snapshots, state_events
from tallyhouse.schemas import INSTANT, INT, LONG, MONEY, SCHEMAS, TEXT, primary_key
from tallyhouse.session import shared_dir
from tallyhouse.sources import nested, split_json

TablesMap = Mapping[str, DataFrame]
EARLY_CUTOFF = datetime(1997, 5, 15, 7)


def state_asof_multi(t: TablesMap, p: Params) -> DataFrame:
    """Every subscription's state before each month's end."""
    return snapshots(state_events(t, p), {m.label: m.end for m in p.months(1, 6)})


def latest_spend_revision(t: TablesMap, p: Params) -> DataFrame:
    return visible_spend(t, p, p.quarter_days(2)).select("marketing_campaign_id", "business_date", "spend_amount")


def attribution_last_touch(t: TablesMap, p: Params) -> DataFrame:
    """One run of the job at the snapshot cutoff."""
    return attribute(t, [p.snapshot_cutoff], p.history_start)


def attribution_two_cutoffs(t: TablesMap, p: Params) -> DataFrame:
    """A later run appended to the table an earlier run wrote."""
    stored = t["attributed_conversion"].filter(F.col("source_data_cutoff_at") < F.lit(str(p.snapshot_cutoff)).cast("timestamp_ntz"))
    return stored.unionByName(append_results(stored, attribute(t, [EARLY_CUTOFF, p.snapshot_cutoff], p.history_start)))


def attribution_own_cutoffs(t: TablesMap, p: Params) -> DataFrame:
    """Every conversion attributed at a cutoff of its own: one of fifty days, by its fact."""
    fact = F.col("fact_key").cast("bigint")
    start = F.lit(str(EARLY_CUTOFF)).cast("timestamp_ntz")
    asked = conversions(t).select("conversion_type", "fact_key", (
        start + F.make_dt_interval(days=(fact % 50).cast("int"), hours=(fact % 7).cast("int"))).alias("source_data_cutoff_at"))
    return attribute_at(t, asked, p.history_start)


def attribution_incremental(t: TablesMap, p: Params) -> DataFrame:
    """The results at the snapshot cutoff from those at the early one and what became known in between."""
    return reattribute(t, t["attributed_conversion"], EARLY_CUTOFF, p.snapshot_cutoff, p.history_start)


def attribution_latest(t: TablesMap, p: Params) -> DataFrame:
    return latest_results(
        t["attributed_conversion"], p.snapshot_cutoff, ALL_TYPES,
        ["attributed_conversion_id", "attribution_result", "marketing_channel_id", "source_data_cutoff_at"],
    ).select("conversion_type", "attributed_conversion_id", "attribution_result", "marketing_channel_id", "source_data_cutoff_at")


def densify_periods(t: TablesMap, p: Params) -> DataFrame:
    """Orders per merchant and month, zero where there were none."""
    months = p.months(4, 6)
    labelled = bucket_by_period(orders(t, p), "first_paid_at", months)
    measures = {"order_count": lambda here: F.count_if(here)}
    return dense_by_period(labelled, "period", months, measures, ["merchant_assignment_id"])


def _june_sales(t: TablesMap, p: Params) -> DataFrame:
    return sold_items(t, bucket_by_period(orders(t, p), "first_paid_at", p.months(6, 6)))


def key_union(t: TablesMap, p: Params) -> DataFrame:
    """June sales and June refunds side by side for every merchant that has either."""
    sold = _june_sales(t, p).groupBy("merchant_assignment_id").agg(total(F.col("gmv")).alias("gmv"))
    back = refunded_items(t, p, orders(t, p), p.months(6, 6)).groupBy("merchant_assignment_id").agg(total(F.col("refund")).alias("refund"))
    merged = key_union_join([sold, back], ["merchant_assignment_id"], {"gmv": 0, "refund": 0})
    return merged.select("merchant_assignment_id", money(F.col("gmv")).alias("gmv"), money(F.col("refund")).alias("refund"))


def total_row(t: TablesMap, p: Params) -> DataFrame:
    by_category = of_real_products(items(t), t).groupBy("product_category_code").agg(total(F.col("gmv")).alias("gmv"))
    with_total = append_total(by_category, "product_category_code", "TOTAL", {"gmv": total(F.col("gmv"))})
    return with_total.orderBy("sort_order", "product_category_code").drop("sort_order")


def required_rows(t: TablesMap, p: Params) -> DataFrame:
    """Sales per merchant in June, with a zero row for every other non-test merchant."""
    sold = _june_sales(t, p).groupBy("merchant_assignment_id").agg(total(F.col("gmv")).alias("gmv"))
    return complete_rows(sold, real_merchants(t), ["merchant_assignment_id"], {"gmv": money(F.lit(0))})


def merchants_without_sales(t: TablesMap, p: Params) -> DataFrame:
    return real_merchants(t).join(_june_sales(t, p), "merchant_assignment_id", "left_anti").select("merchant_assignment_id", "merchant_name")


def window_partition_count(t: TablesMap, p: Params) -> DataFrame:
    """Each result with the number of its conversion's revisions (one per cutoff run)."""
    fact = F.coalesce("invoice_payment_attempt_id", "commerce_order_id", "platform_fee_charge_id")
    revisions = Window.partitionBy("conversion_type", fact)
    return t["attributed_conversion"].select("attributed_conversion_id", F.count(F.lit(1)).over(revisions).alias("revision_count"))


def class_representative(t: TablesMap, p: Params) -> DataFrame:
    """The first conversion of each type and result."""
    return earliest(
        t["attributed_conversion"], ["conversion_type", "attribution_result"],
        ["conversion_at", "attributed_conversion_id"], ["attributed_conversion_id", "conversion_at"],
    )


def _faulty_results(results: DataFrame) -> DataFrame:
    """Attribution results with planted faults."""
    key = F.coalesce("invoice_payment_attempt_id", "commerce_order_id", "platform_fee_charge_id")
    late = F.col("source_data_cutoff_at") > F.lit(str(EARLY_CUTOFF)).cast("timestamp_ntz")
    return results.withColumns({
        "conversion_at": F.when(key % 501 == 1, F.col("conversion_at") - F.expr("INTERVAL 1 HOURS")).otherwise(F.col("conversion_at")),
        "is_test": F.when(key % 13 == 2, F.lit(False)).otherwise(F.col("is_test")),
        "marketing_channel_id": F.when(key % 401 == 3, F.lit(5)).otherwise(F.col("marketing_channel_id")),
        "recorded_at": F.when(late & (key % 301 == 4), F.lit(str(EARLY_CUTOFF)).cast("timestamp_ntz")).otherwise(F.col("recorded_at")),
        "selected_marketing_touch_id": F.when(key % 601 == 5, F.lit(0)).otherwise(F.col("selected_marketing_touch_id")),
    })


class _WithFaults(dict):
    """The tables, with faulty results in place of the stored ones once a rule asks for them."""

    def __init__(self, t: TablesMap) -> None:
        super().__init__()
        self._t = t

    def __missing__(self, name: str) -> DataFrame:
        return _faulty_results(self._t[name]) if name == "attributed_conversion" else self._t[name]


def _digit(name: str) -> Column:
    """0 to 15 by the row's key: by its number, which the small tables have without gaps, else by its text."""
    key = F.col(primary_key(name)).cast("string")
    digit = F.conv(F.substring(F.md5(key), 1, 1), 16, 10).cast("int")
    return F.coalesce((key.try_cast("bigint") % 16).cast("int"), digit)


def _spoiled(df: DataFrame, name: str) -> DataFrame:
    """Most rows with one kind of fault each: amounts, codes and numbers, order of times, missing or odd times, links."""
    digit, columns = _digit(name), []
    for place, field in enumerate(SCHEMAS[name]):
        found, kind = F.col(field.name), field.dataType
        if place == 0:
            value = found
        elif kind == MONEY:
            value = F.when(digit < 6, (F.lit(-1) - found).cast(MONEY)).otherwise(found)
        elif kind == TEXT:
            value = F.when(digit.between(3, 5), "").otherwise(found)
        elif kind == INT:
            value = F.when(digit.between(3, 5), 0).otherwise(found)
        elif kind == INSTANT:
            value = F.when(digit.between(6, 8), found - F.make_dt_interval(days=F.lit(400 * place)))
            if field.nullable:
                value = value.when(digit.between(9, 11), None).when(digit == 15, F.lit("1990-01-01").cast("timestamp_ntz"))
            value = value.otherwise(found)
        elif kind == LONG and field.nullable:
            value = F.when(digit.between(12, 14), 7).otherwise(found)
        else:
            value = found
        columns.append(value.cast(kind).alias(field.name))
    return df.select(*columns)


def dq_checks(t: TablesMap, p: Params) -> DataFrame:
    return quality.check_report({name: _spoiled(t[name], name) for name in SCHEMAS})


def dq_check_rows(t: TablesMap, p: Params) -> DataFrame:
    """The violating rows themselves, for one table."""
    from tallyhouse.operators.rules import CHECKS

    return quality.check(_faulty_results(t["attributed_conversion"]), "attributed_conversion_id", CHECKS["attributed_conversion"])


def dq_unique(t: TablesMap, p: Params) -> DataFrame:
    """Every unique rule, with a fifth of the rows stored twice."""
    return quality.unique_report({name: stack(t[name], t[name].filter(_digit(name) < 3)) for name in SCHEMAS})


def dq_line_key(t: TablesMap, p: Params) -> DataFrame:
    """Order lines that share order and product."""
    return quality.unique(t["commerce_order_item"], ["commerce_order_id", "product_id"])


def dq_foreign_key(t: TablesMap, p: Params) -> DataFrame:
    """Every reference, with a fifth of the rows of each table missing."""
    return quality.foreign_key_report({name: t[name].filter(_digit(name) >= 3) for name in SCHEMAS})


def _rules(*names: str):
    def plan(t: TablesMap, p: Params) -> DataFrame:
        return business_rules.rule_report(_WithFaults(t), p, list(names))

    return plan


dq_interval_overlap = _rules("overlapping_assignments")
dq_version_gap = _rules("spend_version_gap", "spend_lineage_broken", "spend_fork", "spend_before_final", "spend_never_visible")
dq_sequence = _rules("revision_chain_broken")
dq_subscription_history = _rules("wrong_movement", "wrong_normalization", "subscription_without_event", "current_state_disagrees", "paid_without_payment")
dq_owner_mismatch = _rules("item_of_other_merchant", "allocation_of_other_order", "campaign_scope_broken")
dq_sum_reconcile = _rules("refund_not_reconciled")
dq_touch = _rules("touch_subject_broken", "touch_type_mismatch", "touch_campaign_mismatch")
dq_conversion = _rules(
    "conversion_disagrees_with_fact", "conversion_window_wrong", "conversion_leaks_test", "conversion_times_wrong",
    "selected_links_disagree", "direct_channel_wrong", "unknown_keeps_links",
)
dq_visibility = _rules("recorded_after_cutoff", "tables_without_test_rows")


def dq_attribution_recheck(t: TablesMap, p: Params) -> DataFrame:
    """Stored results that differ from a fresh run, each at its own cutoff."""
    return business_rules.attribution_differs(_WithFaults(t), p)


def dq_text_formats(t: TablesMap, p: Params) -> DataFrame:
    """Refund headers as dataset text, some cells spoiled, and the problems found in them."""
    cells = business_rules.text_cells(t["commerce_refund"], "commerce_refund_id")
    length = F.length("record_id")
    spoiled = (
        F.when((F.col("column_name") == "requested_at") & (length % 7 == 1), F.substring("value", 1, 19))
        .when((F.col("column_name") == "item_refund_amount") & (length % 9 == 2), F.concat(F.lit("-"), "value"))
        .otherwise(F.col("value"))
    )
    return business_rules.format_violations(cells.withColumn("value", spoiled), p.snapshot_cutoff)


def dq_text_formats_all(t: TablesMap, p: Params) -> DataFrame:
    """Every table as dataset text with some cells spoiled: the problems found, counted by column.

    Only columns with a fixed form become text, as no other can have a problem; the mark of a cell is told once.
    """
    parts = []
    for name in SCHEMAS:
        formed = [c for c in t[name].columns if business_rules.has_format(c)]
        cells = business_rules.text_cells(t[name], primary_key(name), formed).withColumn(
            "mark", F.substring(F.md5(F.concat_ws(":", "record_id", "column_name")), 1, 2))
        spoiled = F.when(F.col("mark") == "a1", F.substring("value", 1, 19)).when(
            F.col("mark") == "b2", F.concat(F.lit("-"), "value")).otherwise(F.col("value"))
        parts.append(business_rules.format_violations(cells.withColumn("value", spoiled), p.snapshot_cutoff)
                     .groupBy("column_name", "problem").agg(F.count(F.lit(1)).alias("cells")).withColumn("table_name", F.lit(name)))
    return stack(*parts)


def decode_results(t: TablesMap, p: Params) -> DataFrame:
    """Refunds as stored result text and back to typed columns."""
    shown = t["commerce_refund"].select("commerce_refund_id", "total_refund_amount", "succeeded_at", "is_test")
    stored = shown.select(*[cell_text(f.name, f.dataType).alias(f.name) for f in shown.schema])
    return decode(stored, {"commerce_refund_id": "string", "total_refund_amount": "decimal", "succeeded_at": "datetime", "is_test": "boolean"})


def net_changes(t: TablesMap, p: Params) -> DataFrame:
    """Several changes of one subscription on one day as one."""
    events = t["subscription_state_event"].withColumn("day", F.date_trunc("day", "effective_at"))
    order = F.struct("effective_at", "subscription_state_event_id")
    return net_by_instant(events.withColumn("place", order), ["subscription_id"], "day", "place",
                          ["normalized_mrr_before"], ["normalized_mrr_after"])


def largest_refunds(t: TablesMap, p: Params) -> DataFrame:
    """The hundred largest refunds, ties by id, within the limits of a result."""
    top = t["commerce_refund"].select("commerce_refund_id", "total_refund_amount").orderBy(
        F.desc("total_refund_amount"), "commerce_refund_id").limit(100)
    rows = bounded(top, 100, 1 << 20)
    return t["commerce_refund"].sparkSession.createDataFrame(rows, top.schema)


def _stored_orders(t: TablesMap) -> DataFrame:
    """A stored copy of the orders: some missing, some changed, some in excess."""
    source = t["commerce_order"]
    key = F.col("commerce_order_id")
    kept = source.filter(key % 5 != 0).withColumn("status", F.when(key % 50 == 1, "created").otherwise(F.col("status")))
    excess = source.filter(key % 100 == 2).withColumn("commerce_order_id", -key - 1).withColumn(
        "external_order_id", F.concat(F.lit("X-"), "external_order_id")
    )
    return kept.unionByName(excess)


_ORDER_MATCH = ["external_order_id"]


def load_upsert_check(t: TablesMap, p: Params) -> DataFrame:
    return lifecycle.load_check(t["commerce_order"], _stored_orders(t), _ORDER_MATCH)


def verify_rows(t: TablesMap, p: Params) -> DataFrame:
    return lifecycle.verify(t["commerce_order"], _stored_orders(t), _ORDER_MATCH)


def unload_rows(t: TablesMap, p: Params) -> DataFrame:
    left = lifecycle.unload(t["commerce_order"], _stored_orders(t), _ORDER_MATCH)
    return left.select("commerce_order_id", "external_order_id", "status")


def load_then_read(t: TablesMap, p: Params) -> DataFrame:
    """Three versions of a store: most rows of two tables, all rows, and what is left without the orders loaded first."""
    spark = t["commerce_order"].sparkSession
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid4().hex}")
    match, order = {"consumer": ["external_consumer_id"], "commerce_order": ["external_order_id"]}, ["consumer", "commerce_order"]
    whole = {name: t[name] for name in order}
    first = {"consumer": whole["consumer"].filter("consumer_id % 3 <> 0"), "commerce_order": whole["commerce_order"].filter("consumer_id % 3 <> 0")}
    found = [store.load(first, match, order), store.load(whole, match, order), store.load(whole, match, order),
             store.unload({"commerce_order": first["commerce_order"]}, match, ["commerce_order"])]
    parts = []
    for version in dict.fromkeys(found):
        back = store.read(whole, version)
        parts += [back[name].agg(F.count(F.lit(1)).alias("row_count"), F.sum(primary_key(name)).alias("id_sum")).select(
            F.lit(version).alias("version"), F.lit(name).alias("table_name"), "row_count", "id_sum") for name in order]
    return stack(*parts)


def _as_text(df: DataFrame, name: str, references: Mapping[str, str]) -> Column:
    """A row as the dataset's record: every column but the key as text, references as {table, record_id}."""
    cells = []
    for field in SCHEMAS[name].fields[1:]:
        value = F.col(field.name)
        if field.name in references:
            value = F.struct(F.lit(references[field.name]).alias("table"), value.cast("string").alias("record_id"))
        elif field.dataType == INSTANT:
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        cells.append(value.alias(field.name))
    return F.struct(F.col(primary_key(name)).cast("string").alias("record_id"), F.struct(*cells).alias("values"))


def nested_dataset(t: TablesMap, p: Params) -> DataFrame:
    """Consumers and their orders written as nested dataset files, read back by byte ranges, references resolved.

    A file holds two hundred consumer numbers, so that its text stays small whatever the tables hold.
    """
    spark = t["consumer"].sparkSession
    path = f"{shared_dir(spark)}/nested-{uuid4().hex}"
    part = F.floor(F.col("consumer_id") / 200).alias("part")
    rows = stack(
        t["consumer"].select(part, F.lit(0).alias("place"), F.to_json(_as_text(t["consumer"], "consumer", {})).alias("record")),
        t["commerce_order"].select(part, F.lit(1).alias("place"), F.to_json(
            _as_text(t["commerce_order"], "commerce_order", {"consumer_id": "consumer"})).alias("record")))
    tables = rows.groupBy("part", "place").agg(F.concat_ws(", ", F.collect_list("record")).alias("records")).select(
        "part", "place", F.format_string(
            '{"table_name": "%s", "match_columns": ["%s"], "records": [%s]}',
            F.when(F.col("place") == 0, "consumer").otherwise("commerce_order"),
            F.when(F.col("place") == 0, "external_consumer_id").otherwise("external_order_id"), "records").alias("text"))
    files = tables.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("tables")).select(
        "part", F.format_string('{"source_id": "part %s", "tables": [%s]}', F.col("part").cast("string"),
                                F.concat_ws(", ", F.transform("tables", lambda x: x["text"]))).alias("value"))
    files.write.partitionBy("part").text(path)
    back = nested.typed_tables(split_json.read_records(spark, [path]))
    return back["commerce_order"].join(back["consumer"].select("consumer_id", "external_consumer_id", "first_identified_at"), "consumer_id").select(
        "external_order_id", "external_consumer_id", "first_identified_at", "status", "first_paid_at", "is_test")


def content_counts(t: TablesMap, p: Params) -> DataFrame:
    return lifecycle.row_counts(t)


def ambiguous_match_keys(t: TablesMap, p: Params) -> DataFrame:
    return lifecycle.ambiguous_match_keys(t["marketing_touch"], ["organization_id", "marketing_channel_id"])


def _variants(t: TablesMap) -> dict[str, DataFrame]:
    base = t["commerce_order"]
    merchant, done = F.col("merchant_assignment_id"), F.col("completed_at")
    return {
        "same": base,
        "fewer_rows": base.filter(merchant % 7 != 3),
        "null_for_value": base.withColumn("completed_at", F.when(merchant % 7 != 3, done)),
        "other_type": base.withColumn("merchant_assignment_id", merchant.cast("decimal(20,0)")),
        "other_value": base.withColumn("status", F.when(merchant % 7 == 3, "archived").otherwise(F.col("status"))),
        "other_name": base.withColumnRenamed("status", "state"),
        "other_order": base.select(*reversed(base.columns)),
        "fewer_columns": base.drop("status"),
    }


def _compared(t: TablesMap, order_by) -> DataFrame:
    base, placed = t["commerce_order"], {}
    return stack(*[
        compare(variant, base, order_by, placed=placed).select(F.lit(name).alias("variant"), "matches", "failure_code")
        for name, variant in _variants(t).items()
    ])


def compare_multiset(t: TablesMap, p: Params) -> DataFrame:
    return _compared(t, None)


def compare_ordered(t: TablesMap, p: Params) -> DataFrame:
    return _compared(t, ["external_order_id"])


def table_digest(t: TablesMap, p: Params) -> DataFrame:
    return digest(t["commerce_order"])


def suite_counts(t: TablesMap, p: Params) -> DataFrame:
    """Orders as evaluated cases, by a status taken from their own."""
    status = F.when(F.col("status") == "completed", "PASS").when(F.col("status") == "paid", "FAIL_RESULT").otherwise("NOT_EVALUATED")
    return suite_rollup(t["commerce_order"].select(F.col("external_order_id").alias("case_id"), status.alias("status")))


def _case_orders(t: TablesMap) -> DataFrame:
    """Orders as result rows: a case per consumer, placed by order id."""
    shown = t["commerce_order"].select("external_order_id", "merchant_assignment_id", "status", "completed_at", "consumer_id", "commerce_order_id")
    cells = shown.select("external_order_id", "merchant_assignment_id", "status", "completed_at")
    return shown.select(
        F.col("consumer_id").cast("string").alias("case_id"), F.col("commerce_order_id").alias("position"),
        cells_of(cells.schema).alias("cells"), "consumer_id", "commerce_order_id", "completed_at")


_SHOWN = ["external_order_id", "merchant_assignment_id", "status", "completed_at"]


def _suite(t: TablesMap) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A suite with a case per consumer; sixteen ways to answer, dealt by consumer id, alternately ordered and not."""
    rows = _case_orders(t)
    people = rows.select("case_id", "consumer_id").distinct()
    way = F.col("consumer_id") % 16
    names = F.array(*[F.lit(c) for c in _SHOWN])
    cases = people.select(
        "case_id",
        F.when(way == 0, suite.DEFERRED).when(way.between(1, 3), suite.CLARIFY).otherwise(suite.EXECUTE).alias("expected_action"),
        F.when(way.between(1, 3), "unclear_period").alias("clarification_code"),
        F.when(F.floor(F.col("consumer_id") / 16) % 2 == 0, suite.ORDERED).otherwise(suite.UNORDERED).alias("mode"),
        names.alias("columns"))
    answered = (
        F.when(way == 8, F.slice(names, 1, 3)).when(way == 9, F.array(*[F.lit(f"x_{c}") for c in _SHOWN]))
        .when(way == 10, F.reverse(names)).otherwise(names))
    responses = people.filter(way != 7).select(
        "case_id", F.when(way.isin(1, 2, 4), suite.CLARIFY).otherwise(suite.EXECUTE).alias("action"),
        F.when(way.isin(1, 4), "unclear_period").when(way == 2, "unclear_scope").alias("clarification_code"),
        F.when(way == 5, F.array(F.lit("WILDCARD_SELECT"), F.lit("UNKNOWN_TABLE"))).alias("structure_codes"),
        F.when(way == 6, "QUERY_TIMEOUT").alias("execution_code"), answered.alias("columns"))
    third = F.col("commerce_order_id") % 3 == 0

    def changed(place: int, **parts: object) -> Column:
        cell = F.struct(*[F.lit(parts[k]).cast("string").alias(k) if k in parts else F.col("cells")[place][k].alias(k) for k in ("kind", "text")])
        return F.concat(F.slice("cells", 1, place), F.array(cell), F.slice("cells", place + 2, 4))

    spoiled = (
        F.when((way == 12) & third, changed(3, kind="null", text=None)).when((way == 13) & third, changed(1, kind="decimal"))
        .when((way == 14) & third, changed(2, text="archived")).otherwise(F.col("cells")))
    actual = rows.filter(~((way == 11) & third)).select("case_id", "position", spoiled.alias("cells"))
    return cases, responses, actual, rows.select("case_id", "position", "cells")


def suite_report(t: TablesMap, p: Params) -> DataFrame:
    """Every case's outcome, and whether both sides hold the same rows."""
    report = suite.suite_report(*_suite(t))
    return report.select(
        "case_id", "expected_action", "actual_action", "status", "failed_stage", "failure_code",
        F.array_join("secondary_codes", ",").alias("secondary_codes"),
        F.col("expected_digest").eqNullSafe(F.col("actual_digest")).alias("same_rows"))


def _case_digests(t: TablesMap, p: Params, month: int) -> DataFrame:
    """A case per merchant: the digests of its orders of a month, by content alone and with their places."""
    found = bucket_by_period(t["commerce_order"], "first_paid_at", p.months(month, month))
    shown = found.select("external_order_id", "status")
    rows = found.select(F.col("merchant_assignment_id").cast("string").alias("case_id"), F.col("commerce_order_id").alias("position"),
                        cells_of(shown.schema).alias("cells"))
    business = suite.row_digests(rows, F.lit(suite.UNORDERED)).withColumnRenamed("digest", "business_digest")
    expected = suite.row_digests(rows, F.lit(suite.ORDERED)).withColumnRenamed("digest", "expected_digest")
    return business.join(expected, "case_id")


_DIGESTS = ["business_digest", "expected_digest"]


def case_delta(t: TablesMap, p: Params) -> DataFrame:
    return suite.delta(_case_digests(t, p, 5), _case_digests(t, p, 6), _DIGESTS)


def case_reviews(t: TablesMap, p: Params) -> DataFrame:
    """Reviews of the May/June change; half of them saw another digest, each time another one of the four."""
    changes = case_delta(t, p)
    number = F.col("case_id").cast("bigint")
    seen = [f"{side}_{d}" for side in ("old", "new") for d in _DIGESTS]
    reviewed = changes.select(
        "case_id", *[F.when(number % 8 == 2 * k + 1, F.concat(F.coalesce(c, F.lit("")), F.lit("?"))).otherwise(F.col(c)).alias(c) for k, c in enumerate(seen)],
        F.lit("expected growth").alias("change_reason"), F.array(F.lit("may"), F.lit("june")).alias("scenario_ids"))
    found = suite.reviews(changes, reviewed, _DIGESTS)
    return found.withColumn("scenario_ids", F.array_join("scenario_ids", ","))


def result_sink(t: TablesMap, p: Params) -> DataFrame:
    """Two results written in their declared order and read back by place."""
    spark = t["commerce_order"].sparkSession
    path = f"{shared_dir(spark)}/results-{uuid4().hex}"
    refunds = t["commerce_refund"].select("total_refund_amount", "commerce_refund_id", "succeeded_at")
    sold = t["commerce_order"].select("first_paid_at", "commerce_order_id", "is_test")
    suite.write_suite({"refunds": refunds, "sales": sold}, path,
                      {"refunds": ["total_refund_amount", "commerce_refund_id"], "sales": ["first_paid_at", "commerce_order_id"]})
    back = suite.read_suite(spark, path)
    return back.select("case_id", F.array_join("columns", ",").alias("columns"), "position",
                       F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["kind"], c["text"])), "|").alias("row"))


def response_completeness(t: TablesMap, p: Params) -> DataFrame:
    """Orders as expected cases (cancelled ones deferred), fee charges as responses."""
    action = F.when(F.col("status") == "cancelled", "deferred").otherwise("execute")
    expected = t["commerce_order"].filter("commerce_order_id % 11 <> 4").select(F.col("commerce_order_id").alias("case_id"), action.alias("action"))
    responses = t["platform_fee_charge"].filter("status = 'succeeded'").select(F.col("commerce_order_id").alias("case_id"))
    return response_gaps(expected, responses)


# operators over the derived tables alone, and those that also read attribution results
PLAIN = [
    state_asof_multi, latest_spend_revision, attribution_last_touch, attribution_own_cutoffs, densify_periods, key_union, total_row, required_rows,
    merchants_without_sales, dq_line_key, dq_text_formats, decode_results, net_changes, largest_refunds, load_upsert_check, verify_rows, unload_rows,
    ambiguous_match_keys, compare_multiset, compare_ordered, table_digest, suite_counts, suite_report, load_then_read, nested_dataset, case_delta, case_reviews, result_sink,
    response_completeness,
]
# rules that never read attribution results
PLAIN_RULES = {
    "dq_interval_overlap": dq_interval_overlap,
    "dq_version_gap": dq_version_gap,
    "dq_subscription_history": dq_subscription_history,
    "dq_owner_mismatch": dq_owner_mismatch,
    "dq_sum_reconcile": dq_sum_reconcile,
    "dq_touch": dq_touch,
}
ATTRIBUTED = {
    "attribution_two_cutoffs": attribution_two_cutoffs,
    "attribution_incremental": attribution_incremental,
    "attribution_latest": attribution_latest,
    "window_partition_count": window_partition_count,
    "class_representative": class_representative,
    "dq_checks": dq_checks,
    "dq_text_formats_all": dq_text_formats_all,
    "dq_check_rows": dq_check_rows,
    "dq_unique": dq_unique,
    "dq_foreign_key": dq_foreign_key,
    "dq_sequence": dq_sequence,
    "dq_conversion": dq_conversion,
    "dq_visibility": dq_visibility,
    "dq_attribution_recheck": dq_attribution_recheck,
    "content_counts": content_counts,
}
