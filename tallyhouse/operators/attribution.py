"""Last-non-direct-touch attribution as a batch job that produces a table.

A conversion goes to the latest eligible touch of the same subject in the closed window
[conversion - 168 h, conversion]. Running again at a later cutoff appends new results; several
cutoffs are resolved in one pass over the touches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.calendar import instant
from tallyhouse.operators.asof import last_before
from tallyhouse.operators.bitemporal import last_known_before
from tallyhouse.operators.blocks import earliest, real, stack, valid_at
from tallyhouse.session import staged

# Fixed values of the attribution model.
MODEL_VERSION = "last_non_direct_168h_v1"
LOOK_BACK_HOURS = 168
NON_DIRECT, DIRECT, UNKNOWN = "non_direct", "direct", "unknown_unattributed"
REASON_SELECTED = "selected_last_non_direct"
REASON_NONE = "no_eligible_non_direct_touch"
REASON_HISTORY = "window_history_incomplete"
SAAS_TYPES = ("saas_first_payment", "saas_revenue")
ORDER_TYPES = ("commerce_first_payment", "attributed_gmv")
FEE_TYPES = ("commerce_revenue",)
ALL_TYPES = SAAS_TYPES + ORDER_TYPES + FEE_TYPES

_FACT_IDS = ("invoice_payment_attempt_id", "commerce_order_id", "platform_fee_charge_id")
_NUMBER = "bigint"
# what a result takes from its touch
_LINKED = ("occurred_at", "marketing_touch_id", "marketing_channel_id", "marketing_campaign_id")


def _typed(df: DataFrame, conversion_type: str) -> DataFrame:
    return df.withColumn("conversion_type", F.lit(conversion_type))


def _conversion(df: DataFrame, fact: str, at: str, scope: str, subject: Column) -> DataFrame:
    return df.select(
        F.lit(scope).alias("scope"),
        subject.alias("subject_id"),
        *[(F.col(c) if c == fact else F.lit(None)).cast(_NUMBER).alias(c) for c in _FACT_IDS],
        F.col(fact).cast("string").alias("fact_key"),
        F.col(at).alias("conversion_at"),
        F.col("fact_is_test"),
    )


def _first_only(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c not in ("scope", "subject_id")]
    return earliest(df, ["scope", "subject_id"], ["conversion_at", "fact_key"], rest)


def conversions(t: Mapping[str, DataFrame], types: Sequence[str] = ALL_TYPES) -> DataFrame:
    """Authoritative facts as conversions: subject, instant, fact link, test lineage."""
    unknown = set(types) - set(ALL_TYPES)
    if unknown:
        raise ValueError(f"unsupported conversion types {sorted(unknown)}")
    parts = []
    if set(types) & set(SAAS_TYPES):
        paid = (
            t["invoice_payment_attempt"]
            .filter("status = 'succeeded'")
            .withColumnRenamed("is_test", "fact_is_test")
            .join(t["subscription_invoice"].select("subscription_invoice_id", "subscription_id"), "subscription_invoice_id")
            .join(t["subscription"].select("subscription_id", "organization_id"), "subscription_id")
        )
        paid = _conversion(paid, "invoice_payment_attempt_id", "succeeded_at", "saas", F.col("organization_id"))
        parts += [_typed(_first_only(paid), "saas_first_payment")] if "saas_first_payment" in types else []
        parts += [_typed(paid, "saas_revenue")] if "saas_revenue" in types else []
    if set(types) & set(ORDER_TYPES):
        done = t["commerce_order"].filter("status = 'completed'").withColumnRenamed("is_test", "fact_is_test")
        done = _conversion(done, "commerce_order_id", "first_paid_at", "commerce", F.col("consumer_id"))
        parts += [_typed(_first_only(done), "commerce_first_payment")] if "commerce_first_payment" in types else []
        parts += [_typed(done, "attributed_gmv")] if "attributed_gmv" in types else []
    if set(types) & set(FEE_TYPES):
        charged = (
            t["platform_fee_charge"]
            .filter("status = 'succeeded'")
            .select("platform_fee_charge_id", "commerce_order_id", "succeeded_at", F.col("is_test").alias("fact_is_test"))
            .join(t["commerce_order"].select("commerce_order_id", "consumer_id"), "commerce_order_id")
        )
        charged = _conversion(charged, "platform_fee_charge_id", "succeeded_at", "commerce", F.col("consumer_id"))
        parts.append(_typed(charged, "commerce_revenue"))
    return stack(*parts)


def _mark_test_subjects(found: DataFrame, t: Mapping[str, DataFrame], scopes: set[str]) -> DataFrame:
    tests = []
    if "saas" in scopes:
        tests.append(t["organization"].filter("is_test").select(F.lit("saas").alias("scope"), F.col("organization_id").alias("subject_id")))
    if "commerce" in scopes:
        tests.append(t["consumer"].filter("is_test").select(F.lit("commerce").alias("scope"), F.col("consumer_id").alias("subject_id")))
    marked = found.join(stack(*tests).withColumn("__test", F.lit(True)), ["scope", "subject_id"], "left")
    return marked.withColumn("is_test", F.col("fact_is_test") | F.col("__test").isNotNull()).drop("__test", "fact_is_test")


def eligible_touches(t: Mapping[str, DataFrame], scopes: set[str]) -> DataFrame:
    """Touches that may win, except for the tests that depend on conversion and cutoff.

    `known_at` is the first cutoff at which the touch counts.
    """
    touches = real(t["marketing_touch"]).filter(
        "quality_status = 'accepted' AND touch_type = 'non_direct' AND processed_at IS NOT NULL"
    )
    has_org, has_consumer = F.col("organization_id").isNotNull(), F.col("consumer_id").isNotNull()
    wanted = F.lit(False)
    if "saas" in scopes:
        wanted = wanted | (has_org & ~has_consumer)
    if "commerce" in scopes:
        wanted = wanted | (has_consumer & ~has_org)
    touches = touches.filter(wanted).select(
        "marketing_touch_id", "source_event_id", "marketing_channel_id", "marketing_campaign_id", "occurred_at",
        F.greatest("processed_at", "recorded_at").alias("known_at"),
        F.when(has_org, "saas").otherwise("commerce").alias("scope"),
        F.coalesce("organization_id", "consumer_id").alias("subject_id"),
    )
    channels = real(t["marketing_channel"]).filter("channel_type <> 'direct'").select(
        "marketing_channel_id", "effective_from", "effective_to"
    )
    touches = touches.join(channels, "marketing_channel_id").filter(
        valid_at(F.col("occurred_at"), F.col("effective_from"), F.col("effective_to"))
    ).drop("effective_from", "effective_to")
    campaigns = real(t["marketing_campaign"]).select(
        "marketing_campaign_id",
        F.col("primary_channel_id").alias("marketing_channel_id"),
        F.col("business_scope").alias("scope"),
        # a SaaS campaign only serves its own organization; a commerce one any consumer
        F.when(F.col("business_scope") == "saas", F.col("organization_id")).alias("only_subject"),
    )
    free = touches.filter("marketing_campaign_id IS NULL")
    bound = (
        touches.filter("marketing_campaign_id IS NOT NULL")
        .join(campaigns, ["marketing_campaign_id", "marketing_channel_id", "scope"])
        .filter("only_subject IS NULL OR only_subject = subject_id")
        .drop("only_subject")
    )
    return free.unionByName(bound)


def attribute(
    t: Mapping[str, DataFrame],
    cutoffs: Sequence[datetime],
    history_start: datetime,
    types: Sequence[str] = ALL_TYPES,
    since: datetime | None = None,
) -> DataFrame:
    """Attribution results, one row per conversion and cutoff not before it.

    With `since`, only conversions from that instant on are attributed, for an incremental run;
    whether a payment is its subject's first is still told from the whole history.
    """
    scopes = {"saas" if kind in SAAS_TYPES else "commerce" for kind in types}
    found = _mark_test_subjects(conversions(t, types), t, scopes)
    found = found.filter(F.col("conversion_at") <= instant(max(cutoffs)))
    # touches outside every complete window are not read: before the history or the look-back began
    reach = history_start
    if since is not None:
        found = found.filter(F.col("conversion_at") >= instant(since))
        reach = max(reach, since - timedelta(hours=LOOK_BACK_HOURS))
    touches = eligible_touches(t, scopes).filter(
        (F.col("occurred_at") >= instant(reach)) & (F.col("occurred_at") <= instant(max(cutoffs)))
    )
    # alternately named structs: the best touch known at each cutoff
    picks = {f"touch_{i}": F.col("known_at") <= instant(cutoff) for i, cutoff in enumerate(cutoffs)}
    # one fact id crosses the as-of join; the columns of the facts follow from it and the type
    slim = found.select("scope", "subject_id", "conversion_type", "conversion_at", "is_test", F.coalesce(*_FACT_IDS).alias("__fact"))
    resolved = last_before(
        slim, touches, ["scope", "subject_id"], "conversion_at", "occurred_at",
        ["source_event_id"], picks, columns=_LINKED,
    ).withColumns({
        **{c: F.when(F.col("conversion_type").isin([kind for kind in ALL_TYPES if _fact_of(kind) == c]), F.col("__fact")) for c in _FACT_IDS},
        "fact_key": F.col("__fact").cast("string"),
    })
    per_cutoff = F.array(
        *[
            F.struct(instant(cutoff).alias("source_data_cutoff_at"), F.col(f"touch_{i}").alias("touch"))
            for i, cutoff in enumerate(cutoffs)
        ]
    )
    rows = resolved.withColumn(
        "window_started_at", F.col("conversion_at") - F.expr(f"INTERVAL {LOOK_BACK_HOURS} HOURS")
    ).select(*found.columns, "window_started_at", F.inline(per_cutoff))
    return _outcomes(rows.filter(F.col("conversion_at") <= F.col("source_data_cutoff_at")), t, history_start)


def attribute_at(t: Mapping[str, DataFrame], asked: DataFrame, history_start: datetime) -> DataFrame:
    """Attribution results of the asked (conversion_type, fact_key, source_data_cutoff_at), each at its own cutoff.

    One pass for any number of different cutoffs. What no fact stands for, or is asked at a cutoff before the
    conversion, gives no row; asking twice gives one row.
    """
    keys = ["conversion_type", "fact_key", "source_data_cutoff_at"]
    found = _mark_test_subjects(conversions(t), t, {"saas", "commerce"})
    rows = found.join(asked.select(*keys).distinct(), ["conversion_type", "fact_key"]).filter(
        F.col("conversion_at") <= F.col("source_data_cutoff_at")
    ).withColumn("window_started_at", F.col("conversion_at") - F.expr(f"INTERVAL {LOOK_BACK_HOURS} HOURS"))
    touches = eligible_touches(t, {"saas", "commerce"}).filter(F.col("occurred_at") >= instant(history_start))
    resolved = last_known_before(
        rows, touches, ["scope", "subject_id"], "conversion_at", "source_data_cutoff_at", "occurred_at", "known_at",
        ["source_event_id"], "touch", columns=_LINKED,
    )
    return _outcomes(resolved, t, history_start)


def reattribute(t: Mapping[str, DataFrame], stored: DataFrame, old: datetime, new: datetime, history_start: datetime) -> DataFrame:
    """Attribution results at `new`, given all results at `old`: only what can have changed is resolved again.

    A result can change where a touch that became known in between lies in the conversion's window, and is missing
    where the conversion itself lies in between. All other conversions take over their stored result under the new
    cutoff. The result equals a whole run at `new`, as long as facts, channels and campaigns have not changed.
    """
    found = conversions(t).filter(F.col("conversion_at") <= instant(new))
    between = eligible_touches(t, {"saas", "commerce"}).filter(
        (F.col("known_at") > instant(old)) & (F.col("known_at") <= instant(new)) & (F.col("occurred_at") >= instant(history_start)))
    keys = ["scope", "subject_id"]
    # the last of these touches before a conversion lies in its window, or none does
    reached = last_before(
        found.select("conversion_type", "fact_key", "conversion_at", *keys), between.select(*keys, "occurred_at"),
        keys, "conversion_at", "occurred_at", [], {"newly": None}, columns=["occurred_at"])
    start = F.col("conversion_at") - F.expr(f"INTERVAL {LOOK_BACK_HOURS} HOURS")
    touched = reached.filter((F.col("conversion_at") > instant(old)) | (F.col("newly.occurred_at") >= start))
    asked = staged(touched.select("conversion_type", "fact_key", *keys, instant(new).alias("source_data_cutoff_at")))
    # touches of subjects that are asked for, nobody else's
    subjects = asked.select(*keys).distinct()
    own = F.when(F.col("organization_id").isNotNull(), "saas").otherwise("commerce")
    wanted = t["marketing_touch"].withColumn("scope", own).withColumn(
        "subject_id", F.coalesce("organization_id", "consumer_id")).join(subjects, keys, "left_semi").drop(*keys)
    fresh = attribute_at({**{name: t[name] for name in _READ}, "marketing_touch": wanted}, asked, history_start)

    fact = F.coalesce(*_FACT_IDS).cast("string")
    untouched = stored.filter(F.col("source_data_cutoff_at") == instant(old)).withColumn("fact_key", fact).join(
        asked.select("conversion_type", "fact_key"), ["conversion_type", "fact_key"], "left_anti")
    renewed = untouched.withColumns({
        "attributed_conversion_id": _result_id(instant(new)),
        "source_data_cutoff_at": instant(new), "attributed_at": instant(new), "recorded_at": instant(new),
    })
    return fresh.unionByName(renewed.select(*fresh.columns))


_READ = ("invoice_payment_attempt", "subscription_invoice", "subscription", "commerce_order", "platform_fee_charge",
         "organization", "consumer", "marketing_channel", "marketing_campaign")


def _result_id(cutoff: Column) -> Column:
    return F.concat_ws(":", "conversion_type", "fact_key", F.date_format(cutoff, "yyyyMMddHHmmssSSSSSS"))


def _outcomes(rows: DataFrame, t: Mapping[str, DataFrame], history_start: datetime) -> DataFrame:
    """Results of conversions with the struct `touch` of the last eligible touch known at their cutoff."""
    complete = F.col("window_started_at") >= instant(history_start)
    in_window = F.col("touch.occurred_at") >= F.col("window_started_at")
    outcome = F.when(~complete, UNKNOWN).when(in_window, NON_DIRECT).otherwise(DIRECT)
    rows = rows.withColumn("history_complete", complete).withColumn("attribution_result", outcome)
    # an equi join on the code: the governed direct channel for direct results, nothing for others
    direct = real(t["marketing_channel"]).filter("channel_type = 'direct'").select(
        F.col("channel_code").alias("direct_code"),
        F.col("marketing_channel_id").alias("direct_channel_id"), "effective_from", "effective_to",
    )
    rows = rows.withColumn("direct_code", F.when(F.col("attribution_result") == DIRECT, "direct"))
    rows = rows.join(direct, "direct_code", "left")
    direct_channel = F.when(
        valid_at(F.col("conversion_at"), F.col("effective_from"), F.col("effective_to")), F.col("direct_channel_id")
    )
    won = F.col("attribution_result") == NON_DIRECT

    def linked(column: str) -> Column:
        return F.when(won, F.col(f"touch.{column}"))

    return rows.select(
        _result_id(F.col("source_data_cutoff_at")).alias("attributed_conversion_id"),
        "conversion_type",
        F.when(F.col("scope") == "saas", F.col("subject_id")).alias("organization_id"),
        F.when(F.col("scope") == "commerce", F.col("subject_id")).alias("consumer_id"),
        *_FACT_IDS,
        linked("marketing_touch_id").alias("selected_marketing_touch_id"),
        F.coalesce(linked("marketing_channel_id"), direct_channel).alias("marketing_channel_id"),
        linked("marketing_campaign_id").alias("marketing_campaign_id"),
        "attribution_result",
        F.when(won, REASON_SELECTED).when(F.col("attribution_result") == DIRECT, REASON_NONE)
        .otherwise(REASON_HISTORY).alias("reason_code"),
        F.lit(MODEL_VERSION).alias("model_version"),
        "conversion_at",
        "window_started_at",
        "history_complete",
        "source_data_cutoff_at",
        F.col("source_data_cutoff_at").alias("attributed_at"),
        "is_test",
        F.col("source_data_cutoff_at").alias("recorded_at"),
    )


def append_results(existing: DataFrame, computed: DataFrame) -> DataFrame:
    """Only the results whose (type, fact, model, cutoff) is not stored yet: never overwrite."""
    key = ("conversion_type", *_FACT_IDS, "model_version", "source_data_cutoff_at")
    stored = existing.select(*[F.col(c).alias(f"_{c}") for c in key])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return computed.join(stored, same, "left_anti")


RESULT_ORDER = ("source_data_cutoff_at", "recorded_at", "attributed_conversion_id")


def latest_results(results: DataFrame, cutoff: datetime, types: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The newest visible non-test result per conversion.

    All results of a conversion carry its fact's own instant (quality rule on facts), so `conversion_at`
    is part of the key: a period filter on the outcome reaches the scan.
    """
    known = (
        real(results)
        .filter(F.col("conversion_type").isin(*types))
        .filter((F.col("source_data_cutoff_at") <= instant(cutoff)) & (F.col("recorded_at") <= instant(cutoff)))
    )
    facts = sorted({_fact_of(kind) for kind in types})
    keys = ["conversion_type", *facts, "conversion_at"]
    best = F.max_by(F.struct(*[c for c in columns if c not in keys]), F.struct(*RESULT_ORDER))
    found = known.groupBy(*keys).agg(best.alias("__r"))
    named = ["conversion_type", *facts]
    rest = [c for c in columns if c not in named]
    return found.select(*named, *[F.col(c if c in keys else f"__r.{c}").alias(c) for c in rest])


def _fact_of(kind: str) -> str:
    if kind in SAAS_TYPES:
        return "invoice_payment_attempt_id"
    return "commerce_order_id" if kind in ORDER_TYPES else "platform_fee_charge_id"


def with_channel_code(df: DataFrame, channels: DataFrame, exclude_test: bool = True) -> DataFrame:
    """Adds channel_code ('unknown_unattributed' without a channel); drops test channels."""
    codes = channels.select("marketing_channel_id", F.col("channel_code").alias("__code"), F.col("is_test").alias("__ct"))
    joined = df.join(codes, "marketing_channel_id", "left")
    if exclude_test:
        joined = joined.filter("__ct IS NULL OR NOT __ct")
    return joined.withColumn("channel_code", F.coalesce("__code", F.lit(UNKNOWN))).drop("__code", "__ct")

