"""Exact decimal money and ratios that are NULL where they are undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(19,4)"
# wide enough for a sum of money, narrow enough that a quotient keeps its fraction
_RATIO_SIDE = "decimal(23,4)"


def money(value: Column) -> Column:
    return value.cast(MONEY)


def total(value: Column) -> Column:
    """Sum of money; an empty set is 0."""
    return money(F.coalesce(F.sum(value), F.lit(0)))


def total_if(condition: Column, value: Column) -> Column:
    return money(F.coalesce(F.sum(F.when(condition, value)), F.lit(0)))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator rounded half up to four digits; NULL for a zero or NULL divisor."""
    divisor = F.nullif(denominator.cast(_RATIO_SIDE), F.lit(0).cast(_RATIO_SIDE))
    return money(numerator.cast(_RATIO_SIDE) / divisor)


def monthly_amount(amount: Column, interval: Column) -> Column:
    """A recurring amount per month; annual plans count a twelfth."""
    return F.when(interval == "annual", money(amount / F.lit(12))).otherwise(money(amount))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")
