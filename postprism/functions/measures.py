"""Money, shares and order keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(pay: Column | str) -> Column:
    """Decimal pay as whole cents, so that sums and medians are exact in any order of evaluation.

    A bigint sum of cents holds 9.2e16 currency units; ANSI mode raises rather than wraps beyond.
    """
    column = F.col(pay) if isinstance(pay, str) else pay
    return (column * 100).cast("bigint")


def money(cent_value: Column) -> Column:
    """Cents back to currency units as a double."""
    return cent_value.cast("double") / 100


def mean_money(cent_sum: Column, n: Column) -> Column:
    """Exact mean of cents in currency units; NULL when there is nothing to average."""
    return F.try_divide(cent_sum.cast("double"), n.cast("double")) / 100


def share_pct(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal; NULL for an empty whole."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole.cast("double")), 1)


def ratio_pct(part: Column, whole: Column) -> Column:
    """Share in whole percent; NULL for an empty whole."""
    return F.round(F.try_divide(F.lit(100.0) * part, whole.cast("double")), 0)
