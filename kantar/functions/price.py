"""The three rules for the price that counts. They differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _valid(discounted: Column, start: Column, end: Column, day: Column) -> Column:
    return discounted.isNotNull() & (start.isNull() | (start <= day)) & (end.isNull() | (end >= day))


def at_own_date(regular: Column, discounted: Column, start: Column, end: Column, price_date: Column) -> Column:
    """The discount if valid on the day of the price, else the regular price, else the discount."""
    return F.coalesce(F.when(_valid(discounted, start, end, price_date), discounted), regular, discounted)


def as_of(regular: Column, discounted: Column, start: Column, end: Column, day: Column) -> Column:
    """The discount if valid on ``day``, else the regular price, else none."""
    return F.coalesce(F.when(_valid(discounted, start, end, day), discounted), regular)


def naive(regular: Column, discounted: Column) -> Column:
    """The discount whatever its dates, else the regular price."""
    return F.coalesce(discounted, regular)


def line_total(price: Column, quantity: Column) -> Column:
    """Rounded half up to two places."""
    return F.round(price * quantity, 2).cast("decimal(18,2)")
