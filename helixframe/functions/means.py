"""Means whose rounding does not depend on the order of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_mean(value: Column, places: int, change: Callable[[Column], Column] = lambda mean: mean) -> Column:
    """Aggregate: `change` of the mean as a double, rounded half up.

    Decimal fractions held as doubles are summed as decimals, so a tie is a tie in any order of the rows. Where a value does
    not come back from 18 decimal places unchanged, or their sum leaves a decimal, the plain mean is rounded.
    """
    plain = value.cast("double")
    exact = plain.try_cast("decimal(38,18)")
    unchanged = F.count(plain) == F.count_if(exact.cast("double") == plain)
    mean = F.when(unchanged, F.try_divide(F.try_sum(exact), F.count(plain)))
    return F.coalesce(F.round(change(mean), places).cast("double"), F.round(change(F.avg(plain)), places))
