"""Aggregate expressions guarded for missing values and constant columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86400


def both_present(left: Column, right: Column) -> Column:
    return left.isNotNull() & right.isNotNull()


def pair_count(left: Column, right: Column) -> Column:
    return F.count_if(both_present(left, right))


def correlation(left: Column, right: Column) -> Column:
    """Pearson r over rows where both are present; null when either is constant."""
    x = F.when(right.isNotNull(), left.cast("double"))
    y = F.when(left.isNotNull(), right.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def slope(value: Column, position: Column) -> Column:
    """Least-squares slope of ``value`` over ``position``; null when the position is constant."""
    v = F.when(position.isNotNull(), value.cast("double"))
    p = F.when(value.isNotNull(), position.cast("double"))
    return F.try_divide(F.covar_pop(v, p), F.var_pop(p))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole <= 0, F.lit(0.0)).otherwise(
        F.try_divide(part.cast("double"), whole.cast("double"))
    )


def whole_division(left: Column, right: Column) -> Column:
    """Division of whole numbers that drops the remainder, exact for long values."""
    return F.call_function("div", left.cast("long"), right.cast("long"))


def division_up(left: Column, right: Column) -> Column:
    return whole_division(left.cast("long") + right.cast("long") - 1, right)


def epoch_seconds(time: Column) -> Column:
    """Seconds since 1970 with fractions. Needs the session time zone UTC for naive times."""
    return F.unix_micros(time.cast("timestamp")) / F.lit(1e6)
