"""Leading groups and the remainder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER_LABEL = "Other"


def leading(grouped: DataFrame, label: str, limit: int, size: str = "source_count") -> DataFrame:
    """The ``limit`` largest labels of counted rows, ties by name. At most ``limit`` rows."""
    return (
        grouped.groupBy(label)
        .agg(F.sum(size).alias(size))
        .orderBy(F.desc(size), F.asc(label))
        .limit(limit)
        .select(label)
    )


def with_remainder(
    grouped: DataFrame,
    label: str,
    limit: int,
    *,
    size: str = "source_count",
    other: str = OTHER_LABEL,
) -> DataFrame:
    """Rename every label outside the ``limit`` largest to ``other``; one row per label.

    The kept labels are at most ``limit`` rows, so broadcasting them is bounded.
    Ordering by all columns keeps both uses of ``grouped`` alike, so that Spark
    aggregates once and reuses the exchange.
    """
    rest = [F.asc(name) for name in grouped.columns if name not in (label, size)]
    kept = grouped.orderBy(F.desc(size), F.asc(label), *rest).limit(limit)
    named = kept.select(F.col(label).alias("_kept"))
    return (
        grouped.join(F.broadcast(named), F.col(label) == F.col("_kept"), "left")
        .withColumn(label, F.coalesce("_kept", F.lit(other)))
        .drop("_kept")
    )


def remainder_last(label: str, *, size: str = "source_count", other: str = OTHER_LABEL) -> list[Column]:
    return [
        F.when(F.col(label) == other, 1).otherwise(0).asc(),
        F.desc(size),
        F.asc(label),
    ]
