"""Statistical findings: trends, correlations, differences between groups."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions.statistics import (
    SECONDS_PER_DAY,
    both_present,
    correlation,
    epoch_seconds,
    pair_count,
    slope,
)
from fathom.operators.profile import finding
from fathom.plans.keys import ref
from fathom.plans.storage import materialise

MIN_ROWS = 3
STRONG_CORRELATION = 0.7
STRONG_TREND = 0.6
MAX_FINDINGS = 8
MAX_CATEGORIES = 30
MIN_GROUP_ROWS = 2


def _one_row_per(df: DataFrame, aggregates: list[Column], entries: list[Column]) -> DataFrame:
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


# Sums of a pair of columns over the rows in which both are present.
_SUMS = ("n", "x", "y", "xx", "yy", "xy", "unbounded")
# A variance below this share of the mean square is rounding: the column is constant.
_ROUNDING = 1e-13
_FIRST_ROWS = 100


def _pair_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a pair ``i < j``: the sums of values, squares and products, in one scan.

    Tasks multiply batches of rows as matrices, values and their presence apart, and send one row
    a pair, so the shuffle does not grow with the rows. A value of each column is the origin of its
    sums, which keeps squares small; infinite values and those that are no numbers are counted aside.
    """
    values = df.select(*[ref(name).cast("double").alias(f"v{i}") for i, name in enumerate(columns)])
    origin = np.array(_origins(values))
    lefts, rights = np.triu_indices(len(columns), 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, total = len(columns), None
        for batch in batches:
            # One row a column: values, their squares and, apart, their presence.
            both = np.empty((2 * wide, batch.num_rows))
            there = np.ones((wide, batch.num_rows))
            x, square = both[:wide], both[wide:]
            for i, c in enumerate(batch.columns):
                x[i] = np.asarray(c.fill_null(origin[i]) if c.null_count else c)
                if c.null_count:
                    there[i] = np.asarray(c.is_valid())
            finite = np.isfinite(x)
            bounded = finite.all()
            if not bounded:
                np.copyto(x, np.broadcast_to(origin[:, None], x.shape), where=~finite)
            x -= origin[:, None]
            np.multiply(x, x, out=square)
            sides = both @ there.T
            shifted, squares = sides[:wide], sides[wide:]
            unbounded = np.zeros((wide, wide)) if bounded else (~finite).astype(np.float64) @ there.T
            found = np.stack(
                [there @ there.T, shifted, shifted.T, squares, squares.T, x @ x.T, unbounded + unbounded.T]
            )[:, lefts, rights]
            total = found if total is None else total + found
        if total is not None:
            arrays = [pa.array(lefts, pa.int32()), pa.array(rights, pa.int32()), *[pa.array(t) for t in total]]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", *_SUMS])

    listed = values.mapInArrow(sums, "i int, j int, " + ", ".join(f"{name} double" for name in _SUMS))
    return listed.groupBy("i", "j").agg(*[F.sum(name).alias(name) for name in _SUMS])


def _origins(values: DataFrame) -> list[float]:
    """A finite value of every column: from the first rows, or from all if they have none."""
    found: dict[str, float] = {}
    for row in values.head(_FIRST_ROWS):
        for name, value in row.asDict().items():
            if value is not None and math.isfinite(value):
                found.setdefault(name, value)
    missing = [name for name in values.columns if name not in found]
    if missing:
        finite = {name: F.when(F.abs(name) < math.inf, F.col(name)) for name in missing}
        row = values.agg(*[F.first(value, ignorenulls=True).alias(name) for name, value in finite.items()]).first()
        found |= {name: row[name] or 0.0 for name in missing}
    return [found[name] for name in values.columns]


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r and pair count for every pair of columns, in one scan for any number of columns."""
    pairs = list(combinations(range(len(columns)), 2))
    named = [(i, j, columns[i], columns[j]) for i, j in pairs]
    listed = df.sparkSession.createDataFrame(
        named, "i int, j int, left_column string, right_column string"
    )
    if not pairs:
        nothing = F.lit(None)
        return listed.select(
            "left_column", "right_column", nothing.cast("long").alias("row_count"), nothing.cast("double").alias("correlation")
        )

    def variance(total: str, squares: str) -> Column:
        mean, square = F.col(total) / F.col("n"), F.col(squares) / F.col("n")
        return F.when(square - mean * mean > square * _ROUNDING, square - mean * mean).otherwise(0.0)

    shared = F.col("xy") / F.col("n") - F.col("x") / F.col("n") * (F.col("y") / F.col("n"))
    r = F.try_divide(shared, F.sqrt(variance("x", "xx")) * F.sqrt(variance("y", "yy")))
    # Written here, one row a pair, so that the scan runs on code the JVM compiles.
    sums = materialise(_pair_sums(df, columns), "pairs")
    found = sums.where("n > 0").select(
        "i", "j", F.col("n").cast("long").alias("row_count"), F.when(F.col("unbounded") > 0, math.nan).otherwise(r).alias("correlation")
    )
    return listed.join(found, ["i", "j"], "left").select(
        "left_column",
        "right_column",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        "correlation",
    )


def trend_statistics(
    df: DataFrame, time_columns: Sequence[str], numeric_columns: Sequence[str]
) -> DataFrame:
    """Correlation with time, slope per day, first and last value of every pair, in one pass.

    Among equal times the smallest value comes first and the largest last.
    """
    aggregates, entries = [], []
    pairs = [(time, number) for time in time_columns for number in numeric_columns]
    for index, (time, number) in enumerate(pairs):
        stamp, value = ref(time).cast("timestamp_ntz"), ref(number).cast("double")
        seconds = epoch_seconds(stamp)
        used = both_present(stamp, value)
        order = F.when(used, F.struct(stamp.alias("time"), value.alias("value")))
        aggregates += [
            pair_count(stamp, value).alias(f"n_{index}"),
            correlation(seconds, value).alias(f"r_{index}"),
            (slope(value, seconds) * SECONDS_PER_DAY).alias(f"slope_{index}"),
            F.min(order).alias(f"first_{index}"),
            F.max(order).alias(f"last_{index}"),
        ]
        entries.append(
            F.struct(
                F.lit(time).alias("time_column"),
                F.lit(number).alias("numeric_column"),
                F.col(f"n_{index}").alias("row_count"),
                F.col(f"r_{index}").alias("correlation"),
                F.col(f"slope_{index}").alias("slope_per_day"),
                F.col(f"first_{index}.time").alias("first_time"),
                F.col(f"last_{index}.time").alias("last_time"),
                F.col(f"first_{index}.value").alias("first_value"),
                F.col(f"last_{index}.value").alias("last_value"),
            )
        )
    return _one_row_per(df, aggregates, entries)


def first_last_by_time(df: DataFrame, time: str, value: str) -> DataFrame:
    """The earliest and the latest value with their times; ties go to the value."""
    return trend_statistics(df, [time], [value]).select(
        "first_time", "first_value", "last_time", "last_value"
    )


def group_differences(
    df: DataFrame,
    category_columns: Sequence[str],
    numeric_columns: Sequence[str],
    *,
    min_group_rows: int = MIN_GROUP_ROWS,
) -> DataFrame:
    """Highest against lowest group mean for every category and number column.

    The rows are spread once over the category columns and summed on the map
    side; every number column rides along in the same aggregate.
    """
    labels = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("category_column"), ref(name).cast("string").alias("category"))
                for name in category_columns
            ]
        )
    )
    numbers = {f"v_{i}": ref(name).cast("double") for i, name in enumerate(numeric_columns)}
    spread = df.select(*[value.alias(alias) for alias, value in numbers.items()], labels)
    grouped = (
        spread.where(F.col("category").isNotNull())
        .groupBy("category_column", "category")
        .agg(
            *[F.avg(alias).alias(f"mean_{alias}") for alias in numbers],
            *[F.count(alias).alias(f"rows_{alias}") for alias in numbers],
        )
    )
    means = grouped.select(
        "category_column",
        "category",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("numeric_column"),
                        F.col(f"mean_{alias}").alias("mean"),
                        F.col(f"rows_{alias}").alias("rows"),
                    )
                    for name, alias in zip(numeric_columns, numbers)
                ]
            )
        ),
    ).where(F.col("rows") >= min_group_rows)
    # Mean first; among equal means the earlier name is on top, the later at the bottom.
    group = F.struct("category", "mean", "rows")
    top = F.min_by(group, F.struct((-F.col("mean")).alias("down"), F.col("category")))
    bottom = F.max_by(group, F.struct((-F.col("mean")).alias("down"), F.col("category")))
    compared = (
        means.groupBy("category_column", "numeric_column")
        .agg(
            F.sum("rows").alias("row_count"),
            F.count(F.lit(1)).alias("category_count"),
            top.alias("top"),
            bottom.alias("bottom"),
        )
        .where(F.col("category_count") >= 2)
    )
    top_mean, bottom_mean = F.col("top.mean"), F.col("bottom.mean")
    return compared.select(
        "category_column",
        "numeric_column",
        "row_count",
        "category_count",
        F.col("top.category").alias("top_category"),
        top_mean.alias("top_mean"),
        F.col("top.rows").alias("top_count"),
        F.col("bottom.category").alias("bottom_category"),
        bottom_mean.alias("bottom_mean"),
        F.col("bottom.rows").alias("bottom_count"),
        (top_mean - bottom_mean).alias("mean_difference"),
        F.try_divide(top_mean, bottom_mean).alias("mean_ratio"),
    )


def _ordinal(name: str, names: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(name))


def _six(name: str) -> Column:
    return F.round(name, 6)


def _strongest(candidates: DataFrame, measure: str, ties: list[Column], limit: int) -> DataFrame:
    """The ``limit`` rows with the largest rounded measure; ties in column order."""
    order = [F.desc(F.abs(_six(measure))), *ties]
    return (
        candidates.orderBy(*order)
        .limit(limit)
        .withColumn("place", F.row_number().over(Window.orderBy(*order)))
    )


def trend_findings(
    df: DataFrame,
    time_columns: Sequence[str],
    numeric_columns: Sequence[str],
    *,
    min_rows: int = MIN_ROWS,
    threshold: float = STRONG_TREND,
    limit: int = 2,
) -> DataFrame:
    kept = trend_statistics(df, time_columns, numeric_columns).where(
        (F.col("row_count") >= min_rows) & (F.abs("correlation") >= threshold)
    )
    ties = [_ordinal("time_column", time_columns), _ordinal("numeric_column", numeric_columns)]
    return _strongest(kept, "correlation", ties, limit)


def correlation_findings(
    df: DataFrame,
    numeric_columns: Sequence[str],
    *,
    min_rows: int = MIN_ROWS,
    threshold: float = STRONG_CORRELATION,
    limit: int = 2,
) -> DataFrame:
    kept = correlation_pairs(df, numeric_columns).where(
        (F.col("row_count") >= min_rows) & (F.abs("correlation") >= threshold)
    )
    ties = [_ordinal("left_column", numeric_columns), _ordinal("right_column", numeric_columns)]
    return _strongest(kept, "correlation", ties, limit)


def group_difference_findings(
    df: DataFrame,
    category_columns: Sequence[str],
    numeric_columns: Sequence[str],
    *,
    min_rows: int = MIN_ROWS,
    limit: int = 4,
) -> DataFrame:
    """``category_columns`` are those with at most 30 values, as the profile tells."""
    kept = group_differences(df, category_columns, numeric_columns).where(
        (F.col("row_count") >= min_rows) & (F.col("mean_difference") != 0)
    )
    ties = [
        _ordinal("category_column", category_columns),
        _ordinal("numeric_column", numeric_columns),
    ]
    return _strongest(kept, "mean_difference", ties, limit)


def _rounded(*names: str) -> dict[str, Column]:
    return {name: _six(name) for name in names}


def _as_findings(rows: DataFrame, kind: int, entry: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), "place", F.inline(F.array(entry)))


def _columns(*names: str) -> dict[str, Column]:
    return {name: F.col(name) for name in names}


def analyze_table(
    df: DataFrame, profile_columns: DataFrame, *, max_findings: int = MAX_FINDINGS
) -> DataFrame:
    """Trends, then correlations, then group differences; or one finding that there is too little.

    Reads the roles of the columns (one row per column) to choose what to compare.
    """
    roles = profile_columns.select(
        "position", "column", "semantic_type", "distinct_count", "row_count", "warnings"
    ).collect()
    usable = [row for row in sorted(roles) if "constant_column" not in row["warnings"]]

    def of(*kinds: str) -> list[str]:
        return [row["column"] for row in usable if row["semantic_type"] in kinds]

    numbers, times = of("numeric"), of("datetime")
    grouping = of("categorical", "primary_category", "source_reference")
    distinct = {row["column"]: row["distinct_count"] for row in usable}
    few = [name for name in grouping if distinct[name] <= MAX_CATEGORIES]
    parts = []
    if times and numbers:
        rows = trend_findings(df, times, numbers)
        rising = F.when(F.coalesce("slope_per_day", F.lit(0.0)) >= 0, "rises").otherwise("falls")
        entry = finding(
            "time_number_correlation_and_slope",
            F.concat("numeric_column", F.lit(" "), rising, F.lit(" with "), "time_column", F.lit(".")),
            {
                **_columns("row_count", "time_column", "numeric_column"),
                "pearson_correlation": _six("correlation"),
                **_rounded("slope_per_day"),
                **_columns("first_time", "last_time", "first_value", "last_value"),
            },
            F.array("time_column", "numeric_column"),
            ("correlation_not_causation",),
        )
        parts.append(_as_findings(rows, 0, entry))
    if len(numbers) > 1:
        rows = correlation_findings(df, numbers)
        sign = F.when(F.col("correlation") >= 0, "positive").otherwise("negative")
        entry = finding(
            "pearson_correlation",
            F.concat(
                "left_column", F.lit(" and "), "right_column", F.lit(" show a strong "), sign, F.lit(" correlation.")
            ),
            {
                **_columns("row_count", "left_column", "right_column"),
                "pearson_correlation": _six("correlation"),
            },
            F.array("left_column", "right_column"),
            ("correlation_not_causation",),
        )
        parts.append(_as_findings(rows, 1, entry))
    if few and numbers:
        rows = group_difference_findings(df, few, numbers)
        entry = finding(
            "group_mean_difference",
            F.concat(F.lit("The mean of "), "numeric_column", F.lit(" differs between groups of "), "category_column", F.lit(".")),
            {
                **_columns("row_count", "category_count", "category_column", "numeric_column"),
                **_columns("top_category", "top_count", "bottom_category", "bottom_count"),
                **_rounded("top_mean", "bottom_mean", "mean_difference", "mean_ratio"),
            },
            F.array("category_column", "numeric_column"),
            ("group_difference_not_causation",),
        )
        parts.append(_as_findings(rows, 2, entry))
    found = None
    for part in parts:
        found = part if found is None else found.unionByName(part)

    def names(values: list[str]) -> Column:
        return F.lit(", ".join(values))

    too_little = finding(
        "field_screening",
        F.lit("The columns do not support a trend, correlation or group difference."),
        {
            "row_count": F.lit(max((row["row_count"] for row in roles), default=0)),
            "numeric_columns": names(numbers),
            "datetime_columns": names(times),
            "category_columns": names(grouping),
        },
        F.array().cast("array<string>"),
        ("insufficient_structured_evidence",),
    )
    fallback = _as_findings(df.sparkSession.range(1).withColumn("place", F.lit(1)), 3, too_little)
    found = fallback if found is None else found.unionByName(fallback)
    # At most nine rows: order them, and keep the fallback only when it is alone.
    numbered = found.withColumn(
        "finding", F.row_number().over(Window.orderBy("kind", "place"))
    )
    return numbered.where(
        ((F.col("kind") < 3) & (F.col("finding") <= max_findings))
        | ((F.col("kind") == 3) & (F.col("finding") == 1))
    ).drop("kind", "place")
