"""Reductions of tables to result sets small enough to plot.

Every function returns the small rows and a one-row description of the
reduction. Rows with a missing value in a used column are left out first.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.statistics import division_up
from fathom.operators.findings import correlation_pairs
from fathom.plans.keys import ref
from fathom.plans.ordering import (
    RANGE_ROWS,
    bucket_means,
    counted,
    every_nth,
    positions,
    quantiles,
)
from fathom.plans.shares import leading, remainder_last, with_remainder

# How many rows a result may have.
LINE_POINTS = 20_000
SCATTER_POINTS = 50_000
CATEGORIES = 30
BINS = 30
DENSITY_BINS = 50
AXIS_CATEGORIES = 15
GRID_COLUMNS = 1_000


class Reduced(NamedTuple):
    rows: DataFrame
    metadata: DataFrame


def budget(default: int, target_points: int | None = None, *, at_most_default: bool = False) -> int:
    """A requested number of points, or the default; categories never exceed theirs."""
    if target_points is None or target_points <= 0:
        return default
    return min(target_points, default) if at_most_default else target_points


def describe(
    rows: DataFrame,
    method: str,
    *,
    original: Column | None = None,
    approximate: bool | Column = False,
    **parameters: object,
) -> DataFrame:
    """One row: rows before and after, method, parameters, approximate or not.

    By default the rows before are the summed ``source_count`` of the result.
    """
    before = F.coalesce(F.sum("source_count"), F.lit(0)) if original is None else original
    pairs = [part for name, value in parameters.items() for part in (F.lit(name), F.lit(str(value)))]
    return rows.agg(
        before.alias("original_rows"),
        F.count(F.lit(1)).alias("rendered_rows"),
    ).select(
        "original_rows",
        "rendered_rows",
        F.lit(method).alias("method"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("parameters"),
        (approximate if isinstance(approximate, Column) else F.lit(approximate)).alias("approximate"),
    )


def _present(df: DataFrame, **columns: Column) -> DataFrame:
    chosen = df.select(*[column.alias(name) for name, column in columns.items()])
    filled = [F.col(name).isNotNull() for name in columns]
    return chosen.where(functools.reduce(operator.and_, filled))


def time_series(
    df: DataFrame,
    time: str,
    number: str,
    *,
    target_points: int | None = None,
    range_rows: int = RANGE_ROWS,
) -> Reduced:
    """All points by time when they fit, else means over even runs of rows."""
    target = budget(LINE_POINTS, target_points)
    used = _present(df, x=ref(time).cast("timestamp_ntz"), y=ref(number).cast("double"))
    parameters = {"time_column": time, "numeric_column": number, "target_points": target}
    total = used.count()
    if total <= max(target, 1):
        rows = used.withColumn("source_count", F.lit(1).cast("long")).orderBy("x", "y")
        return Reduced(rows, describe(rows, "raw_time_series", **parameters))
    ranked = positions(counted(used, "x", "y"), "x", "y", range_rows=range_rows)
    rows = (
        bucket_means(ranked, "x", "y", target, F.lit(total))
        .orderBy("bucket")
        .select("x", "y", "source_count")
    )
    return Reduced(rows, describe(rows, "time_window_mean", approximate=True, **parameters))


def scatter_sample(
    df: DataFrame,
    x: str,
    y: str,
    *,
    target_points: int | None = None,
    range_rows: int = RANGE_ROWS,
) -> Reduced:
    """All points when they fit, else every n-th point in (x, y) order."""
    target = budget(SCATTER_POINTS, target_points)
    used = _present(df, x=ref(x).cast("double"), y=ref(y).cast("double"))
    parameters = {"x_column": x, "y_column": y, "target_points": target}
    total = used.count()
    before = F.lit(total)
    if total <= max(target, 1):
        rows = used.orderBy("x", "y")
        return Reduced(rows, describe(rows, "raw_scatter", original=before, **parameters))
    ranked = positions(counted(used, "x", "y"), "x", "y", range_rows=range_rows)
    step = division_up(F.lit(total), F.lit(target))
    rows = every_nth(ranked, ["x", "y"], step).orderBy("at").limit(target).select("x", "y")
    meta = describe(rows, "uniform_sample", original=before, approximate=True, **parameters)
    return Reduced(rows, meta)


def category_means(
    df: DataFrame, category: str, number: str, *, limit: int = CATEGORIES
) -> Reduced:
    """Mean per category for the largest categories and one for all others."""
    limit = budget(CATEGORIES, limit, at_most_default=True)
    used = _present(df, category=ref(category).cast("string"), number=ref(number).cast("double"))
    grouped = used.groupBy("category").agg(
        F.sum("number").alias("total"), F.count(F.lit(1)).alias("source_count")
    )
    rows = (
        with_remainder(grouped, "category", limit)
        .groupBy("category")
        .agg(
            (F.sum("total") / F.sum("source_count")).alias("value"),
            F.sum("source_count").alias("source_count"),
        )
        .orderBy(*remainder_last("category"))
    )
    meta = describe(
        rows,
        "top_n_with_other",
        category_column=category,
        numeric_column=number,
        limit=limit,
        aggregation="weighted_mean",
        other_label="Other",
    )
    return Reduced(rows, meta)


def category_counts(df: DataFrame, category: str, *, limit: int = CATEGORIES) -> Reduced:
    """Rows per category for the largest categories and one count for all others."""
    limit = budget(CATEGORIES, limit, at_most_default=True)
    used = _present(df, category=ref(category).cast("string"))
    rows = top_counts(used, "category", limit)
    meta = describe(
        rows,
        "top_n_with_other",
        category_column=category,
        limit=limit,
        aggregation="count",
        other_label="Other",
    )
    return Reduced(rows, meta)


def top_counts(labelled: DataFrame, label: str, limit: int) -> DataFrame:
    grouped = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("source_count"))
    return sum_with_remainder(grouped, label, limit)


def sum_with_remainder(grouped: DataFrame, label: str, limit: int) -> DataFrame:
    return (
        with_remainder(grouped, label, limit)
        .groupBy(label)
        .agg(F.sum("source_count").alias("source_count"))
        .orderBy(*remainder_last(label))
    )


def _range(used: DataFrame, *names: str) -> Column:
    """Lowest and highest value of each column as a one-row scalar subquery."""
    ends = [end.alias(f"{kind}_{name}") for name in names for kind, end in (("min", F.min(name)), ("max", F.max(name)))]
    return used.agg(F.struct(*ends).alias("ends")).scalar()


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of the even bin from 0 to ``bins`` - 1; 0 when all values are equal."""
    raw = F.floor(F.try_divide(value - low, high - low) * bins)
    return F.when(high == low, F.lit(0).cast("long")).otherwise(
        F.least(F.lit(bins - 1).cast("long"), F.greatest(F.lit(0).cast("long"), raw))
    )


def histogram(df: DataFrame, number: str, *, bins: int = BINS) -> Reduced:
    """Counts in even bins between the lowest and the highest value; empty bins are absent."""
    used = _present(df, value=ref(number).cast("double"))
    ranged = used.withColumn("ends", _range(used, "value"))
    low, high = F.col("ends.min_value"), F.col("ends.max_value")
    index = F.col("bin")
    rows = (
        ranged.groupBy(_bin(F.col("value"), low, high, bins).alias("bin"), "ends")
        .agg(F.count(F.lit(1)).alias("source_count"))
        .orderBy("bin")
        .select(
            (low + (high - low) * index / bins).alias("bin_start"),
            (low + (high - low) * (index + 1) / bins).alias("bin_end"),
            "source_count",
        )
    )
    return Reduced(rows, describe(rows, "histogram_bins", numeric_column=number, bins=bins))


def density(
    df: DataFrame, x: str, y: str, *, x_bins: int = DENSITY_BINS, y_bins: int = DENSITY_BINS
) -> Reduced:
    """Counts on an even grid at cell centres; empty cells are absent."""
    used = _present(df, x=ref(x).cast("double"), y=ref(y).cast("double"))
    ranged = used.withColumn("ends", _range(used, "x", "y"))
    low_x, high_x, low_y, high_y = (
        F.col(f"ends.{name}") for name in ("min_x", "max_x", "min_y", "max_y")
    )
    rows = (
        ranged.groupBy(
            _bin(F.col("x"), low_x, high_x, x_bins).alias("x_bin"),
            _bin(F.col("y"), low_y, high_y, y_bins).alias("y_bin"),
            "ends",
        )
        .agg(F.count(F.lit(1)).alias("source_count"))
        .orderBy("y_bin", "x_bin")
        .select(
            (low_x + (high_x - low_x) * (F.col("x_bin") + 0.5) / x_bins).alias("x"),
            (low_y + (high_y - low_y) * (F.col("y_bin") + 0.5) / y_bins).alias("y"),
            "source_count",
        )
    )
    meta = describe(
        rows,
        "density_2d_bins",
        approximate=True,
        x_column=x,
        y_column=y,
        x_bins=x_bins,
        y_bins=y_bins,
    )
    return Reduced(rows, meta)


def crosstab(
    df: DataFrame,
    x: str,
    y: str,
    *,
    x_limit: int = AXIS_CATEGORIES,
    y_limit: int = AXIS_CATEGORIES,
) -> Reduced:
    """Counts per pair of labels; labels beyond the largest of each axis become one."""
    x_limit = budget(AXIS_CATEGORIES, x_limit, at_most_default=True)
    y_limit = budget(AXIS_CATEGORIES, y_limit, at_most_default=True)
    used = _present(df, x=ref(x).cast("string"), y=ref(y).cast("string"))
    pairs = used.groupBy("x", "y").agg(F.count(F.lit(1)).alias("source_count"))
    rows = crosstab_of_pairs(pairs, x_limit, y_limit)
    meta = describe(
        rows,
        "categorical_top_n_crosstab",
        x_column=x,
        y_column=y,
        x_limit=x_limit,
        y_limit=y_limit,
        other_label="Other",
    )
    return Reduced(rows, meta)


def crosstab_of_pairs(pairs: DataFrame, x_limit: int, y_limit: int) -> DataFrame:
    """Fold the small labels of both axes; works on counted pairs, not on rows."""
    kept_x = leading(pairs, "x", x_limit).withColumnRenamed("x", "kept_x")
    kept_y = leading(pairs, "y", y_limit).withColumnRenamed("y", "kept_y")
    # At most x_limit and y_limit rows.
    folded = pairs.join(F.broadcast(kept_x), F.col("x") == F.col("kept_x"), "left").join(
        F.broadcast(kept_y), F.col("y") == F.col("kept_y"), "left"
    )
    return (
        folded.groupBy(
            F.coalesce("kept_x", F.lit("Other")).alias("x"),
            F.coalesce("kept_y", F.lit("Other")).alias("y"),
        )
        .agg(F.sum("source_count").alias("source_count"))
        .orderBy(F.desc("source_count"), "x", "y")
    )


def box_quantiles(
    df: DataFrame,
    category: str,
    number: str,
    *,
    limit: int = CATEGORIES,
    range_rows: int = RANGE_ROWS,
) -> Reduced:
    """Range, quartiles and count of the largest categories; the others are counted as omitted."""
    limit = budget(CATEGORIES, limit, at_most_default=True)
    used = _present(df, category=ref(category).cast("string"), value=ref(number).cast("double"))
    grouped = used.groupBy("category").agg(
        F.min("value").alias("lower_fence"),
        F.max("value").alias("upper_fence"),
        F.count(F.lit(1)).alias("source_count"),
    )
    # At most ``limit`` rows.
    kept = grouped.orderBy(F.desc("source_count"), "category").limit(limit)
    chosen = used.join(F.broadcast(kept.select("category")), "category", "left_semi")
    quartiles = quantiles(
        chosen, ["category"], "value", [0.25, 0.5, 0.75], range_rows=range_rows
    )
    rows = (
        kept.join(quartiles, "category")
        .select(
            "category",
            "lower_fence",
            F.col("quantiles")[0].alias("q1"),
            F.col("quantiles")[1].alias("median"),
            F.col("quantiles")[2].alias("q3"),
            "upper_fence",
            "source_count",
        )
        .orderBy(F.desc("source_count"), "category")
    )
    shown = kept.agg(
        F.coalesce(F.sum("source_count"), F.lit(0)).alias("shown"),
        F.count(F.lit(1)).alias("rendered_rows"),
    )
    total = used.agg(F.count(F.lit(1)).alias("n")).scalar()
    meta = shown.withColumn("original_rows", total).select(
        "original_rows",
        "rendered_rows",
        F.lit("box_quantiles_top_n").alias("method"),
        F.create_map(
            F.lit("category_column"),
            F.lit(category),
            F.lit("numeric_column"),
            F.lit(number),
            F.lit("limit"),
            F.lit(str(limit)),
            F.lit("omitted_rows"),
            (F.col("original_rows") - F.col("shown")).cast("string"),
        ).alias("parameters"),
        (F.col("shown") < F.col("original_rows")).alias("approximate"),
    )
    return Reduced(rows, meta)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> Reduced:
    """Pearson r of every ordered pair with its row count; the upper triangle is computed once."""
    if len(columns) < 2:
        raise ValueError("A correlation matrix needs two columns.")
    own = [F.count(F.lit(1)).alias("rows")]
    own += [F.count(ref(name)).alias(f"n_{i}") for i, name in enumerate(columns)]
    summed = df.agg(*own)
    diagonal = summed.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("x"),
                        F.lit(name).alias("y"),
                        F.when(F.col(f"n_{i}") > 0, F.lit(1.0)).alias("value"),
                        F.col(f"n_{i}").alias("source_count"),
                    )
                    for i, name in enumerate(columns)
                ]
            )
        )
    )

    def side(x: str, y: str) -> Column:
        return F.struct(
            F.col(x).alias("x"),
            F.col(y).alias("y"),
            F.col("correlation").alias("value"),
            F.col("row_count").alias("source_count"),
        )

    both = F.inline(F.array(side("left_column", "right_column"), side("right_column", "left_column")))
    rows = diagonal.unionByName(correlation_pairs(df, columns).select(both))
    meta = summed.select(
        F.col("rows").alias("original_rows"),
        F.lit(len(columns) ** 2).cast("long").alias("rendered_rows"),
        F.lit("pearson_correlation_matrix").alias("method"),
        F.create_map(F.lit("fields"), F.lit(", ".join(columns))).alias("parameters"),
        F.lit(False).alias("approximate"),
    )
    return Reduced(rows, meta)


def grid(
    rows: DataFrame,
    x: str = "x",
    y: str = "y",
    value: str = "source_count",
    *,
    missing: float | None = 0,
) -> DataFrame:
    """Pivot a reduced long result: one row per y, one column per x.

    The x labels of a reduced result are few; they are read once to fix the columns, and
    more than ``GRID_COLUMNS`` are refused.
    """
    labels = [row[0] for row in rows.select(x).distinct().orderBy(x).limit(GRID_COLUMNS + 1).collect()]
    if len(labels) > GRID_COLUMNS:
        raise ValueError(f"A grid has at most {GRID_COLUMNS} columns; reduce the values of {x} first.")
    wide = rows.groupBy(y).pivot(x, labels).agg(F.first(value))
    return wide if missing is None else wide.fillna(missing, subset=[str(label) for label in labels])
