from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathom.operators import reduce


def test_top_categories_and_the_rest(spark, rows):
    df = spark.createDataFrame(
        [("oak", 3), ("oak", 5), ("elm", 1), ("elm", 2), ("elm", 6), ("ash", 4), ("fir", 9), ("yew", None), (None, 8)],
        "tree string, height long",
    )
    result = reduce.category_means(df, "tree", "height", limit=2)
    assert rows(result.rows) == [("elm", 3.0, 3), ("oak", 4.0, 2), ("Other", 6.5, 2)]
    meta = result.metadata.first()
    assert (meta["original_rows"], meta["rendered_rows"]) == (7, 3)
    assert meta["method"] == "top_n_with_other" and meta["approximate"] is False


def test_a_limit_never_exceeds_the_default(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("c"), F.col("id").alias("v"))
    assert reduce.category_counts(df, "c", limit=400).rows.count() == reduce.CATEGORIES + 1
    assert reduce.box_quantiles(df, "c", "v", limit=400).rows.count() == reduce.CATEGORIES


def test_a_real_category_named_other_joins_the_rest(spark, rows):
    df = spark.createDataFrame([("Other",)] * 3 + [("A",)] * 2 + [("B",)], "c string")
    assert rows(reduce.category_counts(df, "c", limit=2).rows) == [("A", 2), ("Other", 4)]


def test_series_fits_or_is_averaged(spark):
    df = spark.range(50).select(
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 25).cast("int")).alias("day"),
        F.col("id").alias("value"),
    )
    few = reduce.time_series(df, "day", "value", target_points=10)
    meta = few.metadata.first()
    assert meta["rendered_rows"] == 10 and meta["original_rows"] == 50 and meta["approximate"]
    assert few.rows.agg(F.sum("source_count")).first()[0] == 50
    raw = reduce.time_series(df, "day", "value")
    assert raw.metadata.first()["method"] == "raw_time_series" and raw.rows.count() == 50


def test_points_are_sampled_evenly(spark, rows):
    df = spark.range(25).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    result = reduce.scatter_sample(df, "x", "y", target_points=5)
    assert rows(result.rows) == [(float(i), 2.0 * i) for i in range(0, 25, 5)]
    assert result.metadata.first()["original_rows"] == 25


def test_bins_and_grid(spark):
    df = spark.range(40).select(F.col("id").alias("x"), (F.col("id") % 7).alias("y"))
    bins = reduce.histogram(df, "x", bins=5).rows.collect()
    assert [row["source_count"] for row in bins] == [8] * 5
    assert bins[0]["bin_start"] == 0.0 and bins[-1]["bin_end"] == 39.0
    cells = reduce.density(df, "x", "y", x_bins=4, y_bins=3).rows
    assert cells.count() <= 12 and cells.agg(F.sum("source_count")).first()[0] == 40


def test_constant_and_empty_histogram(spark, rows):
    flat = spark.range(5).select(F.lit(2.0).alias("v"))
    assert rows(reduce.histogram(flat, "v").rows) == [(2.0, 2.0, 5)]
    assert rows(reduce.histogram(flat.limit(0), "v").rows) == []


def test_boxes_and_matrix(spark):
    df = spark.createDataFrame(
        [("A", 1, 2, 9), ("A", 2, 4, 7), ("A", 3, 6, 5), ("B", 4, 8, 3), ("B", 5, 10, 2), ("B", 6, 12, 1), ("C", 7, 14, 0)],
        "category string, a long, b long, c long",
    )
    boxes = reduce.box_quantiles(df, "category", "a", limit=2)
    assert [tuple(row) for row in boxes.rows.collect()] == [
        ("A", 1.0, 1.5, 2.0, 2.5, 3.0, 3),
        ("B", 4.0, 4.5, 5.0, 5.5, 6.0, 3),
    ]
    meta = boxes.metadata.first()
    assert meta["parameters"]["omitted_rows"] == "1" and meta["approximate"]
    matrix = reduce.correlation_matrix(df, ["a", "b", "c"]).rows.collect()
    values = {(row["x"], row["y"]): row["value"] for row in matrix}
    assert len(values) == 9 and values["a", "a"] == 1.0 and values["a", "b"] == pytest.approx(1.0)
    assert all(values[x, y] == values[y, x] for x, y in values)


def test_grid_fills_missing_counts(spark, rows):
    long = spark.createDataFrame([("a", "p", 1), ("b", "q", 2)], "x string, y string, source_count long")
    assert sorted(rows(reduce.grid(long))) == [("p", 1, 0), ("q", 0, 2)]
    assert sorted(rows(reduce.grid(long, missing=None))) == [("p", 1, None), ("q", None, 2)]


def test_budgets():
    assert reduce.budget(30, 12, at_most_default=True) == 12
    assert reduce.budget(30, 100, at_most_default=True) == 30
    assert reduce.budget(20_000, 50_000) == 50_000
    assert reduce.budget(20_000, None) == reduce.budget(20_000, 0) == 20_000


def test_crosstab_keeps_the_total(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("x"),
        (F.col("id") % 17).cast("string").alias("y"),
    )
    result = reduce.crosstab(df, "x", "y", x_limit=4, y_limit=3).rows
    assert result.count() <= 20 and result.agg(F.sum("source_count")).first()[0] == 1000


def test_grids_refuse_too_many_columns(spark, monkeypatch):
    monkeypatch.setattr(reduce, "GRID_COLUMNS", 3)
    long = spark.range(4).select(F.col("id").alias("x"), F.lit("a").alias("y"), F.lit(1).alias("source_count"))
    assert reduce.grid(long.where("x < 3")).columns == ["y", "0", "1", "2"]
    with pytest.raises(ValueError, match="at most 3 columns"):
        reduce.grid(long)
