"""Medians of several columns in the same passes, and brackets cut down in cells."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import steps
from fathom.plans import ordering


@pytest.fixture(scope="module")
def wide(spark):
    number = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(9973)) / (i + 3) for i in range(10)]
    gaps = [F.when(F.col("id") % (i + 13) != 0, value).alias(f"c{i}") for i, value in enumerate(number)]
    return spark.range(20_000).select(F.when(F.col("id") % 11 != 0, F.col("id") % 4).alias("k"), *gaps).cache()


def jobs_of(spark, name, run):
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return out, len(context.statusTracker().getJobIdsForGroup(name))


def test_many_medians_cost_no_more_jobs_than_one(spark, wide):
    jobs = []
    for n in (1, 2, 10):
        asked = [{"function": "median", "column": f"c{i}", "alias": f"m{i}"} for i in range(n)]
        rows, used = jobs_of(spark, f"medians {n}", lambda: steps.group_aggregate(wide, ["k"], asked).collect())
        jobs.append(used)
        pdf = wide.toPandas()
        for row in rows:
            group = pdf[pdf["k"].isna()] if row["k"] is None else pdf[pdf["k"] == row["k"]]
            assert [row[f"m{i}"] for i in range(n)] == pytest.approx([group[f"c{i}"].median() for i in range(n)])
    assert max(jobs) - min(jobs) <= 1 and max(jobs) <= 20, jobs
    whole = steps.group_aggregate(wide, [], [{"function": "median", "column": "c1", "alias": "a"}, {"function": "median", "column": "c1", "alias": "b"}])
    assert whole.first()["a"] == whole.first()["b"] == pytest.approx(wide.toPandas()["c1"].median())


@pytest.mark.parametrize("range_rows", [3, 40, 700])
def test_brackets_are_cut_down_to_a_bounded_number_of_values(spark, wide, range_rows):
    counts = ordering.unpivoted(wide, ["k"], [F.col("c0"), F.col("c3")]).select(
        F.struct("k", "position").alias("key"), "value", F.lit(1).cast("long").alias("n")
    )
    probabilities = [0.0, 0.31, 0.5, 1.0]
    ends = F.array(*[F.lit(e) for _ in probabilities for e in (float("-inf"), float("inf"))])
    groups = counts.groupBy("key").agg(F.count(F.lit(1)).alias("total"), ends.alias("ends"))
    found = ordering.narrowed_quantiles(counts, groups, probabilities, range_rows=range_rows)
    got = {(row["key"]["k"], row["key"]["position"]): row["quantiles"] for row in found.collect()}
    pdf = wide.toPandas()
    for (k, position), values in got.items():
        group = pdf[pdf["k"].isna()] if k is None else pdf[pdf["k"] == k]
        column = group["c0" if position == 0 else "c3"].dropna()
        assert values == pytest.approx(list(np.quantile(column, probabilities)))
    assert len(got) == 10


def test_values_that_are_no_numbers_and_missed_brackets(spark):
    rows = [("a", float(v)) for v in ("nan", "nan", "1", "2", "-inf")] + [("b", 3.0)] * 5 + [("c", float("inf"))] * 2
    df = spark.createDataFrame(rows, "k string, v double")
    counts = df.select(F.struct("k").alias("key"), F.col("v").alias("value"), F.lit(1).cast("long").alias("n"))
    groups = counts.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.array(F.lit(3.0), F.lit(3.0)).alias("ends"))
    many = spark.range(9000).select(F.struct(F.lit("d").alias("k")).alias("key"), F.col("id").cast("double").alias("value"), F.lit(1).cast("long").alias("n"))
    counts = counts.unionByName(many)
    groups = groups.unionByName(many.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.array(F.lit(3.0), F.lit(3.0)).alias("ends")))
    got = {row["key"]["k"]: row["quantiles"][0] for row in ordering.narrowed_quantiles(counts, groups, [0.5]).collect()}
    assert got["a"] == 2.0 and got["b"] == 3.0 and got["d"] == 4499.5 and len(got) == 4
