from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.plans import ordering


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; another group is continuous."""
    return (
        spark.range(30_000)
        .select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise("wide").alias("k"),
            F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(7919)) / 7).alias("v"),
        )
        .cache()
    )


@pytest.mark.parametrize("range_rows", [50, 15_000, 1_000_000])
def test_quantiles_match_numpy(skewed, range_rows):
    probabilities = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = ordering.quantiles(skewed, ["k"], "v", probabilities, range_rows=range_rows)
    got = {row["k"]: row["quantiles"] for row in found.collect()}
    pdf = skewed.toPandas()
    for key, group in pdf.groupby("k"):
        assert got[key] == pytest.approx(list(np.quantile(group["v"], probabilities)))


def test_spread_quantiles_match_numpy(skewed):
    counts = skewed.select(F.struct("k").alias("key"), F.col("v").alias("value"))
    found = ordering.spread_quantiles(ordering.counted(counts, "key", "value"), [0.1, 0.5])
    got = {row["key"]["k"]: row["quantiles"] for row in found.collect()}
    for key, group in skewed.toPandas().groupby("k"):
        assert got[key] == pytest.approx(list(np.quantile(group["v"], [0.1, 0.5])))


def test_a_bracket_that_misses_is_noticed(skewed):
    counts = skewed.select(
        F.struct("k").alias("key"), F.col("v").alias("value"), F.lit(1).cast("long").alias("n")
    )
    groups = counts.groupBy("key").agg(
        F.count(F.lit(1)).alias("total"), F.array(F.lit(-2.0), F.lit(-1.0)).alias("ends")
    )
    found = ordering.narrowed_quantiles(counts, groups, [0.5])
    got = {row["key"]["k"]: row["quantiles"] for row in found.collect()}
    for key, group in skewed.toPandas().groupby("k"):
        assert got[key] == pytest.approx([np.quantile(group["v"], 0.5)])


@pytest.mark.parametrize("range_rows", [50, 1_000_000])
def test_positions_are_those_of_the_sorted_rows(skewed, range_rows):
    counts = ordering.counted(skewed, "k", "v")
    got = ordering.positions(counts, "k", "v", range_rows=range_rows).toPandas()
    got = got.sort_values("before")
    assert list(got["before"]) == [0, *np.cumsum(got["n"])[:-1]]
    assert got["n"].sum() == 30_000
    assert got[["k", "v"]].apply(tuple, axis=1).is_monotonic_increasing


@pytest.mark.parametrize("range_rows", [50, 1_000_000])
@pytest.mark.parametrize("buckets", [1, 7, 1000])
def test_even_runs_split_heavy_rows(skewed, range_rows, buckets):
    ranked = ordering.positions(
        ordering.counted(skewed, "k", "v"), "k", "v", range_rows=range_rows
    )
    got = ordering.bucket_means(ranked, "k", "v", buckets, F.lit(30_000)).toPandas().sort_values("bucket")
    pdf = skewed.toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    pdf["bucket"] = pdf.index * buckets // len(pdf)
    want = pdf.groupby("bucket").agg(k=("k", "min"), v=("v", "mean"), n=("v", "size"))
    assert list(got["source_count"]) == list(want["n"])
    assert list(got["k"]) == list(want["k"])
    assert np.allclose(got["v"], want["v"])


@pytest.mark.parametrize("range_rows", [50, 1_000_000])
def test_every_nth_row_in_order(skewed, range_rows):
    ranked = ordering.positions(
        ordering.counted(skewed, "k", "v"), "k", "v", range_rows=range_rows
    )
    got = ordering.every_nth(ranked, ["k", "v"], F.lit(7)).toPandas().sort_values("at")
    want = skewed.toPandas().sort_values(["k", "v"]).iloc[::7]
    assert list(got["at"]) == list(range(0, 30_000, 7))
    assert list(got["v"]) == list(want["v"])


@pytest.mark.parametrize(("limit", "offset"), [(7, 0), (7, 1), (40, 93), (500, 130), (5, 200), (5, 900), (0, 5)])
def test_pages_are_slices_of_the_sorted_rows(spark, limit, offset):
    df = spark.range(200).select(
        F.when(F.col("id") % 9 != 0, F.col("id") % 13).alias("k"), F.col("id"), F.lit("x").alias("other")
    ).repartition(7)
    whole = sorted(([tuple(r) for r in df.collect()]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = [tuple(r) for r in ordering.page_rows(df, ["k", "id"], limit, offset).collect()]
    assert got == whole[offset : offset + limit]
