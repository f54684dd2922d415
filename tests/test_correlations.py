"""Correlations of many columns with gaps against pandas."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from fathom.operators import findings


def test_wide_tables_with_gaps_match_pandas(spark):
    number = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(997)) / (i + 1) + F.col("id") * (i % 3) + 1e9 * (i % 2) for i in range(30)]
    df = spark.range(3000).repartition(7).select(*[F.when(F.col("id") % (i + 3) != 0, v).alias(f"c{i}") for i, v in enumerate(number)])
    want = df.toPandas()
    # Centred first, since the reference loses digits on large values.
    r, present = (want - want.mean()).corr(), want.notna().astype(int)
    got = findings.correlation_pairs(df, df.columns).collect()
    assert len(got) == 435
    for row in got:
        assert row["row_count"] == int((present[row["left_column"]] * present[row["right_column"]]).sum())
        assert row["correlation"] == pytest.approx(r.loc[row["left_column"], row["right_column"]], abs=1e-9)


def test_constant_missing_and_unbounded_values(spark):
    rows = [(float(i), 0.1, None if i % 2 else 0.7, math.nan if i == 3 else float(-i), math.inf if i == 4 else 1.0, None) for i in range(9)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    got = {(r["left_column"], r["right_column"]): (r["row_count"], r["correlation"]) for r in findings.correlation_pairs(df, df.columns).collect()}
    assert got["a", "b"] == (9, None) and got["a", "c"] == (5, None) and got["a", "f"] == (0, None)
    assert math.isnan(got["a", "d"][1]) and math.isnan(got["a", "e"][1]) and got["a", "d"][0] == 9
    # The odd value of d is where c is missing.
    assert got["c", "d"] == (5, None)
    assert findings.correlation_pairs(df.limit(0), ["a", "b"]).collect()[0]["row_count"] == 0
    assert findings.correlation_pairs(df, ["a"]).count() == 0


def test_the_shuffle_holds_one_row_a_pair_and_task(spark):
    df = spark.range(0, 50_000, 1, 4).select(*[(F.col("id") * (i + 1) % 101).alias(f"c{i}") for i in range(5)])
    sums = findings._pair_sums(df, df.columns)
    assert sums.count() == 10
    assert sums._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_wide_projections_run_on_methods_the_jvm_compiles(spark, monkeypatch):
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before, pair_sums = spark.conf.get(name), findings._pair_sums

    def watched(df, columns):
        sums = pair_sums(df, columns)
        plain = type(sums.write).parquet
        monkeypatch.setattr(type(sums.write), "parquet", lambda self, path: (seen.append(int(spark.conf.get(name))), plain(self, path))[1])
        return sums

    monkeypatch.setattr(findings, "_pair_sums", watched)
    df = spark.range(100).select(*[(F.col("id") * (i + 1) % 7).alias(f"c{i}") for i in range(60)])
    assert findings.correlation_pairs(df, df.columns).count() == 1770
    assert seen and max(seen) <= 8000
    assert spark.conf.get(name) == before
