from __future__ import annotations

from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from fathom.functions import casts
from fathom.operators import findings, profile


@pytest.fixture(scope="module")
def quality(spark):
    """Twelve readings: one repeated, one without depth, two far out, one constant column."""
    depths = [30, 31, 29, None, 30, 32, 28, 31, 30, 300, -250, -250]
    notes = ["1", "2", "calm", "4", "5", "rain", "7", "8", "9", "10", "11", "11"]
    days = [date(2024, 5, 3 + i) for i in range(11)] + [date(2024, 5, 13)]
    codes = [f"S{i:02d}" for i in range(11)] + ["S10"]
    rows = list(zip(codes, "abcabcabcabb", depths, ["buoy"] * 12, notes, days))
    return spark.createDataFrame(rows, "code string, site string, depth long, kind string, note string, day date")


def test_quality_of_a_small_table(quality):
    result = profile.profile_table(quality, profile.parse_failure_summary(reported=True, count=0))
    summary = result.dataset.first()
    assert summary["duplicate_row_count"] == 1
    assert summary["total_missing_values"] == 1
    assert summary["columns_with_missing_values"] == {"depth": 1}
    assert summary["constant_columns"] == ["kind"]
    assert summary["mixed_type_columns"] == ["note"]
    assert summary["numeric_outlier_columns"] == {"depth": 3}
    assert summary["parse_failures"]["reported"] and summary["parse_failures"]["count"] == 0
    assert tuple(summary["time_ranges"]["day"]) == ("2024-05-03", "2024-05-13")
    assert {
        "duplicate_rows_present",
        "constant_columns_present",
        "mixed_type_values_present",
        "numeric_outlier_candidates_present",
    } <= set(summary["warnings"])
    columns = {row["column"]: row for row in result.columns.collect()}
    assert columns["depth"]["outlier_count"] == 3
    assert columns["note"]["numeric_like_count"] == 10
    assert columns["day"]["datetime_like_count"] == 12
    assert {row["method"] for row in result.findings.collect()} == {
        "group_by_all_columns",
        "column_null_counts",
        "distinct_count_equals_one",
        "try_cast_number_and_time_counts",
        "iqr_1_5_full_scan",
    }


def test_roles_of_a_small_table(spark):
    df = spark.createDataFrame(
        [("p", "gull", 4, "seen", "hut"), ("q", "tern", None, "z" * 150, "hut"), ("r", "gull", 9, "seen", "boat"), ("s", "gull", 5, "heard", "boat"), ("t", "tern", 6, "seen", "hut")],
        "id string, category string, birds long, remark string, source string",
    )
    columns = {row["column"]: row for row in profile.column_profiles(df).collect()}
    kinds = {name: row["semantic_type"] for name, row in columns.items()}
    assert kinds["id"] == "identifier" and kinds["category"] == "primary_category" and kinds["birds"] == "numeric"
    assert kinds["remark"] == "long_text" and kinds["source"] == "source_reference"
    assert columns["birds"]["mean_value"] == 6.0 and columns["birds"]["median_value"] == 5.5
    assert columns["birds"]["warnings"] == ["missing_values"]
    assert columns["category"]["top_value_ratio"] == 0.6


def test_long_blank_texts_are_blank(spark):
    df = spark.createDataFrame([("a",), (" " * 40,), (" " * 70,), ("b",)], "t string")
    (row,) = profile.column_profiles(df).collect()
    assert row["non_empty_count"] == 2


def test_floats_are_measured_as_doubles_and_shown_as_floats(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.7,)], "f float")
    (row,) = profile.column_profiles(df).collect()
    want = df.selectExpr("percentile(cast(f AS double), 0.25)").first()[0]
    assert row["q1"] == want and row["distinct_count"] == 4
    assert [entry["value"] for entry in row["top_values"]] == ["0.1", "0.2", "0.3", "0.7"]


def test_top_values_of_long_texts_with_a_common_start(spark):
    start = "s" * 100
    texts = [start + f"{i:03d}" for i in range(40)] + [start + "007"] * 3 + ["short", "short"]
    df = spark.createDataFrame([(text,) for text in texts], "t string").repartition(6)
    (row,) = profile.column_profiles(df).collect()
    assert row["distinct_count"] == 41
    got = [(entry["value"], entry["count"]) for entry in row["top_values"]]
    assert got[:2] == [(start + "007", 4), ("short", 2)]
    assert got[2:] == [(start + f"{i:03d}", 1) for i in (0, 1, 2, 3, 4, 5, 6, 8)]
    assert row["max_text_length"] == 103


def test_a_heavy_value_and_every_type(spark):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, -0.0).when(F.col("id") % 3 == 1, 0.0).otherwise(F.col("id") * 1.0).alias("d"),
        F.col("id").cast("decimal(20,2)").alias("m"),
        (F.col("id") % 2 == 0).alias("b"),
        F.array("id", F.lit(1)).alias("a"),
        F.lit(None).cast("string").alias("nothing"),
    )
    columns = {row["column"]: row for row in profile.column_profiles(df).collect()}
    assert columns["d"]["distinct_count"] == 1001
    assert tuple(columns["d"]["top_values"][0]) == ("0.0", 2000)
    assert columns["m"]["median_value"] == 1499.5
    assert columns["b"]["semantic_type"] == "boolean"
    assert columns["a"]["distinct_count"] == 3000
    assert columns["nothing"]["null_count"] == 3000 and columns["nothing"]["top_values"] == []


def test_empty_table(spark):
    summary = profile.profile_table(spark.createDataFrame([], "a int, b string")).dataset.first()
    assert summary["row_count"] == 0 and summary["warnings"] == ["empty_table"]


def test_analysis_finds_trend_correlation_and_groups(spark):
    levels = [52, 47, 44, 38, 31, 30, 22, 19]
    rows = [(date(2023, 11, 2 + 3 * i), "upper" if i < 4 else "lower", v, 3 * v + (-1) ** i) for i, v in enumerate(levels)]
    df = spark.createDataFrame(rows, "taken date, gate string, level long, flow long")
    found = findings.analyze_table(df, profile.column_profiles(df)).orderBy("finding").collect()
    by_method = {}
    for row in found:
        by_method.setdefault(row["method"], []).append(row)
    assert {m: len(r) for m, r in by_method.items()} == {
        "time_number_correlation_and_slope": 2, "pearson_correlation": 1, "group_mean_difference": 2,
    }
    trend = next(r for r in by_method["time_number_correlation_and_slope"] if "level" in r["fields"])
    days = [3 * i for i in range(8)]
    mean = lambda xs: sum(xs) / len(xs)
    slope = sum((d - mean(days)) * (v - mean(levels)) for d, v in zip(days, levels)) / sum((d - mean(days)) ** 2 for d in days)
    assert float(trend["evidence"]["slope_per_day"]) == pytest.approx(slope, abs=1e-3)
    assert trend["evidence"]["row_count"] == "8" and float(trend["evidence"]["pearson_correlation"]) < -0.98
    (pair,) = by_method["pearson_correlation"]
    assert pair["fields"] == ["level", "flow"] and pair["warnings"] == ["correlation_not_causation"]
    for group in by_method["group_mean_difference"]:
        assert group["evidence"]["top_category"] == "upper" and group["evidence"]["bottom_category"] == "lower"


def test_constant_columns_have_no_correlation(spark):
    df = spark.range(10).select("id", F.lit(3).alias("c"))
    (row,) = findings.correlation_pairs(df, ["id", "c"]).collect()
    assert row["correlation"] is None and row["row_count"] == 10


def test_numbers_are_shown_without_exponents(spark):
    values = [1.0e7, 123456789.25, 1.5e-4, -2.0e15, 1.0e16, 0.1]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    (row,) = profile.column_profiles(df).collect()
    assert {entry["value"] for entry in row["top_values"]} == {
        "10000000.0", "123456789.25", "0.00015", "-2000000000000000.0", "1.0E16", "0.1",
    }


def test_many_pairs_match_few(spark):
    df = spark.range(500).select(
        *[
            F.when(F.col("id") % (i + 2) != 0, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(97)).cast("double")).alias(f"c{i}")
            for i in range(10)
        ]
    )
    names = df.columns
    many = {tuple(r)[:2]: tuple(r)[2:] for r in findings.correlation_pairs(df, names).collect()}
    assert len(many) == 45
    few = findings.correlation_pairs(df, names[:4]).collect()
    for row in few:
        n, r = many[row["left_column"], row["right_column"]]
        assert n == row["row_count"] and r == pytest.approx(row["correlation"])
    empty = findings.correlation_pairs(df.limit(0), names).collect()
    assert len(empty) == 45 and {row["row_count"] for row in empty} == {0}


def test_long_texts_that_begin_alike_are_narrowed(spark, monkeypatch):
    start, longer = "s" * 64, "s" * 900
    texts = [start, f"{start}b", f"{start}b", *[f"{longer}{i:05d}" for i in range(20_000)], *[f"{start}t{i}" for i in range(500)]]
    notes = [f"{start}{i % 15:03d}" if i % 3 else None for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(texts, notes)), "v string, w string").repartition(4)
    kept = []
    narrowed = profile._narrowed
    monkeypatch.setattr(profile, "_narrowed", lambda *args: kept.append(narrowed(*args)) or kept[-1])
    found = {r["column"]: r["top_values"] for r in profile.column_profiles(df).collect()}
    for name, values in (("v", texts), ("w", notes)):
        counted = Counter(v for v in values if v is not None)
        want = sorted(counted.items(), key=lambda e: (-e[1], e[0]))[: profile.TOP_VALUES]
        assert [(e["value"], e["count"]) for e in found[name]] == want
    (wanted,) = kept
    assert all(row["count"] <= 2 * profile.TOP_VALUES for row in wanted.groupBy("position").count().collect())


def test_text_keys_are_made_once_for_all_columns(spark):
    table = spark.createDataFrame([tuple("abcdefghij")], [f"c{i}" for i in range(10)])
    plan = profile.value_counts(table)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_first_letters_tell_no_number_apart(spark):
    signs, starts = ("", "+", "-", " \t-", "+ ", "\x00", "\u00a0", "_"), ("1", ".5", "1_0", "1e5", "0x1p3", "x1", "1d", "e5", ".", "")
    words = ("inf", "iNf", "Infinity", "infinityx", "NaN", "nan", "na", "\u0130nf", "1 2", "\u0661")
    texts = spark.createDataFrame([(s + t + e,) for s in signs for t in starts + words for e in ("", " ")], "text string")
    value = F.regexp_replace("text", "(?<=\\d)_(?=\\d)", "")
    plain = F.when(~value.rlike(casts.NUMBER_SUFFIX), value.try_cast("double"))
    assert texts.where(~casts.text_to_double(F.col("text")).eqNullSafe(plain)).count() == 0
