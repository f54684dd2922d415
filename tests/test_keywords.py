"""Many keywords in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.operators import corpus_profile


def test_overlapping_folded_and_missing_keywords(spark):
    rows = [("k", "Straße STRASSE abcabc"), ("k", "ab"), (None, "bc abc"), ("", None), ("m", "")]
    records = spark.createDataFrame(rows, "primary_category_id string, content string")
    words = ["abc", "bc", "ABC", "strasse", "Straße", "b", " ", "none", "abc"]
    got = {(r["primary_category_id"], r["keyword"]): r["record_count"] for r in corpus_profile.keyword_matches(records, words).collect()}
    assert got == {
        ("k", "abc"): 1, ("k", "bc"): 1, ("k", "ABC"): 1, ("k", "strasse"): 1, ("k", "Straße"): 1, ("k", "b"): 2,
        (None, "abc"): 1, (None, "bc"): 1, (None, "ABC"): 1, (None, "b"): 1,
    }
    counts = [(r["keyword"], r["record_count"]) for r in corpus_profile.keyword_record_counts(records, words).collect()]
    assert counts == [("abc", 2), ("bc", 2), ("ABC", 2), ("strasse", 1), ("Straße", 1), ("b", 3), ("none", 0)]


def test_thousands_of_keywords_add_no_columns_to_the_plan(spark):
    records = spark.range(50).select(F.lit("k").alias("primary_category_id"), F.concat(F.lit("word"), "id", F.lit(";")).alias("content"))
    matches = corpus_profile.keyword_matches(records, [f"word{i};" for i in range(5000)])
    assert matches.count() == 50
    assert len(matches._jdf.queryExecution().executedPlan().toString()) < 20_000
