"""Shapes of physical plans that must hold at any size."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from fathom.operators import corpus_profile, corpus_reduce, findings, profile, reduce, steps
from fathom.plans import corpus_queries, ordering, storage

FOLDER = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_filters_and_columns_reach_the_scan(table):
    chosen = steps.apply_steps(
        table("orders"),
        [
            lambda df: steps.filter_rows(df, {"column": "o_totalprice", "op": ">", "value": 1000}),
            lambda df: steps.select_columns(df, [{"source": "o_orderkey", "alias": "id"}]),
        ],
    )
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,1000.0)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_top_categories_scan_and_aggregate_once(table):
    plan = executed(reduce.category_means(table("part"), "p_brand", "p_retailprice", limit=5).rows)
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize(
    "build",
    [
        lambda t: reduce.histogram(t("lineitem"), "l_quantity").rows,
        lambda t: reduce.density(t("lineitem"), "l_quantity", "l_tax").rows,
        lambda t: reduce.crosstab(t("part"), "p_brand", "p_type").rows,
        lambda t: reduce.box_quantiles(t("part"), "p_brand", "p_size").rows,
        lambda t: findings.group_differences(t("lineitem"), ["l_returnflag"], ["l_tax"]),
        lambda t: steps.group_aggregate(
            t("orders"), ["o_orderstatus"], [{"function": "median", "column": "o_totalprice", "alias": "m"}]
        ),
    ],
)
def test_no_cross_joins(table, build):
    plan = executed(build(table))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_corpus_operators_use_no_cross_joins(spark):
    records = corpus_queries.records_of(spark, FOLDER)
    categories = corpus_queries.categories_of(spark, FOLDER)
    for df in (
        corpus_profile.listed_copies(records, categories, corpus_profile.copy_groups(records)),
        corpus_profile.keyword_category_counts(records, categories, ["a"]),
        corpus_profile.similar_labels(categories),
        corpus_reduce.source_category_chart(records, categories).rows,
        corpus_reduce.tag_matrix(records).rows,
    ):
        plan = executed(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_the_spread_order_gathers_no_rows_in_one_task(table):
    counts = ordering.counted(table("events"), "ts", "value")
    plan = executed(ordering.spread_positions(counts, 5_000_000, "ts", "value"))
    assert "SinglePartition" not in plan and "Window" not in plan


def test_token_counting_stays_in_the_jvm(spark):
    plan = executed(corpus_profile.frequent_tokens(corpus_queries.records_of(spark, FOLDER)))
    assert "Python" not in plan and "TakeOrderedAndProject" in plan


def test_intermediate_tables_lie_in_the_named_folder(spark):
    path = storage.scratch_path(spark, "x")
    assert path.startswith(storage.shared_folder(spark)) and path != storage.scratch_path(spark, "x")
    kept = storage.materialise(spark.range(5).withColumn("x", F.rand(1)), "x")
    assert kept.collect() == kept.collect()


def test_a_profile_leaves_only_its_results_behind(spark, table):
    place = storage.mark()
    result = profile.profile_table(table("orders"))
    assert len(storage._written[place:]) == 2
    assert result.columns.count() == 6 and result.dataset.count() == 1
    storage.discard_since(spark, place)
    assert len(storage._written) == place


def test_threads_do_not_delete_each_others_tables(spark):
    place = storage.mark()
    mine = storage.materialise(spark.range(3), "mine")

    def other():
        start = storage.mark()
        kept, gone = (storage.materialise(spark.range(n), "other") for n in (4, 5))
        storage.discard_since(spark, start, kept)
        return kept, gone

    with ThreadPoolExecutor(1) as pool:
        kept, gone = pool.submit(other).result()
    assert mine.count() == 3 and kept.count() == 4
    storage.discard_since(spark, place)
    assert kept.count() == 4
    for lost in (mine, gone):
        with pytest.raises(Exception, match="exist"):
            lost.count()
