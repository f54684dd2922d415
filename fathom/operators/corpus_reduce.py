"""Reductions of a corpus to result sets small enough to plot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.corpus import category_label, with_category_names
from fathom.operators.corpus_profile import distinct_keywords, keyword_hits, tag_pairs
from fathom.operators.reduce import (
    AXIS_CATEGORIES,
    CATEGORIES,
    Reduced,
    budget,
    crosstab_of_pairs,
    describe,
    sum_with_remainder,
)
from fathom.plans.parallel import spread_small

# How many keywords and tags a result may have.
KEYWORDS = 30
TAGS = 30
UNCATEGORISED_LABEL = "Uncategorised"
NO_SOURCE_LABEL = "No source"


def _all_rows(records: DataFrame) -> Column:
    return records.agg(F.count(F.lit(1))).scalar()


def _describe(rows: DataFrame, records: DataFrame, method: str, approximate: object = False, **parameters: object) -> DataFrame:
    """Metadata with the size of the corpus looked up next to the small result."""
    meta = describe(rows, method, original=F.lit(0).cast("long"), **parameters)
    flag = approximate if isinstance(approximate, Column) else F.lit(approximate)
    return meta.withColumns({"original_rows": _all_rows(records), "approximate": flag})


def _labelled_counts(
    records: DataFrame, categories: DataFrame, uncategorized: str, *also: Column
) -> DataFrame:
    """Counts per category label; names are looked up for counted ids, not for records."""
    grouped = records.groupBy("primary_category_id", *also).agg(
        F.count(F.lit(1)).alias("source_count")
    )
    return with_category_names(grouped, categories).withColumn("label", category_label(uncategorized))


def category_chart(
    records: DataFrame,
    categories: DataFrame,
    *,
    limit: int = CATEGORIES,
    uncategorized: str = UNCATEGORISED_LABEL,
) -> Reduced:
    limit = budget(CATEGORIES, limit, at_most_default=True)
    counts = _labelled_counts(records, categories, uncategorized)
    by_label = counts.groupBy("label").agg(F.sum("source_count").alias("source_count"))
    rows = sum_with_remainder(by_label, "label", limit).withColumnRenamed("label", "x")
    meta = _describe(rows, records, "text_category_counts_top_n", limit=limit, other_label="Other")
    return Reduced(rows, meta)


def classification_chart(
    records: DataFrame, *, categorized: str = "Categorised", uncategorized: str = UNCATEGORISED_LABEL
) -> Reduced:
    """Always two rows: records with and without a category."""
    has = F.col("primary_category_id").isNotNull()
    counts = records.agg(F.count_if(has).alias("yes"), F.count_if(~has).alias("no"))
    rows = counts.select(
        F.inline(
            F.array(
                F.struct(F.lit(categorized).alias("x"), F.col("yes").alias("source_count")),
                F.struct(F.lit(uncategorized).alias("x"), F.col("no").alias("source_count")),
            )
        )
    )
    return Reduced(rows, describe(rows, "text_classification_status_counts"))


def source_category_chart(
    records: DataFrame,
    categories: DataFrame,
    *,
    x_limit: int = AXIS_CATEGORIES,
    y_limit: int = AXIS_CATEGORIES,
    uncategorized: str = UNCATEGORISED_LABEL,
    no_source: str = NO_SOURCE_LABEL,
) -> Reduced:
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit(no_source)).alias("x")
    counts = _labelled_counts(records, categories, uncategorized, source)
    pairs = counts.groupBy("x", F.col("label").alias("y")).agg(F.sum("source_count").alias("source_count"))
    rows = crosstab_of_pairs(pairs, x_limit, y_limit)
    meta = describe(
        rows, "text_source_category_crosstab", x_limit=x_limit, y_limit=y_limit, other_label="Other"
    )
    return Reduced(rows, meta)


def _keyword_rows(records: DataFrame, words: Sequence[str]) -> DataFrame:
    texts = spread_small(records.select("primary_category_id", "content"))
    return keyword_hits(texts.select("primary_category_id", F.lower("content").alias("folded")), words, str.lower)


def keyword_chart(records: DataFrame, keywords: Sequence[str], *, limit: int = KEYWORDS) -> Reduced:
    """Records per keyword for the first ``limit`` keywords; zero counts stay."""
    words = distinct_keywords(keywords)
    used = words[: max(limit, 0)]
    spark = records.sparkSession
    listed = spark.createDataFrame([(word,) for word in used], "x string")
    counts = _keyword_rows(records, used or [""]).groupBy(F.col("keyword").alias("x")).agg(
        F.count(F.lit(1)).alias("source_count")
    )
    rows = (
        listed.join(counts, "x", "left")
        .select("x", F.coalesce("source_count", F.lit(0)).alias("source_count"))
        .orderBy(F.desc("source_count"), "x")
    )
    meta = _describe(
        rows, records, "text_keyword_counts", len(used) < len(words), keywords=", ".join(used), limit=limit
    )
    return Reduced(rows, meta)


def category_keyword_chart(
    records: DataFrame,
    categories: DataFrame,
    keywords: Sequence[str],
    *,
    keyword_limit: int = KEYWORDS,
    category_limit: int = AXIS_CATEGORIES,
    uncategorized: str = UNCATEGORISED_LABEL,
) -> Reduced:
    """Per keyword the largest categories and one count for the others."""
    words = distinct_keywords(keywords)
    used = words[: max(keyword_limit, 0)]
    matches = _keyword_rows(records, used or [""])
    counts = _labelled_counts(matches, categories, uncategorized, F.col("keyword"))
    grouped = counts.groupBy("keyword", "label").agg(F.sum("source_count").alias("source_count"))
    order = Window.partitionBy("keyword").orderBy(F.desc("source_count"), "label")
    ranked = grouped.withColumn("place", F.row_number().over(order))
    label = F.when(F.col("place") <= category_limit, F.col("label")).otherwise(F.lit("Other"))
    keyword_place = F.array_position(F.array(*[F.lit(word) for word in used or [""]]), F.col("x"))
    rows = (
        ranked.groupBy(F.col("keyword").alias("x"), label.alias("y"))
        .agg(F.sum("source_count").alias("source_count"))
        .orderBy(keyword_place, F.desc("source_count"), "y")
    )
    meta = _describe(
        rows,
        records,
        "text_category_keyword_counts",
        len(used) < len(words),
        keywords=", ".join(used),
        keyword_limit=keyword_limit,
        category_limit=category_limit,
        other_label="Other",
    )
    return Reduced(rows, meta)


def tag_matrix(records: DataFrame, *, tag_limit: int = TAGS) -> Reduced:
    """Co-occurrence of the most frequent tags, mirrored, with records per tag on the diagonal."""
    tagged = records.select(F.explode(F.array_distinct("tags")).alias("tag"))
    counts = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("source_count"))
    # At most ``tag_limit`` tags, one array.
    top = counts.orderBy(F.desc("source_count"), "tag").limit(tag_limit)
    kept = F.coalesce(top.agg(F.collect_set("tag")).scalar(), F.array().cast("array<string>"))
    among = records.select(F.array_intersect("tags", kept).alias("tags"))
    pairs = (
        among.where(F.size("tags") > 1)
        .select(F.inline(tag_pairs(F.col("tags"))))
        .groupBy("left_tag", "right_tag")
        .agg(F.count(F.lit(1)).alias("source_count"))
    )
    mirrored = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("left_tag").alias("x"), F.col("right_tag").alias("y"), "source_count"),
                F.struct(F.col("right_tag").alias("x"), F.col("left_tag").alias("y"), "source_count"),
            )
        )
    )
    diagonal = top.select(F.col("tag").alias("x"), F.col("tag").alias("y"), "source_count")
    rows = diagonal.unionByName(mirrored)
    more = counts.agg(F.count(F.lit(1)) > F.lit(tag_limit)).scalar()
    meta = _describe(rows, records, "text_tag_cooccurrence_counts", more, tag_limit=tag_limit)
    return Reduced(rows, meta)
