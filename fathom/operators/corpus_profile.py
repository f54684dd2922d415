"""Profile of a text corpus: quality, lengths, copies, labels, keywords, tokens, tags."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import text as tx
from fathom.functions.statistics import ratio
from fathom.operators.corpus import UNCATEGORIZED, category_label, with_category_names
from fathom.operators.profile import finding
from fathom.plans.ordering import positions
from fathom.plans.parallel import spread_small
from fathom.plans.storage import materialise

# Lengths that count as short and long, and list sizes.
SHORT_CHARS = 5
LONG_CHARS = 500
TOP_TOKENS = 20
TOP_COPIES = 20
LISTED_IDS = 20
TOP_LABEL_PAIRS = 10
SIMILARITY = 0.88
# Records with more tags than this are paired block by block.
TAG_BLOCK = 256


class CorpusProfile(NamedTuple):
    """One row per field, one row for the corpus, one row per finding."""

    columns: DataFrame
    dataset: DataFrame
    findings: DataFrame


# Columns of record_facts that stand for the content.
FACTS = ("_content_length", "_content_digest")


def _length(records: DataFrame) -> Column:
    return F.col(FACTS[0]) if FACTS[0] in records.columns else F.length(tx.strip(F.col("content")))


def _digest(records: DataFrame) -> Column:
    return F.col(FACTS[1]) if FACTS[1] in records.columns else F.sha2("content", 256)


def record_facts(records: DataFrame) -> DataFrame:
    """Records with length and digest of the content in its place, written once.

    Counts of lengths, copies, tags and sources read these short rows; the contents, and
    whatever ``records`` is made of, are gone through once for all of them.
    """
    kept = ["id", "created_at", "primary_category_id", "tags", "source"]
    values = (_length(records), _digest(records))
    return materialise(records.select(*kept, *[v.alias(name) for v, name in zip(values, FACTS)]), "facts")


def _no_source() -> Column:
    return tx.strip(F.coalesce("source", F.lit(""))) == ""


def record_quality(
    records: DataFrame, *, short_chars: int = SHORT_CHARS, long_chars: int = LONG_CHARS
) -> DataFrame:
    """Counts of empty, short, long, uncategorised and sourceless records in one pass."""
    length = _length(records)
    return records.agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(length == 0).alias("empty_record_count"),
        F.count_if((length > 0) & (length <= short_chars)).alias("short_record_count"),
        F.count_if(length >= long_chars).alias("long_record_count"),
        F.count_if(F.coalesce("primary_category_id", F.lit("")) == "").alias("uncategorized_count"),
        F.count_if(_no_source()).alias("missing_source_count"),
    ).withColumn("missing_source_ratio", ratio(F.col("missing_source_count"), F.col("record_count")))


def length_counts(records: DataFrame) -> DataFrame:
    """Records per trimmed length: one short row per length."""
    return records.groupBy(_length(records).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def length_summary(records: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, median and nearest-rank 90th percentile of the lengths."""
    counts = materialise(length_counts(records), "lengths")
    ranked = positions(counts, "length")
    total = counts.agg(F.sum("n")).scalar()

    def at(rank: Column) -> Column:
        holds = (F.col("before") <= rank) & (rank < F.col("before") + F.col("n"))
        return ranked.where(holds).agg(F.min("length")).scalar()

    # Half-way ranks of the percentile go to the even one.
    middle = (at(F.floor((total - 1) / 2)) + at(F.ceil((total - 1) / 2))) / 2
    p90 = at(F.rint((total - 1) * 0.9))
    return counts.agg(
        F.coalesce(F.min("length"), F.lit(0)).alias("min_length"),
        F.coalesce(F.max("length"), F.lit(0)).alias("max_length"),
        F.coalesce(F.sum(F.col("length") * F.col("n")) / F.sum("n"), F.lit(0.0)).alias("mean_length"),
    ).withColumns(
        {
            "median_length": F.coalesce(middle, F.lit(0.0)),
            "p90_length": F.coalesce(p90, F.lit(0)),
        }
    )


def copy_groups(records: DataFrame) -> DataFrame:
    """Contents that occur more than once: digest, records, categories involved.

    Records meet per digest and category on the map side, so a text copied a
    billion times is a row per task.
    """
    category = F.coalesce(F.nullif("primary_category_id", F.lit("")), F.lit(UNCATEGORIZED))
    per_category = records.groupBy(
        _digest(records).alias("digest"), category.alias("category_id")
    ).agg(F.count(F.lit(1)).alias("n"))
    return (
        per_category.groupBy("digest")
        .agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("category_count"))
        .where(F.col("count") > 1)
    )


def copy_counts(groups: DataFrame) -> DataFrame:
    """Surplus records over all groups, not only the listed ones, and conflicting groups."""
    return groups.agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("exact_duplicate_record_count"),
        F.count(F.lit(1)).alias("duplicate_group_count"),
        F.count_if(F.col("category_count") > 1).alias("category_conflict_count"),
    )


def listed_copies(
    records: DataFrame,
    categories: DataFrame,
    groups: DataFrame,
    *,
    conflicts_only: bool = False,
    limit: int = TOP_COPIES,
    uncategorized: str = "Uncategorised",
) -> DataFrame:
    """The largest groups with their first record ids and their categories."""
    chosen = groups.where(F.col("category_count") > 1) if conflicts_only else groups
    order = [F.desc("count"), F.asc("content_hash")]
    top = (
        chosen.withColumn("content_hash", F.substring("digest", 1, 16)).orderBy(*order).limit(limit)
    )
    # At most ``limit`` digests.
    members = records.select(
        _digest(records).alias("digest"), "id", "created_at", "primary_category_id"
    ).join(F.broadcast(top.select("digest")), "digest", "left_semi")
    place = F.row_number().over(Window.partitionBy("digest").orderBy("created_at", "id"))
    first_ids = (
        members.withColumn("place", place)
        .where(F.col("place") <= LISTED_IDS)
        .groupBy("digest")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", "id"))), lambda entry: entry["id"]
            ).alias("record_ids")
        )
    )
    used = members.select("digest", F.nullif("primary_category_id", F.lit("")).alias("primary_category_id"))
    labelled = with_category_names(used.distinct(), categories).select(
        "digest",
        F.coalesce("primary_category_id", F.lit(UNCATEGORIZED)).alias("category_id"),
        category_label(uncategorized).alias("name"),
    )
    labels = labelled.groupBy("digest").agg(
        F.array_sort(F.collect_list(F.struct("category_id", "name"))).alias("labels")
    )
    return (
        top.join(first_ids, "digest")
        .join(labels, "digest")
        .select(
            "content_hash",
            "count",
            "record_ids",
            F.transform("labels", lambda entry: entry["category_id"]).alias("category_ids"),
            F.transform("labels", lambda entry: entry["name"]).alias("category_names"),
        )
        .orderBy(*order)
    )


def category_counts(
    records: DataFrame, categories: DataFrame, *, uncategorized: str = "Uncategorised"
) -> DataFrame:
    grouped = records.groupBy(
        F.nullif("primary_category_id", F.lit("")).alias("primary_category_id")
    ).agg(F.count(F.lit(1)).alias("count"))
    return (
        with_category_names(grouped, categories)
        .select(
            F.col("primary_category_id").alias("category_id"),
            category_label(uncategorized).alias("name"),
            "count",
        )
        .orderBy(F.desc("count"), F.coalesce("category_id", F.lit(UNCATEGORIZED)))
    )


def tag_counts(records: DataFrame) -> DataFrame:
    tags = records.select(F.explode("tags").alias("tag")).where(tx.strip(F.col("tag")) != "")
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "tag")


def source_counts(records: DataFrame) -> DataFrame:
    named = records.select(tx.strip(F.col("source")).alias("source")).where(F.col("source") != "")
    return named.groupBy("source").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "source")


def distinct_keywords(keywords: Sequence[str]) -> list[str]:
    return list(dict.fromkeys(word.strip() for word in keywords if word.strip()))


def keyword_hits(texts: DataFrame, keywords: Sequence[str], fold: Callable[[str], str]) -> DataFrame:
    """primary_category_id and keyword of every record, each keyword once that its ``folded`` text contains.

    Each task builds one automaton of all keywords, so a text is read once whatever their number.
    """
    by_form: dict[str, list[str]] = {}
    for word in keywords:
        by_form.setdefault(fold(word), []).append(word)
    everywhere = by_form.pop("", [])

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for form, words in by_form.items():
            automaton.add_word(form, words)
        automaton.make_automaton()
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text is None:
                    continue
                words = {id(words): words for _, words in automaton.iter(text)} if by_form else {}
                hits = [word for same in words.values() for word in same] + everywhere
                rows += [row] * len(hits)
                found += hits
            owners = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([owners, pa.array(found, pa.string())], names=["primary_category_id", "keyword"])

    return texts.select("primary_category_id", "folded").mapInArrow(matches, "primary_category_id string, keyword string")


def keyword_matches(records: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Records per category and keyword, in one pass over the texts."""
    words = distinct_keywords(keywords)
    if not words:
        raise ValueError("keyword_matches needs keywords.")
    texts = spread_small(records.select("primary_category_id", "content"))
    folded = texts.select(
        F.nullif("primary_category_id", F.lit("")).alias("primary_category_id"), tx.casefold(F.col("content")).alias("folded")
    )
    hits = keyword_hits(folded, words, str.casefold)
    return hits.groupBy("primary_category_id", "keyword").agg(F.count(F.lit(1)).alias("record_count"))


def keyword_record_counts(records: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Records per keyword in the given order; keywords without a match stay with zero."""
    words = distinct_keywords(keywords)
    listed = records.sparkSession.createDataFrame(list(enumerate(words)), "place int, keyword string")
    found = keyword_matches(records, words).groupBy("keyword").agg(
        F.sum("record_count").alias("record_count")
    )
    return (
        listed.join(found, "keyword", "left")
        .orderBy("place")
        .select("keyword", F.coalesce("record_count", F.lit(0)).alias("record_count"))
    )


def keyword_category_counts(
    records: DataFrame,
    categories: DataFrame,
    keywords: Sequence[str],
    *,
    uncategorized: str = "Uncategorised",
) -> DataFrame:
    counted = with_category_names(keyword_matches(records, keywords), categories)
    return counted.select(
        F.col("primary_category_id").alias("category_id"),
        category_label(uncategorized).alias("name"),
        "keyword",
        "record_count",
    ).orderBy(
        F.coalesce("category_id", F.lit(UNCATEGORIZED)), F.desc("record_count"), "keyword"
    )


def token_counts(records: DataFrame) -> DataFrame:
    texts = spread_small(records.select("content"))
    tokens = texts.select(F.explode(tx.tokens(F.col("content"))).alias("token"))
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("count"))


def frequent_tokens(records: DataFrame, *, limit: int = TOP_TOKENS) -> DataFrame:
    return token_counts(records).orderBy(F.desc("count"), "token").limit(max(limit, 0))


def tag_pairs(tags: Column) -> Column:
    """Unordered pairs of the distinct trimmed tags of one record."""
    ordered = F.sort_array(tx.clean_tags(tags))
    return F.flatten(
        F.transform(
            ordered,
            lambda left, i: F.transform(
                F.slice(ordered, i + 2, F.size(ordered)),
                lambda right: F.struct(left.alias("left_tag"), right.alias("right_tag")),
            ),
        )
    )


def _block_pairs(tags: DataFrame) -> DataFrame:
    """Pairs of the sorted tags of records too long for one row, from pairs of tag blocks.

    The blocks are dealt over all tasks, so neither a row nor a task holds a record's pairs.
    """
    slots = int(tags.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def starts(first: Column) -> Column:
        return F.explode(F.sequence(first, F.size("tags"), F.lit(TAG_BLOCK)))

    def block(start: str) -> Column:
        return F.slice("tags", F.col(start), F.lit(TAG_BLOCK))

    lefts = tags.select("tags", starts(F.lit(1)).alias("left"))
    both = lefts.select("tags", "left", starts(F.col("left")).alias("right"))
    dealt = both.select(block("left").alias("lefts"), block("right").alias("rights")).repartition(slots)
    pairs = F.transform(
        "lefts",
        lambda left: F.transform(
            F.filter("rights", lambda right: right > left),
            lambda right: F.struct(left.alias("left_tag"), right.alias("right_tag")),
        ),
    )
    return dealt.select(F.inline(F.flatten(pairs)))


def tag_cooccurrence(records: DataFrame) -> DataFrame:
    """Records that hold both tags, for every pair of tags that meet in a record."""
    tagged = records.where(F.size("tags") > 1)
    short = tagged.where(F.size("tags") <= TAG_BLOCK).select(F.inline(tag_pairs(F.col("tags"))))
    long = tagged.where(F.size("tags") > TAG_BLOCK).select(F.sort_array(tx.clean_tags(F.col("tags"))).alias("tags"))
    # A long list may hold one tag over and over, or nothing but blank ones.
    pairs = short.unionByName(_block_pairs(long.where(F.size("tags") > 1)))
    return (
        pairs.groupBy("left_tag", "right_tag")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "left_tag", "right_tag")
    )


def plain_label(name: str) -> str:
    """A label without case, white space, underscores and hyphens."""
    return re.sub(r"[\s_\-]+", "", name.casefold())


def _plain_labels(name: str) -> Column:
    """:func:`plain_label` as a column."""
    return F.regexp_replace(tx.casefold(F.col(name)), "(?U)[\\s_\\-]+", "")


@F.pandas_udf(T.DoubleType())
def _similarities(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series(
            [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)]
        )


def _rare_grams(plain: DataFrame) -> DataFrame:
    """The rarest letter pairs of every label, enough that two similar labels share one.

    Labels of lengths a and b with similarity s match s·(a+b)/2 letters in at
    most (1-s)·(a+b)+1 blocks, so they share at least the difference of the two
    as letter pairs, counted with repetition. A label of length a needs partners
    of length a·s/(2-s) or more, which bounds the shared pairs from below; all
    but that many of its pairs, rarest first, must therefore meet the partner's.
    """
    size = F.length("plain")
    starts = F.sequence(F.lit(1), size - 1)
    grams = plain.where(size >= 2).select(
        "plain", size.alias("size"), F.posexplode(F.transform(starts, lambda i: F.substring("plain", i, 2))).alias("at", "gram")
    )
    repeat = Window.partitionBy("plain", "gram").orderBy("at")
    marked = grams.withColumn("repeat", F.row_number().over(repeat)).drop("at")
    frequency = marked.groupBy("gram", "repeat").agg(F.count(F.lit(1)).alias("labels"))
    total = F.col("size") * (1 + SIMILARITY / (2 - SIMILARITY))
    shared = F.greatest(
        F.lit(1), F.ceil(total * (SIMILARITY / 2 - (1 - SIMILARITY)) - 1 - F.lit(1e-9))
    )
    rarest = Window.partitionBy("plain").orderBy("labels", "gram", "repeat")
    return (
        marked.join(frequency, ["gram", "repeat"])
        .withColumn("place", F.row_number().over(rarest))
        .where(F.col("place") <= F.col("size") - 1 - shared + 1)
        .select("plain", "size", "gram", "repeat")
    )


def _label_candidates(plain: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct plain labels that share one of their rarest letter pairs."""
    grams = _rare_grams(plain)
    left = grams.select(F.col("plain").alias("a"), F.col("size").alias("size_a"), "gram", "repeat")
    right = grams.select(F.col("plain").alias("b"), F.col("size").alias("size_b"), "gram", "repeat")
    reach = 2 * F.least("size_a", "size_b") / (F.col("size_a") + F.col("size_b"))
    return (
        left.join(right, ["gram", "repeat"])
        .where((F.col("a") < F.col("b")) & (reach >= SIMILARITY))
        .select("a", "b")
        .distinct()
    )


def similar_label_count(categories: DataFrame) -> DataFrame:
    """One row: how many pairs :func:`similar_labels` would list without a limit.

    Names that become equal are counted as a group; their pairs are never listed.
    """
    groups = materialise(
        categories.select(_plain_labels("name").alias("plain"))
        .where(F.col("plain") != "")
        .groupBy("plain")
        .agg(F.count(F.lit(1)).alias("names")),
        "label-groups",
    )
    one = groups.select(F.col("plain").alias("a"), F.col("names").alias("names_a"))
    two = groups.select(F.col("plain").alias("b"), F.col("names").alias("names_b"))
    alike = _label_candidates(groups.select("plain")).where(_similarities(F.col("a"), F.col("b")) >= SIMILARITY)
    across = alike.join(one, "a").join(two, "b").select((F.col("names_a") * F.col("names_b")).alias("pairs"))
    within = groups.select((F.col("names") * (F.col("names") - 1) / 2).cast("long").alias("pairs"))
    return within.unionByName(across).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("similar_label_count"))


def similar_labels(categories: DataFrame, *, limit: int | None = TOP_LABEL_PAIRS) -> DataFrame:
    """Category names that are equal without case and separators, or nearly so.

    Names that become equal form one group; a pair of groups is compared once.
    With a ``limit`` only the first names of a group can reach the list, so the
    others are left out of its pairs.
    """
    named = categories.select("id", "name", _plain_labels("name").alias("plain")).where(
        F.col("plain") != ""
    )
    in_group = Window.partitionBy("plain").orderBy("name", "id")
    ranked = named.withColumn("place", F.row_number().over(in_group))
    if limit is not None:
        ranked = ranked.where(F.col("place") <= limit + 1)
    ranked = materialise(ranked, "labels")
    plain = ranked.select("plain").distinct()
    candidates = _label_candidates(plain)
    same = plain.select(F.col("plain").alias("a"), F.col("plain").alias("b"))
    pairs = candidates.unionByName(same)
    one = ranked.select(F.col("plain").alias("a"), F.struct("name", "id", "plain").alias("one"))
    two = ranked.select(F.col("plain").alias("b"), F.struct("name", "id", "plain").alias("two"))
    joined = pairs.join(one, "a").join(two, "b")
    apart = (F.col("a") != F.col("b")) | (F.col("one") < F.col("two"))
    ordered = joined.where(apart).select(
        F.least("one", "two").alias("left"), F.greatest("one", "two").alias("right")
    )
    equal = F.col("left.plain") == F.col("right.plain")
    measured = ordered.withColumn(
        "similarity", _similarities(F.col("left.plain"), F.col("right.plain"))
    ).where(equal | (F.col("similarity") >= SIMILARITY))
    rows = measured.select(
        F.col("left.id").alias("left_id"),
        F.col("left.name").alias("left_name"),
        F.col("right.id").alias("right_id"),
        F.col("right.name").alias("right_name"),
        F.round("similarity", 3).alias("similarity"),
        F.when(equal, "normalized_equal").otherwise("high_similarity").alias("reason"),
    ).orderBy(F.desc("similarity"), "left_name", "right_name")
    return rows if limit is None else rows.limit(limit)


def field_profiles(records: DataFrame) -> DataFrame:
    """Missing and distinct values of content, category, tags and source.

    Each field is reduced to counted distinct keys first; all share one shuffle.
    """
    no_tags = F.coalesce(F.size("tags"), F.lit(0)) <= 0
    missing = records.agg(
        F.count_if(_length(records) == 0).alias("content"),
        F.count_if(F.coalesce("primary_category_id", F.lit("")) == "").alias("primary_category"),
        F.count_if(no_tags).alias("tags"),
        F.count_if(_no_source()).alias("source"),
    )
    names = ("content", "primary_category", "tags", "source")
    kinds = ("long_text", "primary_category", "tag_list", "source_reference")
    rows = missing.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("position"),
                        F.lit(name).alias("column"),
                        F.lit(kind).alias("semantic_type"),
                        F.col(name).alias("null_count"),
                    )
                    for i, (name, kind) in enumerate(zip(names, kinds))
                ]
            )
        )
    )

    def cells(column: str, value: Column) -> Column:
        return F.transform(value, lambda item: F.struct(F.lit(column).alias("column"), item.alias("key")))

    values = F.concat(
        cells("content", F.array(tx.digest_long(F.col("content")))),
        cells("primary_category", F.array(F.nullif("primary_category_id", F.lit("")))),
        cells("tags", F.coalesce("tags", F.array().cast("array<string>"))),
        cells("source", F.array(F.nullif(tx.strip(F.col("source")), F.lit("")))),
    )
    keys = records.select(F.inline(values)).where(F.col("key").isNotNull())
    distinct = keys.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    return (
        rows.join(distinct, "column", "left")
        .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
        .orderBy("position")
    )


def corpus_warnings() -> Column:
    flags = {
        "empty_text_corpus": F.col("record_count") == 0,
        "empty_text_records_present": F.col("empty_record_count") > 0,
        "exact_duplicate_text_present": F.col("exact_duplicate_record_count") > 0,
        "extreme_text_lengths_present": (F.col("short_record_count") + F.col("long_record_count")) > 0,
        "uncategorized_records_present": F.col("uncategorized_count") > 0,
        "missing_sources_present": F.col("missing_source_count") > 0,
        "category_conflicts_present": F.col("category_conflict_count") > 0,
        "near_duplicate_category_names_present": F.col("similar_label_count") > 0,
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(flag)) for flag, test in flags.items()]))


def corpus_quality(
    records: DataFrame, categories: DataFrame, *, groups: DataFrame | None = None
) -> DataFrame:
    """One row of quality counts, lengths and warnings; ``groups`` are copies already counted."""
    copies = copy_counts(copy_groups(records) if groups is None else groups)
    lengths = length_summary(records)
    similar = similar_label_count(categories)
    return record_quality(records).withColumns(
        {
            "copies": copies.select(F.struct(*copies.columns)).scalar(),
            "lengths": lengths.select(F.struct(*lengths.columns)).scalar(),
            "similar_label_count": similar.scalar(),
        }
    ).select("*", "copies.*", "lengths.*").drop("copies", "lengths").withColumn(
        "warnings", corpus_warnings()
    )


def with_field_warnings(fields: DataFrame, quality: DataFrame) -> DataFrame:
    """Repeat the corpus warnings next to the field they concern."""
    # Warning of a field for a warning of the corpus.
    shown = {
        "content": {
            "empty_text_records_present": "empty_text_records",
            "exact_duplicate_text_present": "exact_duplicate_text",
            "extreme_text_lengths_present": "extreme_text_lengths",
        },
        "primary_category": {
            "uncategorized_records_present": "uncategorized_records",
            "category_conflicts_present": "category_conflicts",
            "near_duplicate_category_names_present": "near_duplicate_category_names",
        },
        "tags": {},
        "source": {"missing_sources_present": "missing_sources"},
    }
    present = quality.select("warnings").scalar()
    chosen = F.array().cast("array<string>")
    for column, names in shown.items():
        if names:
            own = F.array_compact(
                F.array(
                    *[F.when(F.array_contains("_present", flag), F.lit(w)) for flag, w in names.items()]
                )
            )
            chosen = F.when(F.col("column") == column, own).otherwise(chosen)
    return fields.withColumn("_present", present).withColumn("warnings", chosen).drop("_present")


def _first_rows(rows: DataFrame, limit: int | None, *columns: str) -> Column:
    """The first rows of an ordered result, or all of a listed one, as one JSON text."""
    entries = (rows if limit is None else rows.limit(limit)).agg(F.to_json(F.collect_list(F.struct(*columns))))
    return entries.scalar()


def corpus_findings(
    quality: DataFrame,
    *,
    copies: DataFrame,
    conflicts: DataFrame,
    labels: DataFrame,
    keywords: DataFrame | None,
    tokens: DataFrame,
    pairs: DataFrame,
) -> DataFrame:
    """The findings that the warnings, keywords, tokens and tags call for."""
    top_token, top_pair = (
        F.coalesce(rows.agg(F.max("count")).scalar(), F.lit(0)) for rows in (tokens, pairs)
    )

    def has(flag: str) -> Column:
        return F.array_contains("warnings", flag)

    def columns(*names: str) -> dict[str, Column]:
        return {name: F.col(name) for name in names}

    content, category = F.array(F.lit("content")), F.array(F.lit("primary_category"))
    copied = ("content_hash", "count", "record_ids", "category_ids")
    candidates = [
        (
            has("uncategorized_records_present"),
            finding(
                "primary_category_null_count",
                F.lit("Some records have no category yet."),
                {
                    **columns("record_count", "uncategorized_count"),
                    "uncategorized_ratio": ratio(F.col("uncategorized_count"), F.col("record_count")),
                },
                category,
                ("uncategorized_records_present",),
            ),
        ),
        (
            has("missing_sources_present"),
            finding(
                "source_empty_count",
                F.lit("Some records name no source."),
                columns("missing_source_count", "missing_source_ratio"),
                F.array(F.lit("source")),
                ("source_missing_limits_traceability",),
            ),
        ),
        (
            has("exact_duplicate_text_present"),
            finding(
                "sha256_exact_content_grouping",
                F.lit("Some contents occur more than once; confirm before removing them."),
                {
                    "duplicate_record_count": F.col("exact_duplicate_record_count"),
                    "groups": _first_rows(copies, TOP_COPIES, *copied),
                },
                content,
                ("deduplicate_only_after_user_confirmation",),
            ),
        ),
        (
            has("category_conflicts_present"),
            finding(
                "duplicate_content_category_comparison",
                F.lit("Some equal contents have different categories."),
                {"conflicts": _first_rows(conflicts, TOP_COPIES, *copied)},
                F.array(F.lit("content"), F.lit("primary_category")),
                ("category_conflicts_require_review",),
            ),
        ),
        (
            has("extreme_text_lengths_present"),
            finding(
                "character_length_distribution",
                F.lit("Some records are very short or very long; check how texts were split."),
                columns("short_record_count", "long_record_count", "min_length", "max_length", "p90_length"),
                content,
                ("review_split_rules_before_analysis",),
            ),
        ),
        (
            has("near_duplicate_category_names_present"),
            finding(
                "normalized_name_similarity",
                F.lit("Some category names look alike."),
                {"pairs": _first_rows(labels, TOP_LABEL_PAIRS, "left_name", "right_name", "similarity", "reason")},
                category,
                ("review_before_merging_categories",),
            ),
        ),
    ]
    if keywords is not None:
        candidates.append(
            (
                F.lit(True),
                finding(
                    "casefold_substring_keyword_count",
                    F.lit("Records that contain the given keywords literally."),
                    {"keyword_matches": _first_rows(keywords, None, "keyword", "record_count")},
                    content,
                    ("keyword_matches_are_surface_level",),
                ),
            )
        )
    candidates += [
        (
            top_token >= 2,
            finding(
                "surface_token_frequency",
                F.lit("Frequent tokens; they are no topics."),
                {"top_tokens": _first_rows(tokens, 5, "token", "count")},
                content,
                ("token_frequency_is_not_semantic_topic_modeling",),
            ),
        ),
        (
            top_pair >= 2,
            finding(
                "tag_pair_co_occurrence_count",
                F.lit("Some tags often occur together."),
                {"top_pairs": _first_rows(pairs, 5, "left_tag", "right_tag", "count")},
                F.array(F.lit("tags")),
                ("co_occurrence_is_not_causation",),
            ),
        ),
    ]
    chosen = F.array_compact(F.array(*[F.when(test, entry) for test, entry in candidates]))
    return quality.select(F.inline(chosen))


def profile_corpus(
    records: DataFrame, categories: DataFrame, *, keywords: Sequence[str] = ()
) -> CorpusProfile:
    """Profile the records of one corpus; the small results are written once."""
    facts = record_facts(records)
    groups = materialise(copy_groups(facts), "copies")
    quality = materialise(corpus_quality(facts, categories, groups=groups), "quality")
    fields = with_field_warnings(field_profiles(records), quality)
    words = distinct_keywords(keywords)
    findings = corpus_findings(
        quality,
        copies=listed_copies(facts, categories, groups),
        conflicts=listed_copies(facts, categories, groups, conflicts_only=True),
        labels=similar_labels(categories),
        keywords=keyword_record_counts(records, words) if words else None,
        tokens=materialise(frequent_tokens(records), "tokens"),
        pairs=materialise(tag_cooccurrence(facts), "pairs"),
    )
    return CorpusProfile(fields, quality, findings)
