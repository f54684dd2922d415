"""Whole-table profile: column statistics, semantic types, quality, quality findings.

Three passes over the table serve every column at once: one aggregate that
shuffles a row per task, one count of distinct values, one over row keys.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import casts
from fathom.functions.statistics import ratio
from fathom.operators.steps import duplicate_row_count
from fathom.plans.keys import as_text, plain_number, ref
from fathom.plans.ordering import bracket_ends, narrowed_quantiles
from fathom.plans import storage
from fathom.plans.parallel import spread_small
from fathom.plans.storage import materialise, materialise_measured

TOP_VALUES = 10
KEY_LIMIT = 64
# Characters read of texts that are alike so far: at first, and at most in one round.
PIECE = 256
LONGEST_PIECE = 1 << 16

QUARTILES = (0.25, 0.5, 0.75)

# Column names with a role of their own.
LATITUDE_NAMES = ("lat", "latitude", "geo_latitude")
LONGITUDE_NAMES = ("lon", "lng", "longitude", "geo_longitude")
CATEGORY_NAMES = ("category", "class", "label", "primary_category")
TAG_NAMES = ("tags", "tag_list")
SOURCE_NAMES = ("source", "source_file", "source_reference")


class Profile(NamedTuple):
    """One row per column, one row for the table, one row per quality finding."""

    columns: DataFrame
    dataset: DataFrame
    findings: DataFrame


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_datetime(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))


def type_family(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if is_datetime(data_type):
        return "datetime"
    return "numeric" if is_numeric(data_type) else "text"


def schema_listing(df: DataFrame) -> DataFrame:
    """Column names and types next to the row count."""
    listed = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(index).alias("position"),
                    F.lit(field.name).alias("column"),
                    F.lit(field.dataType.simpleString()).alias("data_type"),
                )
                for index, field in enumerate(df.schema.fields)
            ]
        )
    )
    return df.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", listed)


def typed_statistics(df: DataFrame) -> DataFrame:
    """Rows per table; range, mean and deviation of every number and time column.

    One pass over typed columns, one row per task to shuffle.
    """
    aggregates, entries = [F.count(F.lit(1)).alias("rows")], []
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    for index, field in enumerate(df.schema.fields):
        column, family = ref(field.name), type_family(field.dataType)
        low = high = no_text
        mean = deviation = no_number
        if family in ("numeric", "datetime"):
            aggregates += [F.min(column).alias(f"min_{index}"), F.max(column).alias(f"max_{index}")]
            low, high = (F.col(f"{end}_{index}").cast("string") for end in ("min", "max"))
        if family == "numeric":
            number = column.cast("double")
            aggregates += [
                F.avg(number).alias(f"mean_{index}"),
                F.stddev_samp(number).alias(f"stddev_{index}"),
            ]
            mean, deviation = F.col(f"mean_{index}"), F.col(f"stddev_{index}")
        entries.append(
            F.struct(
                F.lit(index).alias("position"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("data_type"),
                F.lit(family).alias("family"),
                F.col("rows").alias("row_count"),
                low.alias("min_value"),
                high.alias("max_value"),
                mean.alias("mean_value"),
                deviation.alias("stddev_value"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))


def _text_key(full: Column) -> Column:
    """Short texts as they are, long ones as digest with their length and shape."""
    notes = F.concat_ws(
        "",
        F.when(casts.text_to_double(full).isNotNull(), F.lit("n")),
        F.when(casts.text_to_timestamp(full).isNotNull(), F.lit("t")),
        F.when(F.trim(full) == "", F.lit("b")),
    )
    digest = F.concat_ws(
        "\0", F.substring(full, 1, KEY_LIMIT), F.sha2(full, 256), F.length(full).cast("string"), notes
    )
    return F.when(F.length(full) > KEY_LIMIT, digest).otherwise(full)


def _stacked(df: DataFrame, cells: dict[int, Column], key: Column) -> DataFrame | None:
    """Counts of the distinct values of columns of one type.

    ``key`` is made of the stacked ``value``: one expression whatever the number of columns,
    so that the code generated for it stays short enough to be compiled.
    """
    if not cells:
        return None
    wide = df.select(*[cell.alias(str(index)) for index, cell in cells.items()])
    long = wide.unpivot([], wide.columns, "position", "value")
    present = long.where(F.col("value").isNotNull()).select("position", key.alias("value"))
    return present.groupBy(F.col("position").cast("int").alias("position"), "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def value_counts(df: DataFrame) -> DataFrame:
    """Occurrences ``n`` of every distinct value of every column.

    Columns of one kind share a pass and a shuffle: whole numbers, fractions,
    times and everything else as text. Equal values meet on the map side, and
    long texts travel as digests, so the shuffle holds one short row per
    distinct value and task.
    """
    df = spread_small(df)
    whole, fractions, times, texts = {}, {}, {}, {}
    fields = df.schema.fields
    for index, field in enumerate(fields):
        column, data_type = ref(field.name), field.dataType
        if isinstance(data_type, T.IntegralType):
            whole[index] = column.cast("long")
        elif isinstance(data_type, (T.DoubleType, T.FloatType)):
            fractions[index] = column.cast("double")
        elif is_datetime(data_type):
            times[index] = column.cast("timestamp_ntz")
        else:
            texts[index] = as_text(column, data_type)
    value = F.col("value")
    kinds = {"whole": "long", "fraction": "double", "time": "timestamp_ntz", "text": "string"}
    parts = [
        counts.select(
            "position",
            *[
                (F.col("value") if name == kind else F.lit(None)).cast(data_type).alias(name)
                for name, data_type in kinds.items()
            ],
            "n",
        )
        for kind, cells in zip(kinds, (whole, fractions, times, texts))
        if (counts := _stacked(df, cells, _text_key(value) if kind == "text" else value)) is not None
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def described(counts: DataFrame, schema: T.StructType) -> DataFrame:
    """Text, number, length and shape of counted values; a reader pays for what it uses."""

    def at(kind) -> Column:
        found = [i for i, field in enumerate(schema.fields) if kind(field.dataType)]
        return F.col("position").isin(found) if found else F.lit(False)

    text = F.col("text")
    day = F.col("time").cast("date").cast("string")
    shown_time = F.when(at(lambda t: isinstance(t, T.DateType)), day).otherwise(
        F.col("time").cast("string")
    )
    # A float is shown with its own digits and measured as the double it equals.
    shown_fraction = F.when(
        at(lambda t: isinstance(t, T.FloatType)), plain_number(F.col("fraction").cast("float"))
    ).otherwise(plain_number(F.col("fraction")))
    key = F.coalesce(text, F.col("whole").cast("string"), shown_fraction, shown_time)
    numeric = at(is_numeric)
    number = F.coalesce(
        F.col("whole").cast("double"), "fraction", F.when(numeric, text.try_cast("double"))
    )
    is_digest = F.coalesce(F.length(text) > KEY_LIMIT, F.lit(False))
    notes = F.substring_index(text, "\0", -1)
    noted_length = F.substring_index(F.substring_index(text, "\0", -2), "\0", 1).try_cast("int")
    number_like = numeric | F.when(is_digest, F.contains(notes, F.lit("n"))).otherwise(
        casts.text_to_double(text).isNotNull()
    )
    time_like = F.col("time").isNotNull() | F.when(
        is_digest, F.contains(notes, F.lit("t"))
    ).otherwise(~numeric & casts.text_to_timestamp(text).isNotNull())
    return counts.select(
        "position",
        key.alias("key"),
        number.alias("number"),
        is_digest.alias("is_digest"),
        F.when(is_digest, noted_length).otherwise(F.length(key)).alias("length"),
        number_like.alias("number_like"),
        time_like.alias("time_like"),
        F.when(is_digest, ~F.contains(notes, F.lit("b"))).otherwise(F.trim(key) != "").alias("filled"),
        "n",
    )


def value_statistics(counts: DataFrame) -> DataFrame:
    """Per column: values, distinct values, text lengths and shapes."""
    n = F.col("n")
    filled = F.col("filled")
    return counts.groupBy("position").agg(
        F.sum("n").alias("present"),
        F.count(F.lit(1)).alias("distinct_count"),
        (F.sum(F.col("length") * n) / F.sum("n")).alias("avg_text_length"),
        F.max("length").alias("max_text_length"),
        F.coalesce(F.sum(F.when(filled, n)), F.lit(0)).alias("non_empty_count"),
        F.coalesce(F.sum(F.when(filled & F.col("number_like"), n)), F.lit(0)).alias(
            "numeric_like_count"
        ),
        F.coalesce(F.sum(F.when(filled & F.col("time_like"), n)), F.lit(0)).alias(
            "datetime_like_count"
        ),
    )


def top_values(
    df: DataFrame, counts: DataFrame, *, has_digests: bool = True, limit: int = TOP_VALUES
) -> DataFrame:
    """The most frequent values per column, ties by value, as an array of pairs.

    Long values are digests in ``counts``. Everything that could still be among
    the first ``limit`` is kept, its text is looked up, and only then ranked.
    """
    known = counts.select("position", "n", F.col("key").alias("value"))
    if has_digests:
        known = _with_long_texts(df, counts, limit)
    order = Window.partitionBy("position").orderBy(F.desc("n"), F.asc("value"))
    ranked = known.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    entries = F.array_sort(F.collect_list(F.struct("place", "value", F.col("n").alias("count"))))
    return ranked.groupBy("position").agg(
        F.transform(
            entries,
            lambda entry: F.struct(entry["value"].alias("value"), entry["count"].alias("count")),
        ).alias("top_values")
    )


def _with_long_texts(df: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    prefix = F.substring("key", 1, KEY_LIMIT).alias("prefix")
    standing = F.struct((-F.col("n")).alias("rest"), prefix)
    rough = Window.partitionBy("position").orderBy(F.desc("n"), prefix.asc())
    edge = (
        counts.withColumn("place", F.row_number().over(rough))
        .where(F.col("place") <= limit)
        .groupBy("position")
        .agg(F.max(standing).alias("edge"))
    )
    # One row per column of the table.
    near = counts.join(F.broadcast(edge), "position").where(standing <= F.col("edge"))
    short = near.where(~F.col("is_digest")).select("position", "n", F.col("key").alias("value"))
    fields = [
        F.struct(F.lit(i).alias("position"), as_text(ref(f.name), f.dataType).alias("value"))
        for i, f in enumerate(df.schema.fields)
        if _may_be_long(f.dataType)
    ]
    texts = (
        df.select(F.inline(F.array(*fields)))
        .where(F.length("value") > KEY_LIMIT)
        .withColumn("key", _text_key(F.col("value")))
    )
    tied = (standing == F.col("edge")).alias("tied")
    wanted = _narrowed(texts, near.where("is_digest").select("position", "key", "n", tied), limit, len(fields))
    found = texts.join(wanted, ["position", "key"]).groupBy("position", "key")
    looked_up = found.agg(F.any_value("n").alias("n"), F.any_value("value").alias("value"))
    return short.unionByName(looked_up.select("position", "n", "value"))


def _narrowed(texts: DataFrame, digests: DataFrame, limit: int, columns: int) -> DataFrame:
    """position, key and n of the digests whose texts can be among the first ``limit``.

    Those ``tied`` with the last place share its count and their first characters. While
    more are tied than ``limit`` a column, their next characters are read, and only those
    up to the new last place stay: a round moves a piece of each tied text, never a whole
    long one, and texts differ somewhere, so it ends.
    """
    covered, step = KEY_LIMIT, PIECE
    measure = {"tied": F.count_if("tied")}
    wanted, seen = materialise_measured(digests, "digests", **measure)
    while seen["tied"] > limit * columns:
        open_keys = wanted.where("tied").select("position", "key", "n")
        pieces = (
            texts.withColumn("piece", F.substring("value", covered + 1, step))
            .drop("value")
            .join(open_keys, ["position", "key"])
            .groupBy("position", "key")
            .agg(F.any_value("n").alias("n"), F.any_value("piece").alias("piece"))
        )
        pieces = materialise(pieces, "pieces")
        order = Window.partitionBy("position").orderBy("piece")
        last = pieces.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
        # One row per column of the table.
        edge = last.groupBy("position").agg(F.max("piece").alias("edge"))
        near = pieces.join(F.broadcast(edge), "position").where(F.col("piece") <= F.col("edge"))
        still = near.select("position", "key", "n", (F.col("piece") == F.col("edge")).alias("tied"))
        wanted, seen = materialise_measured(wanted.where("not tied").unionByName(still), "digests", **measure)
        covered, step = covered + step, min(step * 4, LONGEST_PIECE)
    return wanted.select("position", "key", "n")


def _may_be_long(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))


def outlier_counts(counts: DataFrame, quartiles: DataFrame) -> DataFrame:
    """Values outside 1.5 interquartile ranges; ``quartiles`` has one row per column."""
    q1, q3 = F.col("quartiles")[0], F.col("quartiles")[2]
    reach = (q3 - q1) * 1.5
    outside = (F.col("number") < q1 - reach) | (F.col("number") > q3 + reach)
    return (
        counts.where(F.col("number").isNotNull())
        .select("position", "number", "n")
        .join(F.broadcast(quartiles), "position")
        .groupBy("position")
        .agg(F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outlier_count"))
    )


def semantic_type(stats: DataFrame) -> DataFrame:
    """Add ``semantic_type`` and ``semantic_reason`` by the first rule that fits."""
    name = F.lower("column")
    plain = F.translate(name, "- ", "__")
    rows = F.greatest("row_count", F.lit(1))
    distinct = F.col("distinct_count")
    few = F.least(F.lit(100), F.greatest(F.lit(20), F.floor(rows * 0.5)))
    family = F.col("family")
    rules = [
        (name.isin(*LATITUDE_NAMES) | name.endswith("_lat"), "geo_latitude", "column_name_latitude"),
        (name.isin(*LONGITUDE_NAMES) | name.endswith("_lon"), "geo_longitude", "column_name_longitude"),
        (name.isin(*CATEGORY_NAMES), "primary_category", "column_name_category"),
        (name.isin(*TAG_NAMES), "tag_list", "column_name_tags"),
        (name.isin(*SOURCE_NAMES), "source_reference", "column_name_source"),
        (
            ((plain == "id") | plain.endswith("_id")) & (distinct / rows >= 0.9),
            "identifier",
            "column_name_and_distinct_ratio",
        ),
        (family == "boolean", "boolean", "boolean_type"),
        (family == "datetime", "datetime", "datetime_type"),
        (family == "numeric", "numeric", "numeric_type"),
        (
            (F.coalesce("max_text_length", F.lit(0)) >= 120)
            | (F.coalesce("avg_text_length", F.lit(0.0)) >= 60),
            "long_text",
            "text_length_distribution",
        ),
        (distinct <= few, "categorical", "low_distinct_count"),
        (F.lit(True), "text", "high_distinct_text"),
    ]
    choice = F.coalesce(
        *[
            F.when(test, F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason")))
            for test, kind, reason in rules
        ]
    )
    return stats.withColumns(
        {"semantic_type": choice["kind"], "semantic_reason": choice["reason"]}
    )


def _mixed(count: str) -> Column:
    share = ratio(F.col(count), F.col("non_empty_count"))
    return (share >= 0.2) & (share < 1.0)


def column_warnings() -> Column:
    kind = F.col("semantic_type")
    mixed = (
        kind.isin("text", "long_text", "categorical")
        & (F.col("non_empty_count") > 1)
        & (_mixed("numeric_like_count") | _mixed("datetime_like_count"))
    )
    flags = {
        "constant_column": (F.col("distinct_count") == 1) & (F.col("row_count") > 1),
        "missing_values": F.col("null_count") > 0,
        "candidate_identifier": kind == "identifier",
        "high_cardinality_text": kind == "text",
        "high_cardinality_category": (kind == "categorical") & (F.col("distinct_count") > 30),
        "mixed_type_values": mixed,
        "numeric_outlier_candidates": F.coalesce(F.col("outlier_count") > 0, F.lit(False)),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(flag)) for flag, test in flags.items()]))


def written_counts(df: DataFrame) -> tuple[DataFrame, int]:
    """The value counts, and how many of them are digests."""
    counts, measured = materialise_measured(
        value_counts(df), "values", digests=F.count_if(F.length("text") > KEY_LIMIT)
    )
    return described(counts, df.schema), measured["digests"]


def rough_quartiles(df: DataFrame) -> DataFrame:
    """Brackets around the quartiles of every numeric column, in one pass."""
    aggregates, entries = [], []
    for index, field in enumerate(df.schema.fields):
        if is_numeric(field.dataType):
            number = ref(field.name).cast("double")
            aggregates += [
                F.count(number).alias(f"n_{index}"),
                bracket_ends(number, QUARTILES).alias(f"ends_{index}"),
            ]
            entries.append(
                F.struct(
                    F.struct(F.lit(index).alias("position")).alias("key"),
                    F.col(f"n_{index}").alias("total"),
                    F.col(f"ends_{index}").alias("ends"),
                )
            )
    listed = df.agg(*aggregates).select(F.inline(F.array(*entries)))
    return listed.where(F.col("total") > 0)


def column_profiles(df: DataFrame) -> DataFrame:
    """One row of statistics, role and warnings per column.

    The value counts are written once and measured on the way; quartiles come from
    narrow brackets around them.
    """
    counts, digests = written_counts(df)
    measured = value_statistics(counts)
    if any(is_numeric(field.dataType) for field in df.schema.fields):
        numbers = counts.where(F.col("number").isNotNull()).select(
            F.struct("position").alias("key"), F.col("number").alias("value"), "n"
        )
        rough = materialise(rough_quartiles(df), "brackets")
        found = narrowed_quantiles(numbers, rough, QUARTILES).select(
            F.col("key.position").alias("position"), F.col("quantiles").alias("quartiles")
        )
        measured = measured.join(found, "position", "left")
    else:
        measured = measured.withColumn("quartiles", F.lit(None).cast("array<double>"))
    # One row per column from here on.
    measured = materialise(measured, "statistics")
    quartiles = measured.where(F.col("quartiles").isNotNull()).select("position", "quartiles")
    stats = (
        typed_statistics(df)
        .join(measured, "position", "left")
        .join(outlier_counts(counts, quartiles), "position", "left")
        .join(top_values(df, counts, has_digests=digests > 0), "position", "left")
        .withColumns(
            {
                "null_count": F.col("row_count") - F.coalesce("present", F.lit(0)),
                "q1": F.col("quartiles")[0],
                "median_value": F.col("quartiles")[1],
                "q3": F.col("quartiles")[2],
                "non_empty_count": F.coalesce("non_empty_count", F.lit(0)),
                "numeric_like_count": F.coalesce("numeric_like_count", F.lit(0)),
                "datetime_like_count": F.coalesce("datetime_like_count", F.lit(0)),
            }
        )
    )
    filled = stats.withColumns(
        {
            "distinct_count": F.coalesce("distinct_count", F.lit(0)),
            "top_values": F.coalesce(
                "top_values", F.array().cast("array<struct<value:string,count:bigint>>")
            ),
        }
    )
    present = F.col("row_count") - F.col("null_count")
    return (
        semantic_type(filled)
        .withColumns(
            {
                "missing_ratio": ratio(F.col("null_count"), F.col("row_count")),
                "top_value_ratio": F.coalesce(
                    ratio(F.get("top_values", F.lit(0))["count"], present), F.lit(0.0)
                ),
                "warnings": column_warnings(),
                "approximate": F.lit(False),
            }
        )
        .select(
            "position",
            "column",
            "data_type",
            "semantic_type",
            "semantic_reason",
            "row_count",
            "null_count",
            "missing_ratio",
            "distinct_count",
            "avg_text_length",
            "max_text_length",
            "non_empty_count",
            "numeric_like_count",
            "datetime_like_count",
            "top_values",
            "top_value_ratio",
            "min_value",
            "max_value",
            "q1",
            "median_value",
            "q3",
            "mean_value",
            "stddev_value",
            "outlier_count",
            "warnings",
            "approximate",
        )
    )


def _named(flag: Column) -> Column:
    entries = F.array_sort(F.collect_list(F.when(flag, F.struct("position", "column"))))
    return F.transform(entries, lambda entry: entry["column"])


def _mapped(flag: Column, value: Column) -> Column:
    return F.map_from_entries(F.collect_list(F.when(flag, F.struct(F.col("column"), value))))


def dataset_quality(
    columns: DataFrame, duplicates: DataFrame, parse_failures: Column | None = None
) -> DataFrame:
    """One row for the table from its column profiles and duplicate count."""
    has = {
        flag: F.array_contains("warnings", flag)
        for flag in (
            "constant_column",
            "missing_values",
            "candidate_identifier",
            "high_cardinality_category",
            "high_cardinality_text",
            "mixed_type_values",
            "numeric_outlier_candidates",
        )
    }
    any_of = {flag: F.bool_or(test) for flag, test in has.items()}
    role = columns.groupBy("semantic_type").agg(F.count(F.lit(1)).alias("columns"))
    roles = role.agg(F.map_from_entries(F.collect_list(F.struct("semantic_type", "columns"))))
    summary = columns.agg(
        F.coalesce(F.max("row_count"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("column_count"),
        F.sum("null_count").alias("total_missing_values"),
        _mapped(F.col("null_count") > 0, F.col("null_count")).alias("columns_with_missing_values"),
        _named(has["constant_column"]).alias("constant_columns"),
        _named(has["high_cardinality_category"] | has["high_cardinality_text"]).alias(
            "high_cardinality_columns"
        ),
        _named(has["mixed_type_values"]).alias("mixed_type_columns"),
        _named(has["numeric_outlier_candidates"]).alias("outlier_column_names"),
        _mapped(has["numeric_outlier_candidates"], F.col("outlier_count")).alias(
            "numeric_outlier_columns"
        ),
        _mapped(
            F.col("semantic_type") == "datetime",
            F.struct(F.col("min_value").alias("min"), F.col("max_value").alias("max")),
        ).alias("time_ranges"),
        F.struct(*[test.alias(flag) for flag, test in any_of.items()]).alias("any"),
    )
    duplicate = duplicates.select("duplicate_row_count").scalar()
    flags = {
        "empty_table": F.col("row_count") == 0,
        "duplicate_rows_present": F.col("duplicate_row_count") > 0,
        "candidate_identifier_columns": F.col("any.candidate_identifier"),
        "missing_values_present": F.col("any.missing_values"),
        "constant_columns_present": F.col("any.constant_column"),
        "mixed_type_values_present": F.col("any.mixed_type_values"),
        "numeric_outlier_candidates_present": F.col("any.numeric_outlier_candidates"),
    }
    return (
        summary.withColumn("duplicate_row_count", duplicate)
        .withColumns(
            {
                "duplicate_row_ratio": ratio(F.col("duplicate_row_count"), F.col("row_count")),
                "semantic_type_counts": roles.scalar(),
                "parse_failures": parse_failures
                if parse_failures is not None
                else parse_failure_summary(),
                "warnings": F.array_compact(
                    F.array(*[F.when(test, F.lit(flag)) for flag, test in flags.items()])
                ),
                "approximate": F.lit(False),
                "method": F.lit("full_scan"),
            }
        )
        .drop("any")
    )


def no_duplicates(columns: DataFrame) -> DataFrame | None:
    """A count of zero when some column tells all rows apart, so rows need no comparison."""
    key = columns.where((F.col("distinct_count") == F.col("row_count")) | (F.col("row_count") == 0))
    if not key.head(1):
        return None
    return columns.sparkSession.createDataFrame([(0,)], "duplicate_row_count long")


def parse_failure_summary(*, reported: bool = False, count: int | None = None) -> Column:
    """How reading went: not known, counted, or strict (a failure would have stopped it)."""
    method = "not_available"
    if reported:
        method = "counted_while_reading" if count is not None else "strict_read_stops_at_first_failure"
        count = count or 0
    return F.struct(
        F.lit(reported).alias("reported"),
        F.lit(count).cast("long").alias("count"),
        F.lit(method).alias("method"),
    )


def finding(
    kind: str,
    statement: Column,
    evidence: dict[str, Column],
    fields: Column,
    warnings: tuple[str, ...],
) -> Column:
    """A finding as a struct; evidence values are text."""
    pairs = [part for name, value in evidence.items() for part in (F.lit(name), value.cast("string"))]
    return F.struct(
        F.lit(kind).alias("method"),
        statement.alias("statement"),
        F.create_map(*pairs).alias("evidence"),
        fields.alias("fields"),
        F.array(*[F.lit(warning) for warning in warnings]).alias("warnings"),
        F.lit(False).alias("approximate"),
    )



def quality_findings(dataset: DataFrame) -> DataFrame:
    """The findings that the dataset warnings call for, in a fixed order."""
    none = F.array().cast("array<string>")
    candidates = [
        (
            "duplicate_rows_present",
            finding(
                "group_by_all_columns",
                F.lit("Some rows repeat; confirm before removing them."),
                {
                    "row_count": F.col("row_count"),
                    "duplicate_row_count": F.col("duplicate_row_count"),
                    "duplicate_row_ratio": F.col("duplicate_row_ratio"),
                },
                none,
                ("deduplicate_only_after_user_confirmation",),
            ),
        ),
        (
            "missing_values_present",
            finding(
                "column_null_counts",
                F.lit("Some columns have missing values; say how they are treated."),
                {
                    "total_missing_values": F.col("total_missing_values"),
                    "columns": F.to_json("columns_with_missing_values"),
                },
                none,
                ("missing_values_present",),
            ),
        ),
        (
            "constant_columns_present",
            finding(
                "distinct_count_equals_one",
                F.lit("Some columns hold one value only and do not separate rows."),
                {"columns": F.to_json("constant_columns")},
                F.col("constant_columns"),
                ("constant_columns_present",),
            ),
        ),
        (
            "mixed_type_values_present",
            finding(
                "try_cast_number_and_time_counts",
                F.lit("Some text columns mix kinds of values; check a conversion first."),
                {"columns": F.to_json("mixed_type_columns")},
                F.col("mixed_type_columns"),
                ("mixed_type_values_present",),
            ),
        ),
        (
            "numeric_outlier_candidates_present",
            finding(
                "iqr_1_5_full_scan",
                F.lit("Some numbers lie outside the interquartile fences; they may be right."),
                {"columns": F.to_json("numeric_outlier_columns")},
                F.col("outlier_column_names"),
                ("outlier_candidates_require_review",),
            ),
        ),
    ]
    chosen = F.array_compact(
        F.array(*[F.when(F.array_contains("warnings", flag), entry) for flag, entry in candidates])
    )
    return dataset.select(F.inline(chosen))


def profile_table(
    df: DataFrame,
    parse_failures: Column | None = None,
) -> Profile:
    """Profile every column and the table.

    The small results are written once; tables they came from are deleted then.
    """
    place = storage.mark()
    columns = materialise(column_profiles(df), "profile")
    duplicates = no_duplicates(columns)
    if duplicates is None:
        duplicates = duplicate_row_count(df)
    dataset = materialise(dataset_quality(columns, duplicates, parse_failures), "quality")
    storage.discard_since(df.sparkSession, place, columns, dataset)
    return Profile(columns, dataset, quality_findings(dataset))
