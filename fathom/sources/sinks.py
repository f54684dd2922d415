"""Writers for tables and corpora. An existing target is never overwritten."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

TABLE_FORMATS = ("csv", "parquet")
CORPUS_FORMATS = ("csv", "jsonl")
# How Spark's writer keeps every cell: quotes doubled, white space at the ends and lone returns kept.
# A missing value is an empty cell, an empty text a quoted one.
CSV_CELLS = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


class Export(NamedTuple):
    path: str
    format: str
    kind: str
    rows: int
    bytes_written: int


def _bytes_under(df: DataFrame, path: str) -> int:
    """Size of the written files as the file system of the target reports it."""
    context = df.sparkSession.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(context._jsc.hadoopConfiguration())
    return system.getContentSummary(hadoop).getLength()


def _write(df: DataFrame, path: str, kind: str, fmt: str) -> Export:
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists")
    if fmt == "csv":
        writer.options(**CSV_CELLS).csv(path, header=True)
    elif fmt == "jsonl":
        writer.option("ignoreNullFields", False).json(path)
    else:
        writer.parquet(path)
    return Export(path, fmt, kind, seen.get["rows"], _bytes_under(df, path))


def export_table(df: DataFrame, path: str, fmt: str = "parquet") -> Export:
    """Write a table as CSV with header or as Parquet."""
    if fmt not in TABLE_FORMATS:
        raise ValueError(f"Tables are written as {' or '.join(TABLE_FORMATS)}, not {fmt}.")
    return _write(df, path, "tabular", fmt)


def _labelled(records: DataFrame, categories: DataFrame) -> DataFrame:
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    return records.join(
        names, F.col("primary_category_id") == F.col("category_id"), "left"
    ).withColumn("primary_category", F.coalesce("category_name", F.lit("")))


def _iso(time: Column) -> Column:
    """ISO form; a fraction appears only when there is one."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(time, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def _csv_cells(records: DataFrame, categories: DataFrame) -> DataFrame:
    """The thirteen columns of the CSV form: names for ids, tags as one text. What is missing stays so."""
    return (
        _labelled(records, categories)
        .orderBy("created_at", "id")
        .select(
            "id",
            "content",
            F.col("category_name").alias("primary_category"),
            F.when(F.size("tags") > 0, F.array_join("tags", ", ")).alias("tags"),
            "source",
            "location",
            "speaker",
            "record_time",
            "note",
            "custom_fields_json",
            "created_at",
            "updated_at",
            "schema_version",
        )
    )


def corpus_csv_rows(records: DataFrame, categories: DataFrame) -> DataFrame:
    """The rows of the CSV form, with blanks for what a record does not name."""
    return _csv_cells(records, categories).fillna("", ["primary_category", "tags", "source", "location", "speaker"])


def corpus_json_rows(records: DataFrame, categories: DataFrame) -> DataFrame:
    """The JSON form: tags as a list, custom fields as an object, blanks as null."""
    fields = F.try_parse_json(F.coalesce("custom_fields_json", F.lit("{}")))
    is_object = F.startswith(F.schema_of_variant(fields), F.lit("OBJECT"))
    empty = F.parse_json(F.lit("{}"))
    kept_tags = F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda tag: tag != "")
    return (
        _labelled(records, categories)
        .orderBy("created_at", "id")
        .select(
            "id",
            "content",
            "primary_category",
            kept_tags.alias("tags"),
            F.nullif("source", F.lit("")).alias("source"),
            F.nullif("location", F.lit("")).alias("location"),
            F.nullif("speaker", F.lit("")).alias("speaker"),
            _iso(F.col("record_time")).alias("record_time"),
            F.coalesce("note", F.lit("")).alias("note"),
            F.coalesce(F.when(is_object, fields), empty).alias("custom_fields"),
            _iso(F.col("created_at")).alias("created_at"),
            _iso(F.col("updated_at")).alias("updated_at"),
            "schema_version",
        )
    )


def export_corpus(
    records: DataFrame, categories: DataFrame, path: str, fmt: str = "jsonl"
) -> Export:
    """Write a corpus as CSV or JSON lines; an empty corpus is refused.

    In CSV, what a record does not name is an empty cell, which a reader that tells the two apart
    keeps from an empty text.
    """
    if fmt not in CORPUS_FORMATS:
        raise ValueError(f"Corpora are written as {' or '.join(CORPUS_FORMATS)}, not {fmt}.")
    if records.isEmpty():
        raise ValueError("The corpus has no records to write.")
    build = _csv_cells if fmt == "csv" else corpus_json_rows
    return _write(build(records, categories), path, "text_corpus", fmt)
