"""Readers that turn plain text and JSON lines into corpus records."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import text as tx
from fathom.functions.casts import iso_timestamp
from fathom.plans.parallel import spread_small
from fathom.plans.storage import materialise
from fathom.sources.tables import decoded, java_charset

# Fixed value: the colour of a category that names none.
DEFAULT_COLOR = "#2563eb"

# Payload keys with a column of their own.
PAYLOAD_KEYS = (
    "id",
    "content",
    "primary_category",
    "tags",
    "source",
    "location",
    "speaker",
    "time",
    "record_time",
    "note",
)

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("corpus_id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("primary_category_id", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("record_time", T.TimestampNTZType()),
        T.StructField("note", T.StringType()),
        T.StructField("custom_fields_json", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("schema_version", T.IntegerType()),
    ]
)
CATEGORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("color", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("schema_version", T.IntegerType()),
    ]
)


class Corpus(NamedTuple):
    """Records, the categories they name, and one row of skip counts."""

    records: DataFrame
    categories: DataFrame
    skipped: DataFrame


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring a DataFrame to a fixed schema; absent columns take their defaults."""
    now = F.current_timestamp().cast("timestamp_ntz")
    defaults: dict[str, Column] = {
        "tags": F.array().cast("array<string>"),
        "note": F.lit(""),
        "custom_fields_json": F.lit("{}"),
        "description": F.lit(""),
        "color": F.lit(DEFAULT_COLOR),
        "created_at": now,
        "updated_at": now,
        "schema_version": F.lit(1),
    }
    columns = []
    for field in schema.fields:
        default = defaults.get(field.name, F.lit(None))
        value = F.col(field.name) if field.name in df.columns else default
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def corpus_records(df: DataFrame) -> DataFrame:
    return conform(df, RECORD_SCHEMA)


def categories_for_names(names: DataFrame) -> DataFrame:
    """The category dictionary of the distinct non-blank values of column ``name``."""
    trimmed = names.select(tx.strip(F.col("name")).alias("name")).where(F.col("name") != "")
    return conform(
        trimmed.distinct().withColumn("id", tx.category_id(F.col("name"))), CATEGORY_SCHEMA
    )


def clean_text(content: Column) -> Column:
    """Drop a byte order mark and bring line breaks to one form."""
    return F.regexp_replace(F.regexp_replace(content, "^\ufeff", ""), "\r\n?", "\n")


def records_from_texts(
    texts: DataFrame,
    corpus_id: str,
    *,
    mode: str = "non_empty_line",
    delimiter: str = "",
    default_category: str = "",
    default_tags: Sequence[str] = (),
    default_source: str = "",
) -> Corpus:
    """Split texts (columns ``scope``, ``content`` and optionally ``source``) into records."""
    raw = tx.raw_segments(clean_text(F.col("content")), mode, delimiter)
    source = F.col("source") if "source" in texts.columns else F.lit(None).cast("string")
    inputs = spread_small(texts.select("scope", source.alias("source"), "content"))
    split = inputs.select("scope", "source", raw.alias("raw")).withColumn("kept", tx.kept_segments(F.col("raw")))
    segments = split.select("scope", "source", F.posexplode("kept").alias("index", "content"))
    skipped = split.agg(
        F.coalesce(F.sum(tx.skipped_segments(F.col("raw"), F.col("kept"), mode)), F.lit(0)).cast("long").alias("skipped_segments")
    )
    records = _with_defaults(segments, corpus_id, default_category, default_tags, default_source)
    return Corpus(records, _default_categories(texts.sparkSession, default_category), skipped)


def _default_categories(spark: SparkSession, name: str) -> DataFrame:
    return categories_for_names(spark.createDataFrame([(name,)], "name string"))


def _with_defaults(
    segments: DataFrame,
    corpus_id: str,
    default_category: str,
    default_tags: Sequence[str],
    default_source: str,
) -> DataFrame:
    category = default_category.strip()
    return corpus_records(
        segments.select(
            tx.record_id(F.col("scope"), F.col("index"), F.col("content")).alias("id"),
            F.lit(corpus_id).alias("corpus_id"),
            "content",
            (tx.category_id(F.lit(category)) if category else F.lit(None)).alias("primary_category_id"),
            tx.with_default_tags(F.lit(None).cast("array<string>"), default_tags).alias("tags"),
            (F.lit(default_source) if default_source else F.col("source")).alias("source"),
        )
    )


def scope_of(path: str) -> Column:
    """What names a file in record ids: its path below ``path``, or its bare name if it is ``path``.

    Of a pattern, the part before the first wild card's folder counts as ``path``.
    """
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", path)
    root = re.split(r"[*?\[{]", plain)[0]
    root = root.rsplit("/", 1)[0] if root != plain else root.rstrip("/")
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    full = F.regexp_replace(full, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    below = F.substring_index(full, f"{root}/", -1) if root else full
    inside = F.contains(full, F.lit(f"{root}/")) & F.lit(bool(root))
    return F.when(inside, below).otherwise(F.col("_metadata.file_name"))


def numbered_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Lines with file, start of their split and reading order inside it.

    Large files stay splittable: a place in the file is (split, order).
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        scope_of(path).alias("scope"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        F.regexp_replace(decoded(F.col("value"), java_charset(spark, encoding)), "^\ufeff", "").alias("value"),
    )


def cumulated(rows: DataFrame, amounts: dict[str, Column], *order: str) -> DataFrame:
    """Add for each amount its sum over the rows before in the same file, in (``split``, ``order``).

    Rows are added up inside their split, which the reader bounds in size, and shifted by the
    totals of the splits before it, one short row a split.
    """
    inside = Window.partitionBy("file", "split").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file", "split").agg(*[F.sum(amount).alias(f"_{name}") for name, amount in amounts.items()])
    shifts = totals.select("file", "split", *[F.coalesce(F.sum(f"_{name}").over(ahead), F.lit(0)).alias(f"_{name}") for name in amounts])
    local = rows.withColumns({name: F.coalesce(F.sum(amount).over(inside), F.lit(0)) for name, amount in amounts.items()})
    shifted = local.join(shifts, ["file", "split"]).withColumns({name: F.col(name) + F.col(f"_{name}") for name in amounts})
    return shifted.drop(*[f"_{name}" for name in amounts])


def ordinals(rows: DataFrame, *order: str) -> DataFrame:
    """Number rows from 0 through each file as ``index``."""
    return cumulated(rows, {"index": F.lit(1).cast("long")}, *order)


def running_in_split(rows: DataFrame, amount: str) -> DataFrame:
    """Add ``local``, the sum of ``amount`` over the rows before in the same file and split.

    For rows in the order of the reader: a split is read by one task, so nothing is shuffled.
    """
    names = [*rows.columns, "local"]
    where = [rows.columns.index(name) for name in ("file", "split", amount)]

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            files, splits, n = (batch.column(i) for i in where)
            code, split, n = np.asarray(files.dictionary_encode().indices), np.asarray(splits), np.asarray(n)
            starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (split[1:] != split[:-1])])
            before = n.cumsum() - n
            base = before[starts]
            if (files[0].as_py(), int(split[0])) == last:
                base[0] = -seen
            local = before - np.repeat(base, np.diff(np.r_[starts, len(n)]))
            last, seen = (files[-1].as_py(), int(split[-1])), int(local[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local, pa.int64())], names=names)

    return rows.mapInArrow(running, T.StructType([*rows.schema.fields, T.StructField("local", T.LongType())]))


def text_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Every line of every file, whatever ends it, with its place: ``split``, ``line``, ``piece``.

    Joined by line feeds they are the text of the file: one that ends in a line break has an empty
    last line. An empty file has no lines.
    """
    lines, closing = _read_and_closing_lines(spark, path, encoding)
    return lines.unionByName(closing)


def _read_and_closing_lines(spark: SparkSession, path: str, encoding: str) -> tuple[DataFrame, DataFrame]:
    """The lines in the order of the reader, and the empty last ones, at most one a file."""
    charset = java_charset(spark, encoding)
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        scope_of(path).alias("scope"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        F.octet_length("value").alias("octets"),
        F.col("_metadata.file_size").alias("file_size"),
        F.regexp_replace(decoded(F.col("value"), charset), "^\ufeff", "").alias("value"),
    )
    # A carriage return is a line break, before a line feed the same one.
    lines = rows.select(
        "file", "scope", "split", "line",
        F.posexplode(F.split(F.regexp_replace("value", "\r\\z", ""), "\r", -1)).alias("piece", "value"),
    )
    # The reader does not tell whether the last line has an end; its bytes do. It drops a byte order mark.
    place = F.struct("split", "line")
    files = rows.groupBy("file").agg(
        F.first("scope").alias("scope"),
        F.max(place).alias("last"),
        F.max_by(F.endswith("value", F.lit("\r")), place).alias("returned"),
        (F.sum(F.col("octets").cast("long") + 1) - F.first("file_size")).isin(0, -3).alias("ended"),
    )
    closing = files.where("ended or returned").select(
        "file", "scope", "last.split", (F.col("last.line") + 1).alias("line"), F.lit(0).alias("piece"), F.lit("").alias("value")
    )
    return lines, closing


def stitched_segments(
    spark: SparkSession, path: str, mode: str, delimiter: str = "", encoding: str = "utf-8"
) -> tuple[DataFrame, DataFrame]:
    """Segments of files of any size (file, scope, split, index, content) and how many blank ones were skipped.

    Lines are cut at their breaks. The breaks before a piece, counted through the file, name its
    segment; pieces of one name are joined, so a segment may begin and end in different splits.
    """
    read, closing = _read_and_closing_lines(spark, path, encoding)
    lines = read.unionByName(closing)
    blank = tx.strip(F.col("value")) == ""
    if mode == "paragraph":
        placed = cumulated(lines, {"number": blank.cast("long"), "at": F.lit(1).cast("long")}, "line", "piece")
        pieces = placed.where(~blank).withColumn("part", F.lit(0))
        ends = placed.groupBy("file").agg(
            F.count(F.lit(1)).alias("lines"), F.min(F.when(~blank, F.col("at"))).alias("first"), F.max(F.when(~blank, F.col("at"))).alias("last")
        )
        # Two line breaks before the first word, or after the last one, cut off a blank segment.
        edges = (F.col("first") >= 2).cast("long") + (F.col("lines") - 1 - F.col("last") >= 2).cast("long")
        skipped = ends.select(F.coalesce(edges, F.when(F.col("lines") > 2, 2).otherwise(1).cast("long")).alias("n"))
    else:
        cut = tx.line_pieces(F.col("value"), mode, delimiter)
        counted = read.withColumn("amount", (F.size(cut) - 1).cast("long"))
        ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        totals = counted.groupBy("file", "split").agg(F.sum("amount").alias("total"))
        # One short row a split.
        shifts = materialise(totals.withColumn("shift", F.coalesce(F.sum("total").over(ahead), F.lit(0))), "splits")
        local = running_in_split(counted, "amount").join(shifts, ["file", "split"]).withColumn("breaks", F.col("shift") + F.col("local"))
        last = closing.join(shifts, ["file", "split"]).withColumn("breaks", F.col("shift") + F.col("total"))
        placed = local.select(*read.columns, "breaks").unionByName(last.select(*read.columns, "breaks")).withColumn("cut", cut)
        pieces = placed.select("file", "scope", "split", "line", "piece", "breaks", F.posexplode("cut").alias("part", "value"))
        pieces = pieces.withColumn("number", F.col("breaks") + F.col("part"))
        # A sentence holds its end; only a file without any can be one blank segment.
        whole = lines.withColumn("cut", cut).groupBy("file").agg((F.sum(F.size("cut")) == F.count(F.lit(1))).alias("one"), F.bool_and(blank).alias("blank"))
        skipped = whole.select((F.col("one") & F.col("blank")).cast("long").alias("n"))
    order = F.struct("split", "line", "piece", "part")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("at"), F.col("value")))), lambda p: p["value"]), "\n")
    segments = pieces.groupBy("file", "number").agg(
        F.first("scope").alias("scope"), F.min("split").alias("split"), tx.strip(joined).alias("content")
    )
    if mode == "custom_delimiter":
        skipped = segments.select((F.col("content") == "").cast("long").alias("n"))
    kept = segments.where(F.col("content") != "")
    if mode == "sentence":
        indexed = kept.withColumn("index", F.col("number"))
    else:
        # Numbered without the texts: a segment is blank if all its pieces are.
        filled = pieces.groupBy("file", "number").agg(F.min("split").alias("split"), F.bool_or(~blank).alias("filled")).where("filled")
        index = ordinals(filled.drop("filled"), "number").select("file", "number", "index")
        indexed = kept.join(index, ["file", "number"])
    return indexed.drop("number"), skipped.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("skipped_segments"))


def read_text_corpus(
    spark: SparkSession,
    path: str,
    corpus_id: str,
    *,
    mode: str = "non_empty_line",
    delimiter: str = "",
    encoding: str = "utf-8",
    default_category: str = "",
    default_tags: Sequence[str] = (),
    default_source: str = "",
) -> Corpus:
    """Read text or Markdown files as records.

    Files are read split by split, so they may be of any size in every mode but ``whole_input``,
    which makes a record of each file, and delimiters that hold a line break, which need the file as
    a whole in one task. An empty file gives no record.
    """
    options = {
        "default_category": default_category,
        "default_tags": default_tags,
        "default_source": default_source,
    }
    charset = java_charset(spark, encoding)
    if mode == "non_empty_line":
        lines = numbered_lines(spark, path, encoding)
        pieces = lines.select(
            "file",
            "scope",
            "split",
            "line",
            F.posexplode(tx.raw_segments(F.col("value"), mode)).alias("piece", "content"),
        ).withColumn("content", tx.strip(F.col("content")))
        blank = F.col("content") == ""
        kept = ordinals(pieces.where(~blank), "line", "piece")
        skipped = pieces.agg(F.count_if(blank).alias("skipped_segments"))
        records = _with_defaults(
            kept.withColumn("source", F.col("file")),
            corpus_id,
            default_category,
            default_tags,
            default_source,
        )
        return Corpus(records, _default_categories(spark, default_category), skipped)
    if mode in ("paragraph", "sentence") or mode == "custom_delimiter" and not re.search("[\r\n]", delimiter):
        segments, skipped = stitched_segments(spark, path, mode, delimiter, encoding)
        records = _with_defaults(segments.withColumn("source", F.col("file")), corpus_id, default_category, default_tags, default_source)
        return Corpus(records, _default_categories(spark, default_category), skipped)
    files = spark.read.text(path, wholetext=True).withColumn("content", decoded(F.col("value"), charset))
    texts = files.select(
        scope_of(path).alias("scope"),
        F.col("_metadata.file_path").alias("source"),
        "content",
    )
    return records_from_texts(texts, corpus_id, mode=mode, delimiter=delimiter, **options)


def read_jsonl_corpus(
    spark: SparkSession,
    path: str,
    corpus_id: str,
    *,
    encoding: str = "utf-8",
    default_category: str = "",
    default_tags: Sequence[str] = (),
    default_source: str = "",
) -> Corpus:
    """Read JSON lines as records.

    A line that is not JSON fails the query; a line that is no object and a
    record without content are skipped and counted. Records without an id get
    one from their place among the objects of the file.
    """
    lines = numbered_lines(spark, path, encoding).withColumn("value", tx.strip(F.col("value")))
    lines = lines.where(F.col("value") != "")
    return records_from_json(
        lines,
        corpus_id,
        default_category=default_category,
        default_tags=default_tags,
        default_source=default_source,
    )


def records_from_json(
    lines: DataFrame,
    corpus_id: str,
    *,
    default_category: str = "",
    default_tags: Sequence[str] = (),
    default_source: str = "",
) -> Corpus:
    """Records of JSON texts in ``value`` with their place (``file``, ``scope``, ``split``, ``line``)."""
    message = F.concat(F.lit("Not valid JSON: "), F.substring("value", 1, 200))
    parsed = lines.withColumn(
        "payload", F.coalesce(F.try_parse_json("value"), F.raise_error(message).cast("variant"))
    ).withColumn("is_object", F.startswith(F.schema_of_variant("payload"), F.lit("OBJECT")))
    objects = parsed.where("is_object")
    payload = F.col("payload")

    def member(name: str, kind: str = "string") -> Column:
        return F.try_variant_get(payload, f"$.{name}", kind)

    def filled(name: str) -> Column:
        return F.nullif(member(name), F.lit(""))

    def optional(name: str) -> Column:
        return F.nullif(tx.strip(member(name)), F.lit(""))

    content = F.coalesce(tx.strip(member("content")), F.lit(""))
    category = F.coalesce(filled("primary_category"), F.lit(default_category))
    tags = F.coalesce(tx.clean_tags(member("tags", "array<string>")), tx.split_tags(member("tags")))
    members = F.variant_get(payload, "$", "map<string,variant>")
    extra = F.map_filter(members, lambda key, _: ~key.isin(*PAYLOAD_KEYS))
    fields = objects.select(
        "file",
        "scope",
        "split",
        "line",
        filled("id").alias("given_id"),
        content.alias("content"),
        tx.strip(category).alias("category"),
        tx.with_default_tags(tags, default_tags).alias("tags"),
        F.coalesce(
            filled("source"), F.lit(default_source) if default_source else F.col("file")
        ).alias("source"),
        optional("location").alias("location"),
        optional("speaker").alias("speaker"),
        iso_timestamp(tx.strip(F.coalesce(filled("record_time"), filled("time")))).alias("record_time"),
        F.coalesce(member("note"), F.lit("")).alias("note"),
        F.to_json(extra).alias("custom_fields_json"),
    )
    has_content = F.col("content") != ""
    identified = fields
    if fields.where(F.col("given_id").isNull() & has_content).head(1):
        identified = ordinals(fields, "line")
    else:
        identified = fields.withColumn("index", F.lit(None).cast("long"))
    made = tx.record_id(F.col("scope"), F.col("index"), F.col("content"))
    records = corpus_records(
        identified.where(has_content)
        .withColumn("id", F.coalesce("given_id", made))
        .withColumn("corpus_id", F.lit(corpus_id))
        .withColumn(
            "primary_category_id",
            F.when(F.col("category") != "", tx.category_id(F.col("category"))),
        )
    )
    names = fields.select(F.col("category").alias("name"))
    if default_category:
        default = lines.sparkSession.createDataFrame([(default_category,)], "name string")
        names = names.unionByName(default)
    skipped = parsed.agg(
        F.count_if(~F.col("is_object")).alias("skipped_lines"),
        F.count_if(F.col("is_object") & (content == "")).alias("skipped_segments"),
    )
    return Corpus(records, categories_for_names(names), skipped)
