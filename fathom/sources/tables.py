"""Readers for delimited and Parquet tables."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.plans.keys import ref
from fathom.sources import quoted

# Delimiters by name, supported encodings and rows of a preview.
DELIMITERS = {"comma": ",", "tab": "\t", "semicolon": ";", "pipe": "|"}
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "shift_jis")
PREVIEW_ROWS = 200
# A cell of a preview that spans more lines or characters counts as one with a stray quote.
OPEN_LINES = 1_000
OPEN_CHARS = 100_000


def delimiter_of(name: str) -> str:
    """A delimiter by its name, or the character itself."""
    return DELIMITERS.get(name, name)


def java_charset(spark: SparkSession, encoding: str) -> str:
    """The reader's name for an encoding; the two East Asian ones need Java's charsets."""
    if encoding not in ENCODINGS:
        raise ValueError(f"Unsupported encoding: {encoding}")
    if encoding.startswith("utf-8"):
        return "UTF-8"
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return encoding


def repaired_names(raw: Sequence[str | None]) -> list[str]:
    """Blank names become column_N; a repeated name gets the number of its occurrence."""
    seen: dict[str, int] = {}
    names = []
    for index, name in enumerate(raw, start=1):
        base = (name or "").strip() or f"column_{index}"
        seen[base] = seen.get(base, 0) + 1
        names.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    return names


def _reader(spark: SparkSession, encoding: str, delimiter: str, multi_line: bool):
    return (
        spark.read.option("sep", delimiter_of(delimiter))
        .option("encoding", java_charset(spark, encoding))
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
    )


def _first_cells(
    spark: SparkSession, path: str, encoding: str, delimiter: str, multi_line: bool
) -> list[str | None]:
    """The cells of the first record, as text."""
    first = _reader(spark, encoding, delimiter, multi_line).option("header", False).csv(path).first()
    if first is None:
        raise ValueError(f"No records in {path}")
    return [None if cell is None else cell.lstrip("\ufeff") for cell in first]


def read_delimited(
    spark: SparkSession,
    path: str,
    *,
    delimiter: str = "comma",
    encoding: str = "utf-8",
    has_header: bool = True,
    schema: T.StructType | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Read delimited text strictly: the first malformed record fails the query.

    Without ``schema`` the types come from all rows. Pass a schema for large
    inputs (it saves a pass) and wherever ids carry leading zeros. Cells with
    line breaks need ``multi_line``: records are then put together from lines,
    so that files still are read split by split; they end in LF or CRLF. A text
    cell with nothing in it is then missing, and one of two quotes is empty.
    """
    if multi_line:
        sep = delimiter_of(delimiter)
        charset = java_charset(spark, encoding)
        lines = quoted.lines_of(spark, path, None if charset == "UTF-8" else lambda value: decoded(value, charset))
        records = quoted.quoted_records(lines, sep)
        first = first_records(spark, path, encoding, sep, 1)[0]
        if not first:
            raise ValueError(f"No records in {path}")
        names = repaired_names(first[0] if has_header else [f"column_{i + 1}" for i in range(len(first[0]))])
        return quoted.parsed(records.where("number > 0") if has_header else records, names, schema, sep)
    names = repaired_names(_first_cells(spark, path, encoding, delimiter, multi_line))
    if not has_header:
        names = [f"column_{index + 1}" for index in range(len(names))]
    reader = _reader(spark, encoding, delimiter, multi_line).option("header", has_header)
    reader = reader.option("enforceSchema", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    read = reader.csv(path).toDF(*names)
    # Inferred times are wall-clock times without a zone.
    zoned = [f.name for f in read.schema.fields if isinstance(f.dataType, T.TimestampType)]
    if schema is None and zoned:
        return read.withColumns({name: ref(name).cast("timestamp_ntz") for name in zoned})
    return read


def decoded(value: Column, charset: str) -> Column:
    """Text that was read as UTF-8 in its real encoding; the reader keeps the bytes."""
    return value if charset == "UTF-8" else F.decode(value.cast("binary"), charset)


def first_lines(spark: SparkSession, path: str, encoding: str, count: int) -> list[str]:
    """The first ``count`` lines, decoded."""
    lines = spark.read.text(path).select(decoded(F.col("value"), java_charset(spark, encoding)).alias("line"))
    lines = [row["line"] for row in lines.take(count)]
    return [lines[0].lstrip("\ufeff"), *lines[1:]] if lines else []


def first_records(
    spark: SparkSession, path: str, encoding: str, delimiter: str, count: int
) -> tuple[list[list[str]], bool]:
    """The first ``count`` records, and whether one of them has a quote that does not close.

    Cells may hold line breaks. Reads that many lines, and twice as many again while records are
    missing. A record that is still open after ``OPEN_LINES`` lines or ``OPEN_CHARS`` characters is
    taken to be its first line, with plain quotes.
    """
    opening = re.compile(quoted.opens(delimiter))
    wanted = count
    while True:
        lines = first_lines(spark, path, encoding, wanted)
        ended, rows, stray, at = len(lines) < wanted, [], False, 0
        while at < len(lines) and len(rows) < count:
            text, last = lines[at], at
            inside = bool(opening.match(text))
            while inside and last + 1 < len(lines) and last - at < OPEN_LINES and len(text) < OPEN_CHARS:
                last += 1
                inside = bool(opening.match('"' + lines[last]))
                text += "\n" + lines[last]
            if inside and not ended and last + 1 == len(lines) and last - at < OPEN_LINES and len(text) < OPEN_CHARS:
                break
            if inside or len(text) > OPEN_CHARS:
                stray |= inside
                row, last = lines[at].split(delimiter), at
            else:
                row = next(csv.reader([part + "\n" for part in text.split("\n")], delimiter=delimiter), [])
            if row and lines[at]:
                rows.append(row)
            at = last + 1
        if len(rows) >= count or ended:
            return rows, stray
        wanted *= 2


def preview_delimited(
    spark: SparkSession,
    path: str,
    *,
    delimiter: str = "comma",
    encoding: str = "utf-8",
    has_header: bool = True,
    limit: int = PREVIEW_ROWS,
) -> tuple[DataFrame, list[str]]:
    """The first records as text, short ones padded with empty cells, and warnings.

    Takes a bounded number of the first lines only, so it costs the same for any size, also where a
    quote is never closed.
    """
    rows, stray = first_records(spark, path, encoding, delimiter_of(delimiter), limit + has_header)
    if not rows:
        raise ValueError(f"No records in {path}")
    header = rows[0] if has_header else [f"column_{i + 1}" for i in range(max(map(len, rows)))]
    warnings = []
    if any(not name.strip() for name in header):
        warnings.append("blank_headers_renamed")
    if len({len(row) for row in rows}) > 1:
        warnings.append("ragged_rows_padded")
    if stray:
        warnings.append("unclosed_quotes")
    names = repaired_names(header)
    body = (rows[1:] if has_header else rows)[:limit]
    padded = [(row + [""] * len(names))[: len(names)] for row in body]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return spark.createDataFrame(padded, schema), warnings


def ragged_rows(spark: SparkSession, path: str, *, delimiter: str = "comma") -> DataFrame:
    """How many lines have how many cells, over the whole input."""
    sep = delimiter_of(delimiter)
    return (
        spark.read.text(path)
        .groupBy(F.size(F.split("value", re.escape(sep), -1)).alias("cells"))
        .agg(F.count(F.lit(1)).alias("lines"))
    )


def malformed_rows(
    spark: SparkSession, path: str, schema: T.StructType, *, delimiter: str = "comma"
) -> DataFrame:
    """One row: how many records do not fit the schema."""
    marked = T.StructType([*schema.fields, T.StructField("_malformed", T.StringType())])
    rows = (
        spark.read.schema(marked)
        .option("sep", delimiter_of(delimiter))
        .option("escape", '"')
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_malformed")
        .csv(path)
    )
    # Asking for every column makes the reader parse all cells of a record.
    parsed = F.coalesce(*[F.col(name).cast("string") for name in schema.names], F.lit("")) >= ""
    return rows.agg(
        F.count_if(F.col("_malformed").isNotNull() & parsed).alias("parse_failure_count")
    )


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def preview_parquet(spark: SparkSession, path: str, *, limit: int = PREVIEW_ROWS) -> DataFrame:
    return spark.read.parquet(path).limit(limit)
