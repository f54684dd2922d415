"""Delimited records whose cells may hold line breaks, read split by split.

Whether a line begins a record depends on all quotes before it, so every line is a map of two
states (inside a quoted cell or not) to two. The maps are composed along each split for both start
states, one row a split is composed along the file, and with that every line knows its state and
the number of its record. Lines of a record then meet, wherever the splits cut it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.plans.keys import ref

# An opened cell: quotes in it are doubled, and a quote within an unquoted cell is a plain character.
_CELL = '"(?:[^"]++|"")*+'


def _patterns(delimiter: str) -> tuple[str, str, str]:
    """The delimiter, what may follow up to the next one, and a cell that begins without a quote."""
    sep = re.escape(delimiter)
    other = f"[^{sep}]*+" if len(delimiter) == 1 else f"(?:(?!{sep}).)*+"
    start = f'[^"{sep}]{other}' if len(delimiter) == 1 else f'(?!"|{sep}).{other}'
    return sep, other, start


def opens(delimiter: str) -> str:
    """A pattern of lines that begin outside of quotes and end inside; also Python's."""
    sep, other, start = _patterns(delimiter)
    return f'(?s)\\A(?:(?:{_CELL}"{other}|{start}|){sep})*+{_CELL}\\Z'


def _cells(record: Column, delimiter: str) -> Column:
    """The cells as they stand; one with text around its quotes, or without its last, takes all that follows."""
    sep, _, start = _patterns(delimiter)
    pattern = f'(?s){sep}({_CELL}"(?={sep}|\\z)|{start}|".*+|)'
    return F.regexp_extract_all(F.concat(F.lit(delimiter), record), F.lit(pattern), F.lit(1))


def _text(cell: Column) -> Column:
    """The text of a cell: none where nothing stands, empty where a pair of quotes stands."""
    bare = F.replace(F.substr(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.when(F.startswith(cell, F.lit('"')), bare).when(cell != "", cell)


def _composed(rows: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """Add the state before each row, ``state_0`` or ``state_1`` by the state the partition begins in.

    ``from_out`` and ``from_in`` say whether a row that begins outside or inside of quotes ends inside.
    The last row that ends alike from both, and the rows since that swap the states, decide.
    """
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = (F.col("from_out") & ~F.col("from_in")).cast("long")
    rows = rows.withColumn("_swaps", F.coalesce(F.sum(swaps).over(before), F.lit(0)))
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct(F.col("from_out").cast("long").alias("state"), F.col("_swaps").alias("swaps")))
    rows = rows.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(before))

    def state(start: int) -> Column:
        since = F.coalesce(F.col("_fixed.state") - F.col("_fixed.swaps"), F.lit(start)) + F.col("_swaps")
        return F.pmod(since, F.lit(2)) == 1

    return rows.withColumns({"state_0": state(0), "state_1": state(1)}).drop("_swaps", "_fixed")


def quoted_records(lines: DataFrame, delimiter: str) -> DataFrame:
    """file, number (from 0 through each file) and text of every record.

    ``lines`` has the lines without their line feeds: file, split, line, value. Blank lines between
    records are dropped; a quote that is never closed makes one record of the rest of its file.
    """
    opening = F.lit(opens(delimiter))
    # A line without quotes keeps its state, so no pattern has to be matched along it.
    quotes = F.contains("value", F.lit('"'))
    marked = lines.select(
        "file", "split", "line", "value",
        F.when(quotes, F.rlike("value", opening)).otherwise(False).alias("from_out"),
        F.when(quotes, F.rlike(F.concat(F.lit('"'), "value"), opening)).otherwise(True).alias("from_in"),
        F.col("value").isin("", "\r").alias("blank"),
    )
    composed = _composed(marked, ["file", "split"], ["line"])
    starts = [(~F.col(f"state_{i}") & ~F.col("blank")).cast("long") for i in (0, 1)]
    # One row a split: where it ends and how many records it begins, from either state.
    ends = [F.when(F.col(f"state_{i}"), F.col("from_in")).otherwise(F.col("from_out")) for i in (0, 1)]
    splits = composed.groupBy("file", "split").agg(
        F.max_by(ends[0], "line").alias("from_out"), F.max_by(ends[1], "line").alias("from_in"),
        F.sum(starts[0]).alias("starts_0"), F.sum(starts[1]).alias("starts_1"),
    )
    scanned = _composed(splits, ["file"], ["split"])
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.sum(F.when(F.col("state_0"), F.col("starts_1")).otherwise(F.col("starts_0"))).over(ahead)
    shifts = scanned.select("file", "split", F.col("state_0").alias("inside"), F.coalesce(begun, F.lit(0)).alias("shift"))
    until = Window.partitionBy("file", "split").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = composed.withColumns({f"count_{i}": F.sum(starts[i]).over(until) for i in (0, 1)})
    placed = counted.join(shifts, ["file", "split"]).select(
        "file", "split", "line", "value", "blank",
        F.when(F.col("inside"), F.col("state_1")).otherwise(F.col("state_0")).alias("inside"),
        (F.col("shift") + F.when(F.col("inside"), F.col("count_1")).otherwise(F.col("count_0")) - 1).alias("number"),
    )
    parts = F.sort_array(F.collect_list(F.struct("split", "line", "value")))
    whole = F.array_join(F.transform(parts, lambda part: part["value"]), "\n")
    records = placed.where("number >= 0 and (inside or not blank)").groupBy("file", "number").agg(whole.alias("value"))
    return records.withColumn("value", F.regexp_replace("value", "\r\\z", ""))


def lines_of(spark: SparkSession, path: str, decode: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines with their place, as they stand between line feeds; ``decode`` brings them to UTF-8.

    A byte order mark is dropped at the start of a file only; Spark's reader does so for UTF-8.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    if decode is None:
        return lines
    begins = (F.col("split") == 0) & (F.col("line") == F.min("line").over(Window.partitionBy("file", "split")))
    value = decode(F.col("value"))
    return lines.withColumn("value", F.when(begins, F.regexp_replace(value, "^\ufeff", "")).otherwise(value))


# The kinds a column of cells may have, in the order they are tried; a column without cells is text.
_KINDS = (
    ("int", lambda c: c.rlike(r"\A[+-]?\d+\z") & c.try_cast("int").isNotNull()),
    ("bigint", lambda c: c.rlike(r"\A[+-]?\d+\z") & c.try_cast("bigint").isNotNull()),
    ("double", lambda c: c.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z|\A[+-]?Inf\z|\ANaN\z")),
    ("date", lambda c: c.rlike(r"\A\d{4}-\d\d-\d\d\z") & c.try_cast("date").isNotNull()),
    ("timestamp_ntz", lambda c: c.rlike(r"\A\d{4}-\d\d-\d\d([T ]\d\d:\d\d.*)?\z") & c.try_cast("timestamp_ntz").isNotNull()),
    ("boolean", lambda c: F.lower(c).isin("true", "false")),
)


def inferred_schema(texts: DataFrame) -> T.StructType:
    """The narrowest type of :data:`_KINDS` that every filled cell of a column fits, in one pass over all rows."""
    cells = [F.nullif(ref(name), F.lit("")) for name in texts.columns]
    wanted = [
        F.bool_and(F.coalesce(test(cell), F.lit(False)) | cell.isNull()).alias(f"{i}_{kind}")
        for i, cell in enumerate(cells)
        for kind, test in _KINDS
    ]
    filled = [F.count(cell).alias(f"{i}_filled") for i, cell in enumerate(cells)]
    row = texts.agg(*wanted, *filled).first()
    fields = []
    for i, name in enumerate(texts.columns):
        kinds = [kind for kind, _ in _KINDS if row[f"{i}_filled"] and row[f"{i}_{kind}"]]
        fields.append(T.StructField(name, T._parse_datatype_string(kinds[0] if kinds else "string")))
    return T.StructType(fields)


def parsed(records: DataFrame, names: list[str], schema: T.StructType | None, delimiter: str) -> DataFrame:
    """Cells of the records by their own types or those of ``schema``; a malformed record fails the query.

    Texts are taken as they stand between their quotes, since Spark's parser drops some characters and
    does not tell an empty text from none. It reads all other types, and whole records in which text
    stands around the quotes of a cell.
    """
    options = {
        "sep": delimiter, "quote": '"', "escape": '"', "mode": "FAILFAST",
        "multiLine": "true", "lineSep": "\n", "maxCharsPerColumn": "-1",
    }

    def typed(value: Column, kinds: dict[str, T.DataType]) -> Column:
        return F.from_csv(value, ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds.items()), options)

    split = records.select("value", _cells(F.col("value"), delimiter).alias("cells"))
    last = F.element_at("cells", -1)
    closed = ~F.startswith(last, F.lit('"')) | F.rlike(last, F.lit(f'\\A{_CELL}"\\z'))

    def cells(types: T.StructType) -> DataFrame:
        kinds = {f"c{i}": field.dataType for i, field in enumerate(types.fields)}
        others = {name: kind for name, kind in kinds.items() if not isinstance(kind, T.StringType)}
        at = {name: F.get("cells", F.lit(i)) for i, name in enumerate(kinds)}
        whole = (F.size("cells") == len(kinds)) & closed
        # A first cell that holds a text keeps a record of missing values from being a blank line.
        short = typed(F.concat_ws(delimiter, F.lit("-"), *[at[name] for name in others]), {"first": T.StringType(), **others})
        rows = split.select("value", "cells", whole.alias("whole"), *([F.when(whole, short).alias("typed")] if others else []))
        own = [(F.col("typed")[name] if name in others else _text(at[name])).alias(name) for name in kinds]
        row = rows.select(F.when(F.col("whole"), F.struct(*own)).otherwise(typed(F.col("value"), kinds)).alias("row"))
        return row.select(*[F.col("row")[f"c{i}"].alias(name) for i, name in enumerate(names)])

    return cells(schema or inferred_schema(cells(T.StructType([T.StructField(name, T.StringType()) for name in names]))))
