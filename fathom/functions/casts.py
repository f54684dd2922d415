"""Conversions to the six target types and literals of a column's type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The target type names and the words read as yes and no.
TARGET_TYPES = {
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BIGINT": "bigint",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
}
YES_WORDS = ("true", "1", "yes", "y", "是")
NO_WORDS = ("false", "0", "no", "n", "否")

# How every number begins. A text that is none is told by its first letters: the conversion
# would tell it by an exception, which costs some ten times more.
NUMBER_START = "^[\\x00-\\x20]*[-+]?(?:[0-9.]|(?i:inf|nan))"
# A text counts as a number without type suffixes such as 1d or 2f.
NUMBER_SUFFIX = "[dDfF]\\s*$"
# A text counts as a time only with year, month and day.
FULL_DATE = "^\\s*\\d{1,6}[-/]\\d{1,2}[-/]\\d{1,2}"


def text_to_double(text: Column) -> Column:
    value = F.regexp_replace(text, "(?<=\\d)_(?=\\d)", "")
    return F.when(text.rlike(NUMBER_START) & ~value.rlike(NUMBER_SUFFIX), value.try_cast("double"))


def text_to_bigint(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.rint(text_to_double(text)).try_cast("bigint"))


def _dashed(text: Column) -> Column:
    return F.regexp_replace(text, "^(\\s*\\d{1,6})/(\\d{1,2})/(\\d{1,2})", "$1-$2-$3")


def text_to_timestamp(text: Column) -> Column:
    return F.when(text.rlike(FULL_DATE), _dashed(text).try_cast("timestamp_ntz"))


def text_to_date(text: Column) -> Column:
    return F.when(text.rlike(FULL_DATE), _dashed(text).try_cast("date"))


# Date, time and offset of ISO 8601 in the extended or the basic form.
ISO_TIME = (
    "^(\\d{4})(?:-(\\d{2})-(\\d{2})|(\\d{2})(\\d{2}))"
    "(?:.(\\d{2})(?::(\\d{2})(?::(\\d{2})(?:[.,](\\d+))?)?|(\\d{2})(?:(\\d{2})(?:[.,](\\d+))?)?)?"
    "(Z|[+-]\\d{2}(?::?\\d{2}(?::?\\d{2})?)?)?)?$"
)


def iso_timestamp(text: Column) -> Column:
    """A time in ISO 8601 form; one with an offset as UTC; anything else null."""

    def part(*groups: int, default: str = "00") -> Column:
        found = [F.nullif(F.regexp_extract(text, ISO_TIME, group), F.lit("")) for group in groups]
        return F.coalesce(*found, F.lit(default))

    day = F.concat_ws("-", part(1), part(2, 4), part(3, 5))
    seconds = F.concat(part(8, 11), F.lit("."), F.substring(part(9, 12, default="0"), 1, 6))
    local = F.concat_ws(" ", day, F.concat_ws(":", part(6), part(7, 10), seconds))
    offset = F.rpad(F.regexp_replace(part(13, default="+"), "[:Z]", ""), 7, "0")
    sign = F.when(F.startswith(offset, F.lit("-")), -1).otherwise(1)
    units = [F.substring(offset, at, 2).try_cast("int") for at in (2, 4, 6)]
    shift = F.make_dt_interval(hours=sign * units[0], mins=sign * units[1], secs=sign * units[2])
    return F.when(text.rlike(ISO_TIME), local.try_cast("timestamp_ntz") - shift)


def lenient(column: Column, source: T.DataType, target: str) -> Column:
    """Convert to ``target``; values that do not fit become null."""
    spark_type = TARGET_TYPES[target]
    if isinstance(source, T.StringType):
        readers = {
            "DOUBLE": text_to_double,
            "BIGINT": text_to_bigint,
            "TIMESTAMP": text_to_timestamp,
            "DATE": text_to_date,
        }
        return readers[target](column) if target in readers else column.try_cast(spark_type)
    if target == "BIGINT" and isinstance(source, (T.FractionalType,)):
        # Halves round to the even neighbour; a cast alone would cut them off.
        return F.rint(column.cast("double")).try_cast("bigint")
    return column.try_cast(spark_type)


def strict(column: Column, source: T.DataType, target: str) -> Column:
    """Convert to ``target``; a value that does not fit fails the query."""
    converted = lenient(column, source, target)
    message = F.concat(F.lit(f"Cannot convert to {target}: "), column.cast("string"))
    return F.when(
        column.isNotNull() & converted.isNull(), F.raise_error(message).cast(TARGET_TYPES[target])
    ).otherwise(converted)


def typed_literal(value: object, data_type: T.DataType) -> Column:
    """A literal of the column's type; typed text is read as that type first."""
    if isinstance(value, str):
        try:
            if isinstance(data_type, T.IntegralType):
                return F.lit(int(value))
            if isinstance(data_type, T.FractionalType):
                return F.lit(float(value))
        except ValueError:
            return F.lit(value).try_cast(data_type)
        if isinstance(data_type, T.BooleanType):
            word = value.strip().casefold()
            if word in YES_WORDS:
                return F.lit(True)
            if word in NO_WORDS:
                return F.lit(False)
        if isinstance(data_type, T.StringType):
            return F.lit(value)
        return F.lit(value).cast(data_type)
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        # Compare a fraction with whole numbers as fractions instead of cutting it off.
        return F.lit(value)
    return F.lit(value).cast(data_type)
