"""Compact grouping keys for values of any type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.text import digest_long


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def plain_number(value: Column) -> Column:
    """The shortest text of a fraction, without an exponent from 0.0001 up to 10^16."""
    short = value.cast("string")
    digits = short.try_cast("decimal(38,20)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(digits, "0+$", ""), "\\.$", ".0")
    size = F.abs(value)
    in_reach = F.contains(short, F.lit("E")) & (size >= 1e-4) & (size < 1e16)
    return F.when(in_reach, plain).otherwise(short)


def as_text(column: Column, data_type: T.DataType) -> Column:
    """The text form of a value; nested values as JSON, negative zero as zero."""
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return (column + F.lit(0).cast(data_type)).cast("string")
    return column.cast("string")


def grouping_key(column: Column, data_type: T.DataType) -> Column:
    """Equal exactly when the values are equal, and short for long texts."""
    if isinstance(data_type, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
        return digest_long(as_text(column, data_type))
    return column


def row_keys(df: DataFrame) -> DataFrame:
    """One short key per column of every row."""
    return df.select(
        *[
            grouping_key(ref(field.name), field.dataType).alias(f"key_{index}")
            for index, field in enumerate(df.schema.fields)
        ]
    )
