"""Names of helper columns beside columns of any name."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, name: str) -> str:
    """``name`` or a longer form of it that no column of ``df`` has in any case."""
    taken = {column.casefold() for column in df.columns}
    while name.casefold() in taken:
        name += "_"
    return name
