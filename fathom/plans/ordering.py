"""Positions and quantiles over a whole table without one task seeing all rows."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.statistics import division_up, whole_division
from fathom.plans.keys import ref
from fathom.plans.storage import materialise, materialise_measured

# A range partition holds about this many distinct rows: the number of ranges follows
# from the measured number of rows, whatever it is.
RANGE_ROWS = 1_000_000

# Rank error of approximate percentiles is one part in ``ACCURACY``; brackets
# are three times as wide, and what falls outside is noticed.
ACCURACY = 10_000
MARGIN = 3 / ACCURACY


def counted(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct rows with their count ``n``. Equal rows meet on the map side first."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def positions(counts: DataFrame, *order: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add ``before``, the number of rows sorted ahead of each counted row.

    ``counts`` holds distinct rows with their count ``n``. They are written once
    and counted on the way. ``part`` names the piece a row was summed in.
    """
    stored, measured = materialise_measured(counts, "counts")
    return spread_positions(stored, measured["rows"], *order, range_rows=range_rows)


def spread_positions(
    counts: DataFrame, rows: int, *order: str, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """:func:`positions` for ``rows`` counts that are already written.

    No value is heavier than one counted row, so range partitions come out even.
    Each partition adds up its own counts in sorted order; the totals of the
    partitions (one row each) shift them to table-wide positions.
    """
    spark = counts.sparkSession
    parts = max(1, -(-rows // max(1, range_rows)))
    keys = [F.col(name).asc_nulls_first() for name in order]
    ranged = (
        counts.repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("part", F.spark_partition_id())
    )
    where_n = ranged.columns.index("n")
    names = [*ranged.columns, "local"]

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            n = batch.column(where_n).to_numpy(zero_copy_only=False)
            ends = seen + n.cumsum()
            seen = int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - n)], names=names)

    schema = T.StructType([*ranged.schema.fields, T.StructField("local", T.LongType())])
    stored = materialise(ranged.mapInArrow(running, schema), "positions")
    # One row per partition, whatever the size of the table.
    sizes = stored.groupBy("part").agg(F.max(F.col("local") + F.col("n")).alias("size"))
    shifts, shift = [], 0
    for part, size in sorted(sizes.toLocalIterator()):
        shifts.append((part, shift))
        shift += size
    table = spark.createDataFrame(shifts, "part int, shift long")
    return stored.join(F.broadcast(table), "part").select(
        *counts.columns, "part", (F.col("shift") + F.col("local")).alias("before")
    )


def page_rows(df: DataFrame, order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by ``order``, missing values last.

    A later page is found by the positions of counted keys: its keys, at most ``limit``,
    select its rows, so no task passes over the rows of the pages before. Rows that are
    alike in ``order`` have no order among themselves.
    """
    keys = [ref(name).asc_nulls_last() for name in order]
    if offset <= 0:
        return df.orderBy(*keys).limit(limit)
    parts = [part for i in range(len(order)) for part in (f"_missing_{i}", f"_key_{i}")]
    values = [value for name in order for value in (ref(name).isNull(), ref(name))]
    keyed = df.select(*[value.alias(part) for value, part in zip(values, parts)])
    ranked = positions(counted(keyed, *parts), *parts)
    on_page = (F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)
    wanted = materialise(ranked.where(on_page).select(*parts, "before"), "page")
    start = wanted.agg(F.min("before")).first()[0]
    if start is None or limit <= 0:
        return df.limit(0)
    same = [ref(name).eqNullSafe(wanted[f"_key_{i}"]) for i, name in enumerate(order)]
    rows = df.join(F.broadcast(wanted), functools.reduce(operator.and_, same), "left_semi")
    return rows.orderBy(*keys).offset(offset - start).limit(limit)


def bracket_ends(value: str | Column, probabilities: Sequence[float]) -> Column:
    """Approximate percentiles just below and just above every probability."""
    ends = [end for p in probabilities for end in (max(p - MARGIN, 0.0), min(p + MARGIN, 1.0))]
    return F.percentile_approx(value, ends, ACCURACY)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    *,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per key as an array ``quantiles``.

    Groups without a value are absent. A first pass brackets the quantiles of every
    group, :func:`narrowed_quantiles` finds them inside. The passes are the same for any
    number of groups; :func:`unpivoted` makes columns groups, too.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    present = df.where(F.col(value).isNotNull()).select(
        key.alias("key"), F.col(value).cast("double").alias("value")
    )
    rough = present.groupBy("key").agg(
        F.count(F.lit(1)).alias("total"), bracket_ends("value", probabilities).alias("ends")
    )
    counts = present.withColumn("n", F.lit(1).cast("long"))
    found = narrowed_quantiles(
        counts, materialise(rough, "groups"), probabilities, range_rows=range_rows
    )
    return found.select(*[F.col("key")[name].alias(name) for name in keys], "quantiles")


def unpivoted(df: DataFrame, keys: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """One row a value that is there: keys, the ``position`` of its column and ``value``."""
    entries = F.array(*[F.struct(F.lit(i).alias("position"), v.cast("double").alias("value")) for i, v in enumerate(values)])
    return df.select(*keys, F.inline(entries)).where(F.col("value").isNotNull())


def _asked(probabilities: Sequence[float]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(index).alias("index"), F.lit(float(p)).alias("p"))
            for index, p in enumerate(probabilities)
        ]
    )


def _end(ends: str, side: int, beyond: float) -> Column:
    """An end of a bracket. Groups too small for a margin of two rows are kept as a whole.

    No value is above one that is no number.
    """
    given = F.element_at(ends, F.col("index") * 2 + side)
    return F.when(F.col("total") * MARGIN < 2, F.lit(beyond)).otherwise(given)


def narrowed_quantiles(
    counts: DataFrame,
    groups: DataFrame,
    probabilities: Sequence[float],
    *,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Exact quantiles without moving the bulk of the values.

    ``counts`` has ``key``, ``value`` and count ``n``; ``groups`` has ``key``,
    ``total`` and the bracket ``ends``. One pass counts the values below each
    bracket and keeps the distinct ones inside, a few in ten thousand; while a bracket
    holds more than ``range_rows`` of them it is cut down to the cells around its
    position. What is left of a bracket is summed up in order. Groups whose bracket
    misses its position are done again with open brackets.
    """
    exact = F.col("p") * (F.col("total") - 1)
    wanted = groups.select("key", "total", "ends", F.inline(_asked(probabilities))).select(
        "key",
        "index",
        F.floor(exact).alias("lower"),
        F.least(F.floor(exact) + 1, F.col("total") - 1).alias("upper"),
        (exact - F.floor(exact)).alias("weight"),
        _end("ends", 1, -math.inf).alias("low"),
        _end("ends", 2, math.nan).alias("high"),
    )
    brackets = wanted.select("key", "index", "low", "high")
    near = counts.join(brackets, "key").where(F.col("value") <= F.col("high"))
    # A missing value stands for everything below the bracket.
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))
    kept = near.groupBy("key", "index", inside.alias("value")).agg(F.sum("n").alias("n"))
    kept, measured = materialise_measured(kept, "brackets")
    targets = wanted.drop("low", "high")
    if measured["rows"] > range_rows:
        kept = _refined(kept, targets, range_rows)
    before = Window.partitionBy("key", "index").orderBy(F.col("value").asc_nulls_first())
    at = F.coalesce(F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = kept.withColumn("at", at).join(targets, ["key", "index"])

    def holding(position: str) -> Column:
        hit = (F.col(position) >= F.col("at")) & (F.col(position) < F.col("at") + F.col("n"))
        return F.max(F.when(hit, F.col("value")))

    blended = placed.groupBy("key", "index", "weight").agg(
        holding("lower").alias("low"), holding("upper").alias("high")
    )
    between = F.col("low") + (F.col("high") - F.col("low")) * F.col("weight")
    found = blended.select("key", "index", F.when(F.col("weight") == 0, F.col("low")).otherwise(between).alias("quantile"))
    listed = groups.select("key", "total").join(_per_key(found), "key", "left")
    missing = F.exists(F.col("quantiles"), lambda q: q.isNull()) | (F.size("quantiles") < len(probabilities))
    marked = listed.withColumn("missed", F.coalesce(missing, F.lit(True)))
    stored, seen = materialise_measured(marked, "quantiles", missed=F.count_if("missed"))
    result = stored.where(~F.col("missed")).select("key", "quantiles")
    if not seen["missed"]:
        return result
    ends = F.array(*[F.lit(end) for _ in probabilities for end in (-math.inf, math.nan)])
    open_groups = stored.where("missed").select("key", "total", ends.alias("ends"))
    again = counts.join(open_groups.select("key"), "key", "left_semi")
    return result.unionByName(narrowed_quantiles(again, open_groups, probabilities, range_rows=range_rows))


# A bracket is cut into this many cells at once.
CELLS = 64


def _refined(kept: DataFrame, targets: DataFrame, range_rows: int) -> DataFrame:
    """Brackets cut down until none holds more than ``range_rows`` distinct values."""
    while kept.groupBy("key", "index").count().agg(F.max("count")).first()[0] > range_rows:
        cuts = kept.groupBy("key", "index").agg(
            F.percentile_approx("value", [i / CELLS for i in range(1, CELLS)], ACCURACY).alias("cuts")
        )
        cell = F.when(F.col("value").isNull(), -1).otherwise(F.size(F.filter("cuts", lambda cut: cut < F.col("value"))))
        celled = kept.join(cuts, ["key", "index"]).select("key", "index", "value", "n", cell.alias("cell"))
        cells = celled.groupBy("key", "index", "cell").agg(F.sum("n").alias("size"))
        # At most CELLS + 1 rows a bracket.
        before = Window.partitionBy("key", "index").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = cells.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).join(targets, ["key", "index"])
        needed = (F.col("upper") >= F.col("at")) & (F.col("lower") < F.col("at") + F.col("size")) & (F.col("cell") >= 0)
        ends = placed.groupBy("key", "index").agg(
            F.min(F.when(needed, F.col("cell"))).alias("first"), F.max(F.when(needed, F.col("cell"))).alias("last")
        )
        value = F.when(F.col("cell") >= F.col("first"), F.col("value"))
        near = celled.join(ends, ["key", "index"]).where(F.col("cell") <= F.coalesce("last", F.lit(-1)))
        kept = materialise(near.groupBy("key", "index", value.alias("value")).agg(F.sum("n").alias("n")), "brackets")
    return kept


def _per_key(found: DataFrame) -> DataFrame:
    """One array per key, in the order of the probabilities."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "quantile")))
    return found.groupBy("key").agg(
        F.transform(ordered, lambda entry: entry["quantile"]).alias("quantiles")
    )


def spread_quantiles(
    counts: DataFrame, probabilities: Sequence[float], *, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Quantiles from table-wide positions of distinct ``key`` and ``value`` with count ``n``."""
    ranked = positions(counts.select("key", "value", "n"), "key", "value", range_rows=range_rows)
    spans = ranked.groupBy("key", "part").agg(
        F.min("before").alias("first"), F.sum("n").alias("size")
    )
    groups = spans.groupBy("key").agg(F.min("first").alias("start"), F.sum("size").alias("total"))
    asked = _asked(probabilities)
    exact = F.col("p") * (F.col("total") - 1)
    wanted = (
        groups.select("key", "start", "total", F.inline(asked))
        .withColumn("lower", F.floor(exact))
        .withColumn("weight", exact - F.col("lower"))
        .select(
            "key",
            "index",
            "weight",
            F.explode(
                F.array_distinct(
                    F.array(
                        F.col("lower"), F.least(F.col("lower") + 1, F.col("total") - 1)
                    )
                )
            ).alias("offset"),
            (F.col("start") + F.col("lower")).alias("lower"),
            "start",
        )
        .select("key", "index", "weight", "lower", (F.col("start") + F.col("offset")).alias("at"))
    )
    # A large group spans many partitions: find the one that holds each position first.
    inside = (F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("size"))
    located = wanted.join(spans, "key").where(inside).drop("first", "size")
    hit = (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n"))
    found = ranked.join(located, ["key", "part"]).where(hit)
    is_lower = F.col("at") == F.col("lower")
    low = F.max(F.when(is_lower, F.col("value")))
    high = F.max(F.when(~is_lower, F.col("value")))
    return _per_key(
        found.groupBy("key", "index").agg(
            (low + F.coalesce((high - low) * F.max("weight"), F.lit(0.0))).alias("quantile")
        )
    )


def bucket_means(ranked: DataFrame, x: str, y: str, buckets: int, total: Column) -> DataFrame:
    """Split rows in position order into ``buckets`` even runs: first x, mean y, rows.

    A counted row that reaches over several runs gives each of them its share.
    """
    last = F.col("before") + F.col("n") - 1
    wide = F.lit(buckets).cast("long")
    run = F.explode(
        F.sequence(
            whole_division(F.col("before") * wide, total), whole_division(last * wide, total)
        )
    )
    shared = ranked.select(x, y, "n", "before", run.alias("bucket"))
    begins = F.greatest(F.col("before"), division_up(F.col("bucket") * total, wide))
    ends = F.least(
        F.col("before") + F.col("n"), division_up((F.col("bucket") + 1) * total, wide)
    )
    share = shared.withColumn("share", ends - begins)
    return share.groupBy("bucket").agg(
        F.min(x).alias(x),
        (F.sum(F.col(y) * F.col("share")) / F.sum("share")).alias(y),
        F.sum("share").alias("source_count"),
    )


def every_nth(ranked: DataFrame, columns: Sequence[str], step: Column) -> DataFrame:
    """Rows at positions 0, step, 2·step, … with their position ``at``."""
    first = division_up(F.col("before"), step)
    last = whole_division(F.col("before") + F.col("n") - 1, step)
    return (
        ranked.where(first <= last)
        .select(*columns, F.explode(F.sequence(first, last)).alias("at"))
        .withColumn("at", F.col("at") * step)
    )
