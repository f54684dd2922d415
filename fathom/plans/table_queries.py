"""Registered queries over the given tables, with the same question in SQL.

Each entry of ``QUERIES`` reads whole tables from a folder. ``ORACLES`` holds
the SQL that must give the same rows. Missing values are made in both, since
the tables hold none.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import findings, profile, reduce, steps
from fathom.plans.storage import scratch_path
from fathom.sources import sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        @functools.wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in which one priority is unknown and pending orders have no price."""
    return table(spark, folder, "orders").withColumns(
        {
            "o_orderpriority": F.nullif("o_orderpriority", F.lit("5-LOW")),
            "o_totalprice": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")),
        }
    )


GAPS = """orders_gaps AS (
    SELECT * REPLACE (NULLIF(o_orderpriority, '5-LOW') AS o_orderpriority,
                      CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice)
    FROM orders)"""


# Steps: projections, filters, sorting, deduplication, aggregation.


@query(
    "select_columns",
    """SELECT o_orderstatus AS status, o_orderkey AS id, o_totalprice AS price FROM orders""",
)
def _(spark, folder):
    return steps.select_columns(
        table(spark, folder, "orders"),
        [
            {"source": "o_orderstatus", "alias": "status"},
            {"source": "o_orderkey", "alias": "id"},
            {"source": "o_totalprice", "alias": "price"},
        ],
    )


def _filtered(name: str, expression: dict, where: str) -> None:
    columns = "o_orderkey, o_orderstatus, o_orderpriority, o_totalprice"
    sql = f"WITH {GAPS} SELECT {columns} FROM orders_gaps WHERE {where}"

    @query(name, sql)
    def run(spark, folder):
        kept = steps.filter_rows(with_gaps(spark, folder), expression)
        return kept.select(*columns.split(", "))


_filtered(
    "filter_equal",
    {"column": "o_orderstatus", "op": "==", "value": "F"},
    "o_orderstatus = 'F'",
)
_filtered(
    "filter_equal_missing",
    {"column": "o_orderpriority", "op": "eq", "value": None},
    "o_orderpriority IS NULL",
)
_filtered(
    "filter_not_equal",
    {"column": "o_orderpriority", "op": "!=", "value": "1-URGENT"},
    "o_orderpriority <> '1-URGENT'",
)
_filtered(
    "filter_not_equal_missing",
    {"column": "o_totalprice", "op": "ne", "value": None},
    "o_totalprice IS NOT NULL",
)
_filtered(
    "filter_compare",
    {
        "op": "and",
        "conditions": [
            {"column": "o_totalprice", "op": ">=", "value": "1000.5"},
            {"column": "o_totalprice", "op": "<", "value": 250000},
            {"column": "o_orderkey", "op": ">", "value": "10"},
            {"column": "o_custkey", "op": "<=", "value": 900},
        ],
    },
    "o_totalprice >= 1000.5 AND o_totalprice < 250000 AND o_orderkey > 10 AND o_custkey <= 900",
)
_filtered(
    "filter_in",
    {"column": "o_orderpriority", "op": "in", "value": ["1-URGENT", "2-HIGH"]},
    "o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
_filtered(
    "filter_contains",
    {"column": "o_orderpriority", "op": "contains", "value": "-M"},
    "contains(o_orderpriority, '-M')",
)
_filtered(
    "filter_contains_literal",
    {"column": "o_orderpriority", "op": "contains", "value": "%E_"},
    "o_orderpriority LIKE '%\\%E\\_%' ESCAPE '\\'",
)
_filtered(
    "filter_starts_with",
    {"column": "o_orderkey", "op": "starts_with", "value": "12"},
    "CAST(o_orderkey AS VARCHAR) LIKE '12%'",
)
_filtered(
    "filter_ends_with",
    {"column": "o_orderpriority", "op": "ends_with", "value": "IED"},
    "o_orderpriority LIKE '%IED'",
)
_filtered(
    "filter_missing",
    {
        "op": "or",
        "conditions": [
            {"column": "o_orderpriority", "op": "is_null"},
            {"column": "o_totalprice", "op": "is_null"},
        ],
    },
    "o_orderpriority IS NULL OR o_totalprice IS NULL",
)
_filtered(
    "filter_present",
    {"column": "o_totalprice", "op": "is_not_null"},
    "o_totalprice IS NOT NULL",
)
_filtered(
    "filter_boolean_tree",
    {
        "op": "and",
        "conditions": [
            {"op": "not", "condition": {"column": "o_orderpriority", "op": "==", "value": "2-HIGH"}},
            {
                "op": "or",
                "conditions": [
                    {"column": "o_totalprice", "op": ">", "value": 300000},
                    {"column": "o_orderstatus", "op": "==", "value": "P"},
                ],
            },
        ],
    },
    "NOT (o_orderpriority = '2-HIGH') AND (o_totalprice > 300000 OR o_orderstatus = 'P')",
)
_filtered(
    "filter_combined",
    steps.combine_filters(
        {"column": "o_orderstatus", "op": "==", "value": "O"},
        {"column": "o_orderpriority", "op": "is_null"},
        "or",
    ),
    "o_orderstatus = 'O' OR o_orderpriority IS NULL",
)


@query(
    "drop_missing",
    f"WITH {GAPS} SELECT o_orderkey, o_totalprice FROM orders_gaps "
    "WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL",
)
def _(spark, folder):
    kept = steps.drop_missing(with_gaps(spark, folder), ["o_totalprice", "o_orderpriority"])
    return kept.select("o_orderkey", "o_totalprice")


@query(
    "fill_missing",
    f"WITH {GAPS} SELECT o_orderkey, COALESCE(o_totalprice, 0.0) AS o_totalprice, "
    "COALESCE(o_orderpriority, 'unknown') AS o_orderpriority FROM orders_gaps",
)
def _(spark, folder):
    filled = steps.fill_missing(
        with_gaps(spark, folder), {"o_totalprice": 0, "o_orderpriority": "unknown"}
    )
    return filled.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    "convert_types",
    """SELECT o_orderkey, TRY_CAST(o_totalprice AS BIGINT) AS o_totalprice,
        TRY_CAST(replace(o_orderpriority, '-', '') AS DOUBLE) AS priority_number,
        TRY_CAST(CAST(o_orderdate AS VARCHAR) AS DATE) AS order_day,
        CAST(o_custkey AS VARCHAR) AS o_custkey,
        TRY_CAST(o_orderstatus AS BOOLEAN) AS status_flag
    FROM orders""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.replace("o_orderpriority", F.lit("-"), F.lit("")).alias("priority_number"),
        F.col("o_orderdate").cast("string").alias("order_day"),
        "o_custkey",
        F.col("o_orderstatus").alias("status_flag"),
    )
    return steps.convert_type(
        orders,
        {
            "o_totalprice": "BIGINT",
            "priority_number": "DOUBLE",
            "order_day": "DATE",
            "o_custkey": "VARCHAR",
            "status_flag": "BOOLEAN",
        },
    )


CHAIN = [
    {"operation": "fill_missing", "parameters": {"values": {"o_totalprice": 0.0}}},
    {
        "operation": "filter_rows",
        "parameters": {"expression": {"column": "o_totalprice", "op": "<", "value": 400000}},
    },
    {
        "operation": "select_columns",
        "parameters": {
            "columns": [
                {"source": "o_orderpriority", "alias": "priority"},
                {"source": "o_custkey", "alias": "customer"},
                {"source": "o_totalprice", "alias": "price"},
            ]
        },
    },
    {"operation": "drop_missing", "parameters": {"columns": ["priority"]}},
    {"operation": "deduplicate_rows", "parameters": {"columns": []}},
    {
        "operation": "group_aggregate",
        "parameters": {
            "group_by": ["priority"],
            "aggregations": [
                {"function": "count", "alias": "orders"},
                {"function": "count_distinct", "column": "customer", "alias": "customers"},
                {"function": "sum", "column": "price", "alias": "revenue"},
            ],
        },
    },
    {
        "operation": "sort_rows",
        "parameters": {"columns": [{"column": "revenue", "direction": "desc"}]},
    },
]
CHAIN_SQL = f"""WITH {GAPS}, kept AS (
    SELECT DISTINCT o_orderpriority AS priority, o_custkey AS customer,
           COALESCE(o_totalprice, 0.0) AS price
    FROM orders_gaps
    WHERE COALESCE(o_totalprice, 0.0) < 400000 AND o_orderpriority IS NOT NULL)
    SELECT priority, COUNT(*) AS orders, COUNT(DISTINCT customer) AS customers,
           ROUND(SUM(price), 2) AS revenue FROM kept GROUP BY priority"""


@query("step_chain", CHAIN_SQL)
def _(spark, folder):
    return rounded(steps.apply_steps(with_gaps(spark, folder), CHAIN), "revenue", digits=2)


@query("saved_transform", CHAIN_SQL)
def _(spark, folder):
    path = scratch_path(spark, "transform")
    sinks.export_table(steps.apply_steps(with_gaps(spark, folder), CHAIN), path, "parquet")
    return rounded(tables.read_parquet(spark, path), "revenue", digits=2)


@query("saved_steps_table", CHAIN_SQL)
def _(spark, folder):
    """The chain saved as a named table, read back from the catalog."""
    name = f"saved_steps_{uuid.uuid4().hex}"
    saved = steps.save_steps(with_gaps(spark, folder), CHAIN, "orders", name, location=scratch_path(spark, "saved-steps"))
    return rounded(saved, "revenue", digits=2)


@query(
    "sort_rows",
    f"""WITH {GAPS} SELECT o_orderkey, ROW_NUMBER() OVER (
        ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderkey) AS place
    FROM orders_gaps""",
)
def _(spark, folder):
    order = [
        {"column": "o_orderpriority", "direction": "desc"},
        {"column": "o_totalprice"},
        {"column": "o_orderkey"},
    ]
    ordered = steps.sort_rows(with_gaps(spark, folder), order).select("o_orderkey")
    # Number the sorted rows across partitions without gathering them.
    return numbered(ordered)


def numbered(ordered: DataFrame) -> DataFrame:
    """Place of every row of a sorted DataFrame, counted across its partitions."""
    from fathom.plans.storage import materialise

    marked = materialise(ordered.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    sizes = marked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    shifts, shift = [], 0
    # One row per partition.
    for number, size in sorted(sizes.toLocalIterator()):
        shifts.append((number, shift))
        shift += size
    ahead = marked.sparkSession.createDataFrame(shifts, "part long, shift long")
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = marked.withColumn("part", part).join(F.broadcast(ahead), "part")
    return placed.select(*ordered.columns, (F.col("shift") + inside + 1).alias("place"))


@query("page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 200 OFFSET 400")
def _(spark, folder):
    rows = steps.page(table(spark, folder, "orders"), ["o_orderdate", "o_orderkey"], 200, 400)
    return rows.select("o_orderkey", "o_orderdate")


@query(
    "first_last_by_time",
    """SELECT MIN(ts) AS first_time, ROUND(ARG_MIN(value, (ts, value)), 6) AS first_value,
        MAX(ts) AS last_time, ROUND(ARG_MAX(value, (ts, value)), 6) AS last_value FROM events""",
)
def _(spark, folder):
    rows = findings.first_last_by_time(table(spark, folder, "events"), "ts", "value")
    return rounded(rows, "first_value", "last_value")


@query("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(spark, folder):
    pairs = table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority")
    return steps.deduplicate_rows(pairs)


@query(
    "distinct_by_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""",
)
def _(spark, folder):
    latest = [F.desc("o_orderdate"), F.asc("o_orderkey")]
    rows = steps.deduplicate_rows(table(spark, folder, "orders"), ["o_custkey"], order_by=latest)
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


@query("distinct_keys", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def _(spark, folder):
    rows = steps.deduplicate_rows(table(spark, folder, "orders"), ["o_custkey", "o_orderstatus"])
    return rows.select("o_custkey", "o_orderstatus")


@query(
    "duplicate_row_count",
    f"""WITH {GAPS}, groups AS (SELECT COUNT(*) AS n FROM orders_gaps
        GROUP BY o_custkey, o_orderstatus, o_orderpriority)
    SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_row_count FROM groups WHERE n > 1""",
)
def _(spark, folder):
    rows = with_gaps(spark, folder).select("o_custkey", "o_orderstatus", "o_orderpriority")
    return steps.duplicate_row_count(rows)


AGGREGATIONS = [
    {"function": "count", "alias": "row_count"},
    {"function": "count_distinct", "column": "o_custkey", "alias": "customers"},
    {"function": "sum", "column": "o_totalprice", "alias": "sum_price"},
    {"function": "mean", "column": "o_totalprice", "alias": "mean_price"},
    {"function": "median", "column": "o_totalprice", "alias": "median_price"},
    {"function": "min", "column": "o_totalprice", "alias": "min_price"},
    {"function": "max", "column": "o_orderdate", "alias": "last_order"},
    {"function": "stddev", "column": "o_totalprice", "alias": "stddev_price"},
]
AGGREGATES_SQL = """COUNT(*) AS row_count, COUNT(DISTINCT o_custkey) AS customers,
    ROUND(SUM(o_totalprice), 2) AS sum_price, ROUND(AVG(o_totalprice), 4) AS mean_price,
    ROUND(MEDIAN(o_totalprice), 4) AS median_price, MIN(o_totalprice) AS min_price,
    MAX(o_orderdate) AS last_order, ROUND(STDDEV_SAMP(o_totalprice), 4) AS stddev_price"""


def _aggregated(df: DataFrame) -> DataFrame:
    df = rounded(df, "sum_price", digits=2)
    return rounded(df, "mean_price", "median_price", "stddev_price", digits=4)


@query(
    "group_aggregate",
    f"WITH {GAPS} SELECT o_orderpriority, {AGGREGATES_SQL} FROM orders_gaps GROUP BY o_orderpriority",
)
def _(spark, folder):
    rows = steps.group_aggregate(with_gaps(spark, folder), ["o_orderpriority"], AGGREGATIONS)
    return _aggregated(rows)


@query("aggregate_all", f"WITH {GAPS} SELECT {AGGREGATES_SQL} FROM orders_gaps")
def _(spark, folder):
    return _aggregated(steps.group_aggregate(with_gaps(spark, folder), [], AGGREGATIONS))


# Profiles.

ORDER_COLUMNS = {
    "o_orderkey": "numeric",
    "o_custkey": "numeric",
    "o_orderstatus": "text",
    "o_totalprice": "numeric",
    "o_orderdate": "datetime",
    "o_orderpriority": "text",
}
EVENT_COLUMNS = {
    "event_id": "numeric",
    "ts": "datetime",
    "user_id": "numeric",
    "event_type": "text",
    "value": "numeric",
    "props": "text",
}
DOCUMENT_COLUMNS = {
    "doc_id": "numeric",
    "text": "text",
    "lang": "text",
    "source": "text",
    "n_chars": "numeric",
}


def _per_column(columns: dict[str, str], build: Callable[[int, str, str], str]) -> str:
    parts = [build(index, name, family) for index, (name, family) in enumerate(columns.items())]
    return "\nUNION ALL\n".join(parts)


def _statistics_sql(source: str) -> Callable[[int, str, str], str]:
    def build(index: int, name: str, family: str) -> str:
        text = f"CAST({name} AS VARCHAR)"
        filled = f"TRIM({text}) <> ''"
        number = f"CAST({name} AS DOUBLE)" if family == "numeric" else "CAST(NULL AS DOUBLE)"
        numeric = f"{filled} AND TRY_CAST({text} AS DOUBLE) IS NOT NULL"
        timed = f"{filled} AND TRY_CAST({text} AS TIMESTAMP) IS NOT NULL"
        outliers = "CAST(NULL AS BIGINT)"
        if family == "numeric":
            outliers = f"""(SELECT COUNT(*) FROM {source}, (SELECT QUANTILE_CONT({number}, 0.25) AS q1,
                QUANTILE_CONT({number}, 0.75) AS q3 FROM {source}) AS q
                WHERE {name} < q1 - 1.5 * (q3 - q1) OR {name} > q3 + 1.5 * (q3 - q1))"""
        return f"""SELECT '{name}' AS "column", COUNT(*) AS row_count,
            COUNT(*) FILTER ({name} IS NULL) AS null_count,
            COUNT(DISTINCT {name}) AS distinct_count,
            ROUND(AVG(LENGTH({text})), 6) AS avg_text_length,
            CAST(MAX(LENGTH({text})) AS BIGINT) AS max_text_length,
            COUNT(*) FILTER ({filled}) AS non_empty_count,
            COUNT(*) FILTER ({numeric}) AS numeric_like_count,
            COUNT(*) FILTER ({timed}) AS datetime_like_count,
            ROUND(MIN({number}), 6) AS min_number, ROUND(MAX({number}), 6) AS max_number,
            ROUND(QUANTILE_CONT({number}, 0.25), 6) AS q1, ROUND(MEDIAN({number}), 6) AS median_value,
            ROUND(QUANTILE_CONT({number}, 0.75), 6) AS q3, ROUND(AVG({number}), 6) AS mean_value,
            ROUND(STDDEV_SAMP({number}), 6) AS stddev_value, {outliers} AS outlier_count,
            ROUND(COUNT(*) FILTER ({name} IS NULL) / COUNT(*), 6) AS missing_ratio
            FROM {source}"""

    return build


def _statistics(df: DataFrame) -> DataFrame:
    columns = profile.column_profiles(df)
    numeric = F.col("q1").isNotNull()
    shown = columns.withColumns(
        {
            "max_text_length": F.col("max_text_length").cast("long"),
            "min_number": F.when(numeric, F.col("min_value")).try_cast("double"),
            "max_number": F.when(numeric, F.col("max_value")).try_cast("double"),
        }
    ).select(
        "column",
        "row_count",
        "null_count",
        "distinct_count",
        "avg_text_length",
        "max_text_length",
        "non_empty_count",
        "numeric_like_count",
        "datetime_like_count",
        "min_number",
        "max_number",
        "q1",
        "median_value",
        "q3",
        "mean_value",
        "stddev_value",
        "outlier_count",
        "missing_ratio",
    )
    return rounded(
        shown,
        "avg_text_length",
        "min_number",
        "max_number",
        "q1",
        "median_value",
        "q3",
        "mean_value",
        "stddev_value",
        "missing_ratio",
    )


@query("column_profile_orders", f"WITH {GAPS} " + _per_column(ORDER_COLUMNS, _statistics_sql("orders_gaps")))
def _(spark, folder):
    return _statistics(with_gaps(spark, folder))


@query("column_profile_events", _per_column(EVENT_COLUMNS, _statistics_sql("events")))
def _(spark, folder):
    return _statistics(table(spark, folder, "events"))


@query("column_profile_documents", _per_column(DOCUMENT_COLUMNS, _statistics_sql("documents")))
def _(spark, folder):
    return _statistics(table(spark, folder, "documents"))


def _top_sql(source: str) -> Callable[[int, str, str], str]:
    return lambda index, name, family: f"""SELECT * FROM (
        SELECT '{name}' AS "column", CAST({name} AS VARCHAR) AS value, COUNT(*) AS count,
            ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, CAST({name} AS VARCHAR)) AS place
        FROM {source} WHERE {name} IS NOT NULL GROUP BY CAST({name} AS VARCHAR)) WHERE place <= 10"""


def _top(df: DataFrame) -> DataFrame:
    counts = profile.written_counts(df)[0]
    named = F.element_at(F.array(*[F.lit(name) for name in df.columns]), F.col("position") + 1)
    return profile.top_values(df, counts).select(
        named.alias("column"), F.posexplode("top_values").alias("place", "entry")
    ).select(
        "column", "entry.value", "entry.count", (F.col("place") + 1).cast("long").alias("place")
    )


@query("top_values_orders", f"WITH {GAPS} " + _per_column(ORDER_COLUMNS, _top_sql("orders_gaps")))
def _(spark, folder):
    return _top(with_gaps(spark, folder))


@query("top_values_documents", _per_column(DOCUMENT_COLUMNS, _top_sql("documents")))
def _(spark, folder):
    return _top(table(spark, folder, "documents"))


@query(
    "schema_listing",
    "SELECT (SELECT COUNT(*) FROM nation) AS row_count, unnest([0, 1, 2]) AS position, "
    "unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS \"column\", "
    "unnest(['int', 'string', 'int']) AS data_type",
)
def _(spark, folder):
    return profile.schema_listing(table(spark, folder, "nation"))


@query(
    "datetime_range",
    "SELECT 'o_orderdate' AS \"column\", MIN(o_orderdate) AS first_time, MAX(o_orderdate) AS last_time FROM orders",
)
def _(spark, folder):
    columns = profile.column_profiles(table(spark, folder, "orders"))
    return columns.where(F.col("semantic_type") == "datetime").select(
        "column",
        F.col("min_value").cast("timestamp_ntz").alias("first_time"),
        F.col("max_value").cast("timestamp_ntz").alias("last_time"),
    )


def roles_table(spark: SparkSession, folder: str) -> DataFrame:
    """Events with columns whose names or values call for every semantic type."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("group_id"),
        F.col("value").alias("site_lat"),
        (F.col("value") + 1).alias("longitude"),
        F.col("event_type").alias("category"),
        F.col("event_type").alias("tags"),
        F.col("event_type").alias("source"),
        (F.col("value") > 10).alias("is_large"),
        "ts",
        "value",
        F.repeat("event_type", F.lit(30)).alias("long_note"),
        F.col("event_type").alias("kind"),
        "props",
        F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("title"),
        F.lit("v1").alias("version"),
        F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string"))
        .otherwise(F.col("event_type"))
        .alias("mixed"),
    )


ROLES_SQL = """roles AS (SELECT event_id AS id, user_id AS group_id, value AS site_lat,
    value + 1 AS longitude, event_type AS category, event_type AS tags, event_type AS source,
    value > 10 AS is_large, ts, value, repeat(event_type, 30) AS long_note, event_type AS kind, props,
    'event-' || CAST(event_id AS VARCHAR) AS title, 'v1' AS version,
    CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS mixed
    FROM events)"""
ROLE_FAMILIES = {
    "id": "numeric",
    "group_id": "numeric",
    "site_lat": "numeric",
    "longitude": "numeric",
    "category": "text",
    "tags": "text",
    "source": "text",
    "is_large": "boolean",
    "ts": "datetime",
    "value": "numeric",
    "long_note": "text",
    "kind": "text",
    "props": "text",
    "title": "text",
    "version": "text",
    "mixed": "text",
}


def _roles_sql(index: int, name: str, family: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    numeric = f"COUNT(*) FILTER (TRIM({text}) <> '' AND TRY_CAST({text} AS DOUBLE) IS NOT NULL)"
    timed = f"COUNT(*) FILTER (TRIM({text}) <> '' AND TRY_CAST({text} AS TIMESTAMP) IS NOT NULL)"
    outliers = "CAST(0 AS BIGINT)"
    if family == "numeric":
        outliers = f"""(SELECT COUNT(*) FROM roles, (SELECT QUANTILE_CONT({name}, 0.25) AS q1,
            QUANTILE_CONT({name}, 0.75) AS q3 FROM roles) AS q
            WHERE {name} < q1 - 1.5 * (q3 - q1) OR {name} > q3 + 1.5 * (q3 - q1))"""
    return f"""SELECT {index} AS position, '{name}' AS "column", '{family}' AS family,
        COUNT(*) AS row_count, COUNT(*) - COUNT({name}) AS null_count,
        COUNT(DISTINCT {name}) AS distinct_count, AVG(LENGTH({text})) AS avg_len,
        MAX(LENGTH({text})) AS max_len, COUNT(*) FILTER (TRIM({text}) <> '') AS filled,
        {numeric} AS numeric_like, {timed} AS time_like, {outliers} AS outliers FROM roles"""


ROLES_STATS = f"""WITH {ROLES_SQL}, stats AS ({_per_column(ROLE_FAMILIES, _roles_sql)}), typed AS (
    SELECT *, CASE
        WHEN "column" LIKE '%\\_lat' ESCAPE '\\' THEN 'geo_latitude'
        WHEN "column" = 'longitude' THEN 'geo_longitude'
        WHEN "column" = 'category' THEN 'primary_category'
        WHEN "column" = 'tags' THEN 'tag_list'
        WHEN "column" = 'source' THEN 'source_reference'
        WHEN ("column" = 'id' OR "column" LIKE '%\\_id' ESCAPE '\\')
            AND distinct_count / row_count >= 0.9 THEN 'identifier'
        WHEN family <> 'text' THEN family
        WHEN max_len >= 120 OR avg_len >= 60 THEN 'long_text'
        WHEN distinct_count <= LEAST(100, GREATEST(20, FLOOR(row_count * 0.5))) THEN 'categorical'
        ELSE 'text' END AS semantic_type FROM stats),
    flagged AS (SELECT *, list_filter([
        CASE WHEN distinct_count = 1 AND row_count > 1 THEN 'constant_column' END,
        CASE WHEN null_count > 0 THEN 'missing_values' END,
        CASE WHEN semantic_type = 'identifier' THEN 'candidate_identifier' END,
        CASE WHEN semantic_type = 'text' THEN 'high_cardinality_text' END,
        CASE WHEN semantic_type = 'categorical' AND distinct_count > 30 THEN 'high_cardinality_category' END,
        CASE WHEN semantic_type IN ('text', 'long_text', 'categorical') AND filled > 1
            AND ((numeric_like / filled >= 0.2 AND numeric_like < filled)
              OR (time_like / filled >= 0.2 AND time_like < filled)) THEN 'mixed_type_values' END,
        CASE WHEN outliers > 0 THEN 'numeric_outlier_candidates' END],
        lambda flag: flag IS NOT NULL) AS warnings FROM typed)"""


@query(
    "semantic_types",
    f"""{ROLES_STATS} SELECT "column", semantic_type, array_to_string(warnings, ',') AS warnings FROM flagged""",
)
def _(spark, folder):
    columns = profile.column_profiles(roles_table(spark, folder))
    return columns.select("column", "semantic_type", F.array_join("warnings", ",").alias("warnings"))


@query(
    "dataset_quality",
    f"""{ROLES_STATS} SELECT MAX(row_count) AS row_count, COUNT(*) AS column_count,
        CAST(0 AS BIGINT) AS duplicate_row_count, CAST(SUM(null_count) AS BIGINT) AS total_missing_values,
        array_to_string(list("column" ORDER BY position) FILTER (list_contains(warnings, 'constant_column')), ',') AS constant_columns,
        array_to_string(list("column" ORDER BY position) FILTER (list_contains(warnings, 'mixed_type_values')), ',') AS mixed_type_columns,
        COALESCE(array_to_string(list("column" ORDER BY position) FILTER (list_contains(warnings, 'high_cardinality_category')
            OR list_contains(warnings, 'high_cardinality_text')), ','), '') AS high_cardinality_columns,
        COALESCE(array_to_string(list("column" || '=' || outliers ORDER BY "column") FILTER (list_contains(warnings, 'numeric_outlier_candidates')), ','), '') AS outlier_columns,
        (SELECT string_agg(semantic_type || '=' || n, ',' ORDER BY semantic_type) FROM
            (SELECT semantic_type, COUNT(*) AS n FROM flagged GROUP BY semantic_type)) AS roles
    FROM flagged""",
)
def _(spark, folder):
    dataset = profile.profile_table(roles_table(spark, folder)).dataset

    def pairs(name: str) -> Column:
        listed = F.transform(
            F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
        )
        return F.array_join(F.array_sort(listed), ",")

    return dataset.select(
        "row_count",
        "column_count",
        "duplicate_row_count",
        "total_missing_values",
        F.array_join("constant_columns", ",").alias("constant_columns"),
        F.array_join("mixed_type_columns", ",").alias("mixed_type_columns"),
        F.array_join("high_cardinality_columns", ",").alias("high_cardinality_columns"),
        pairs("numeric_outlier_columns").alias("outlier_columns"),
        pairs("semantic_type_counts").alias("roles"),
    )


@query(
    "quality_findings",
    f"""{ROLES_STATS}, flat AS (SELECT "column", position, unnest(warnings) AS flag FROM flagged)
    SELECT CASE flag WHEN 'constant_column' THEN 'distinct_count_equals_one'
        WHEN 'mixed_type_values' THEN 'try_cast_number_and_time_counts'
        WHEN 'missing_values' THEN 'column_null_counts' ELSE 'iqr_1_5_full_scan' END AS method,
        CASE WHEN flag = 'missing_values' THEN '' ELSE string_agg("column", ',' ORDER BY position) END AS fields
    FROM flat WHERE flag IN ('constant_column', 'mixed_type_values', 'missing_values', 'numeric_outlier_candidates')
    GROUP BY flag""",
)
def _(spark, folder):
    rows = profile.profile_table(roles_table(spark, folder)).findings
    return rows.select("method", F.array_join("fields", ",").alias("fields"))


@query(
    "parse_failures",
    "SELECT COUNT(*) FILTER (TRY_CAST(o_orderpriority AS BIGINT) IS NULL) AS parse_failure_count FROM orders",
)
def _(spark, folder):
    path = scratch_path(spark, "delimited")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    sinks.export_table(orders, path, "csv")
    schema = orders.schema.__class__.fromDDL("o_orderkey bigint, o_orderpriority bigint")
    return tables.malformed_rows(spark, path, schema)


# Statistical findings.

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pairs_sql(columns: Sequence[str], source: str) -> str:
    parts = []
    for i, left in enumerate(columns):
        for right in columns[i + 1 :]:
            parts.append(
                f"SELECT '{left}' AS left_column, '{right}' AS right_column, "
                f"COUNT(*) FILTER ({left} IS NOT NULL AND {right} IS NOT NULL) AS row_count, "
                f"ROUND(CORR({left}, {right}), 6) AS correlation FROM {source}"
            )
    return "\nUNION ALL\n".join(parts)


LINES_GAPS = """lines_gaps AS (SELECT * REPLACE (
    CASE WHEN l_returnflag <> 'N' THEN l_tax END AS l_tax,
    CASE WHEN l_linestatus = 'F' THEN l_discount END AS l_discount) FROM lineitem)"""


def lines_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumns(
        {
            "l_tax": F.when(F.col("l_returnflag") != "N", F.col("l_tax")),
            "l_discount": F.when(F.col("l_linestatus") == "F", F.col("l_discount")),
        }
    )


@query("correlation_pairs", f"WITH {LINES_GAPS} " + _pairs_sql(NUMBERS, "lines_gaps"))
def _(spark, folder):
    return rounded(findings.correlation_pairs(lines_with_gaps(spark, folder), NUMBERS), "correlation")


# Columns made of the four numbers of a line, each with gaps of its own.
WIDE = {
    f"w{k}": f"CASE WHEN (l_orderkey * 7 + l_linenumber) % {k + 11} <> 0 THEN "
    f"l_quantity * {k % 7 + 1} + l_extendedprice * {k % 5} / 100 + l_discount * {k * k % 91} + l_tax * {k % 13} END"
    for k in range(100)
}
WIDE_SQL = f"""WITH lines AS (SELECT [{", ".join(f"CAST({e} AS DOUBLE)" for e in WIDE.values())}] AS v FROM lineitem),
    pairs AS (SELECT a.i AS i, b.i AS j FROM range(1, 101) a(i) JOIN range(1, 101) b(i) ON a.i < b.i)
    SELECT 'w' || (i - 1) AS left_column, 'w' || (j - 1) AS right_column, COUNT(v[i] + v[j]) AS row_count,
        ROUND(CORR(v[i], v[j]), 6) AS correlation FROM lines CROSS JOIN pairs GROUP BY i, j"""


@query("correlation_wide", WIDE_SQL)
def _(spark, folder):
    wide = table(spark, folder, "lineitem").select(*[F.expr(e).alias(name) for name, e in WIDE.items()])
    return rounded(findings.correlation_pairs(wide, list(WIDE)), "correlation")


TREND_SQL = """SELECT 'ts' AS time_column, '{0}' AS numeric_column, COUNT(*) AS row_count,
    ROUND(CORR(EPOCH(ts), {0}), 6) AS correlation,
    ROUND(REGR_SLOPE({0}, EPOCH(ts)) * 86400, 6) AS slope_per_day,
    MIN(ts) AS first_time, MAX(ts) AS last_time,
    ROUND(ARG_MIN(CAST({0} AS DOUBLE), (ts, {0})), 6) AS first_value,
    ROUND(ARG_MAX(CAST({0} AS DOUBLE), (ts, {0})), 6) AS last_value FROM events"""


def _rounded_trends(rows: DataFrame) -> DataFrame:
    return rounded(rows, "correlation", "slope_per_day", "first_value", "last_value")


@query("trend_statistics", " UNION ALL ".join(TREND_SQL.format(c) for c in ("event_id", "user_id", "value")))
def _(spark, folder):
    events = table(spark, folder, "events")
    return _rounded_trends(findings.trend_statistics(events, ["ts"], ["event_id", "user_id", "value"]))


GROUP_SQL = """SELECT '{1}' AS category_column, '{2}' AS numeric_column,
    CAST(SUM(n) AS BIGINT) AS row_count, COUNT(*) AS category_count,
    ARG_MIN(c, (-m, c)) AS top_category, ROUND(ARG_MIN(m, (-m, c)), 6) AS top_mean,
    ARG_MIN(n, (-m, c)) AS top_count,
    ARG_MAX(c, (-m, c)) AS bottom_category, ROUND(ARG_MAX(m, (-m, c)), 6) AS bottom_mean,
    ARG_MAX(n, (-m, c)) AS bottom_count,
    ROUND(ARG_MIN(m, (-m, c)) - ARG_MAX(m, (-m, c)), 6) AS mean_difference,
    ROUND(ARG_MIN(m, (-m, c)) / NULLIF(ARG_MAX(m, (-m, c)), 0), 6) AS mean_ratio
    FROM (SELECT {1} AS c, AVG({2}) AS m, COUNT({2}) AS n FROM {0}
          WHERE {1} IS NOT NULL AND {2} IS NOT NULL GROUP BY {1} HAVING COUNT(*) >= 2)
    HAVING COUNT(*) >= 2"""


def _rounded_groups(rows: DataFrame) -> DataFrame:
    return rounded(rows, "top_mean", "bottom_mean", "mean_difference", "mean_ratio")


@query(
    "group_differences",
    f"WITH {LINES_GAPS} "
    + " UNION ALL ".join(
        GROUP_SQL.format("lines_gaps", c, n)
        for c in ("l_returnflag", "l_linestatus")
        for n in ("l_quantity", "l_tax", "l_discount")
    ),
)
def _(spark, folder):
    rows = findings.group_differences(
        lines_with_gaps(spark, folder),
        ["l_returnflag", "l_linestatus"],
        ["l_quantity", "l_tax", "l_discount"],
    )
    return _rounded_groups(rows)


@query(
    "trend_findings",
    "SELECT *, ROW_NUMBER() OVER (ORDER BY ABS(correlation) DESC, numeric_column) AS place FROM ("
    + " UNION ALL ".join(TREND_SQL.format(c) for c in ("event_id", "user_id", "value"))
    + ") WHERE ABS(correlation) >= 0.6 QUALIFY place <= 2",
)
def _(spark, folder):
    rows = findings.trend_findings(table(spark, folder, "events"), ["ts"], ["event_id", "user_id", "value"])
    return _rounded_trends(rows).withColumn("place", F.col("place").cast("long"))


DERIVED_SQL = """derived AS (SELECT *, l_extendedprice * (1 - l_discount) AS net,
    l_extendedprice * (1 + l_tax) AS gross FROM lineitem)"""
DERIVED_NUMBERS = ["l_quantity", "l_extendedprice", "net", "gross"]


def derived_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").withColumns(
        {
            "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
            "gross": F.col("l_extendedprice") * (1 + F.col("l_tax")),
        }
    )


@query(
    "correlation_findings",
    f"WITH {DERIVED_SQL} SELECT *, ROW_NUMBER() OVER (ORDER BY ABS(correlation) DESC) AS place FROM ("
    + _pairs_sql(DERIVED_NUMBERS, "derived")
    + ") WHERE ABS(correlation) >= 0.7 QUALIFY place <= 2",
)
def _(spark, folder):
    rows = findings.correlation_findings(derived_lines(spark, folder), DERIVED_NUMBERS)
    return rounded(rows, "correlation").withColumn("place", F.col("place").cast("long"))


@query(
    "group_difference_findings",
    "SELECT *, ROW_NUMBER() OVER (ORDER BY ABS(mean_difference) DESC) AS place FROM ("
    + " UNION ALL ".join(
        GROUP_SQL.format("lineitem", c, n)
        for c in ("l_returnflag", "l_linestatus")
        for n in ("l_quantity", "l_extendedprice", "l_discount")
    )
    + ") WHERE mean_difference <> 0 QUALIFY place <= 4",
)
def _(spark, folder):
    rows = findings.group_difference_findings(
        table(spark, folder, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        ["l_quantity", "l_extendedprice", "l_discount"],
    )
    return _rounded_groups(rows).withColumn("place", F.col("place").cast("long"))


@query(
    "analyze_table",
    "WITH g AS ("
    + " UNION ALL ".join(GROUP_SQL.format("customer", "c_mktsegment", n) for n in ("c_custkey", "c_nationkey", "c_acctbal"))
    + """) SELECT 'group_mean_difference' AS method, category_column || ',' || numeric_column AS fields,
        top_category AS top_category, bottom_category AS bottom_category,
        ROW_NUMBER() OVER (ORDER BY ABS(mean_difference) DESC) AS finding FROM g""",
)
def _(spark, folder):
    customers = table(spark, folder, "customer")
    columns = profile.profile_table(customers).columns
    found = findings.analyze_table(customers, columns)
    return found.select(
        "method",
        F.array_join("fields", ",").alias("fields"),
        F.col("evidence")["top_category"].alias("top_category"),
        F.col("evidence")["bottom_category"].alias("bottom_category"),
        F.col("finding").cast("long").alias("finding"),
    )


@query(
    "analyze_narrow_table",
    "SELECT 'field_screening' AS method, CAST(COUNT(*) AS VARCHAR) AS row_count FROM region",
)
def _(spark, folder):
    regions = table(spark, folder, "region").select("r_name")
    found = findings.analyze_table(regions, profile.column_profiles(regions))
    return found.select("method", F.col("evidence")["row_count"].alias("row_count"))


# Reductions.


@query(
    "time_series_means",
    """WITH numbered AS (SELECT ts, value, ROW_NUMBER() OVER (ORDER BY ts, value) AS rn,
        COUNT(*) OVER () AS total FROM events),
    bucketed AS (SELECT ((rn - 1) * 300) // total AS bucket, ts, value FROM numbered)
    SELECT MIN(ts) AS x, ROUND(AVG(value), 6) AS y, COUNT(*) AS source_count FROM bucketed GROUP BY bucket""",
)
def _(spark, folder):
    return rounded(reduce.time_series(table(spark, folder, "events"), "ts", "value", target_points=300).rows, "y")


@query(
    "time_series_means_heavy_days",
    """WITH numbered AS (SELECT o_orderdate, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_totalprice) AS rn,
        COUNT(*) OVER () AS total FROM orders),
    bucketed AS (SELECT ((rn - 1) * 97) // total AS bucket, o_orderdate, o_totalprice FROM numbered)
    SELECT MIN(o_orderdate) AS x, ROUND(AVG(o_totalprice), 4) AS y, COUNT(*) AS source_count
    FROM bucketed GROUP BY bucket""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    # The spread form that large tables take.
    rows = reduce.time_series(orders, "o_orderdate", "o_totalprice", target_points=97, range_rows=2_000)
    return rounded(rows.rows, "y", digits=4)


@query("time_series_raw", "SELECT ts AS x, value AS y, CAST(1 AS BIGINT) AS source_count FROM events")
def _(spark, folder):
    events = table(spark, folder, "events")
    return reduce.time_series(events, "ts", "value", target_points=10_000_000).rows


@query(
    "category_means",
    """WITH g AS (SELECT p_brand AS category, COUNT(*) AS n, AVG(p_retailprice) AS m FROM part GROUP BY p_brand),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, category) AS rank FROM g)
    SELECT CASE WHEN rank <= 5 THEN category ELSE 'Other' END AS category,
        ROUND(SUM(m * n) / SUM(n), 6) AS value, CAST(SUM(n) AS BIGINT) AS source_count FROM r GROUP BY 1""",
)
def _(spark, folder):
    rows = reduce.category_means(table(spark, folder, "part"), "p_brand", "p_retailprice", limit=5).rows
    return rounded(rows, "value")


FLAGSHIP_SQL = """WITH g AS (SELECT o_orderpriority AS category, COUNT(*) AS n, AVG(o_totalprice) AS m
        FROM orders GROUP BY o_orderpriority),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, category) AS rank FROM g)
    SELECT CASE WHEN rank <= 3 THEN category ELSE 'Other' END AS category,
        ROUND(SUM(m * n) / SUM(n), 4) AS value, CAST(SUM(n) AS BIGINT) AS source_count FROM r GROUP BY 1"""


@query("category_means_orders", FLAGSHIP_SQL)
def flagship(spark, folder):
    orders = table(spark, folder, "orders")
    rows = reduce.category_means(orders, "o_orderpriority", "o_totalprice", limit=3).rows
    return rounded(rows, "value", digits=4)


@query(
    "category_counts",
    """WITH g AS (SELECT p_brand AS category, COUNT(*) AS n FROM part GROUP BY p_brand),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, category) AS rank FROM g)
    SELECT CASE WHEN rank <= 7 THEN category ELSE 'Other' END AS category,
        CAST(SUM(n) AS BIGINT) AS source_count FROM r GROUP BY 1""",
)
def _(spark, folder):
    return reduce.category_counts(table(spark, folder, "part"), "p_brand", limit=7).rows


def _histogram_sql(source: str, column: str, bins: int) -> str:
    return f"""WITH s AS (SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {source}),
    b AS (SELECT lo, hi, CASE WHEN hi = lo THEN 0 ELSE LEAST({bins} - 1, GREATEST(0,
        CAST(FLOOR((({column} - lo) / (hi - lo)) * {bins}) AS BIGINT))) END AS i FROM {source}, s)
    SELECT ROUND(lo + (hi - lo) * i / {bins}, 6) AS bin_start, ROUND(lo + (hi - lo) * (i + 1) / {bins}, 6) AS bin_end,
        COUNT(*) AS source_count FROM b GROUP BY i, lo, hi"""


@query("histogram", _histogram_sql("events", "value", 30))
def _(spark, folder):
    rows = reduce.histogram(table(spark, folder, "events"), "value").rows
    return rounded(rows, "bin_start", "bin_end")


@query(
    "histogram_constant",
    "SELECT CAST(0 AS DOUBLE) AS bin_start, CAST(0 AS DOUBLE) AS bin_end, COUNT(*) AS source_count FROM events",
)
def _(spark, folder):
    flat = table(spark, folder, "events").withColumn("zero", F.col("event_id") * 0)
    return rounded(reduce.histogram(flat, "zero").rows, "bin_start", "bin_end")


@query(
    "scatter_sample",
    """WITH numbered AS (SELECT l_quantity AS x, l_extendedprice AS y,
        ROW_NUMBER() OVER (ORDER BY l_quantity, l_extendedprice) AS rn, COUNT(*) OVER () AS total FROM lineitem)
    SELECT x, y FROM numbered WHERE (rn - 1) % CAST(CEIL(total / 700.0) AS BIGINT) = 0 ORDER BY rn LIMIT 700""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem")
    return reduce.scatter_sample(lines, "l_quantity", "l_extendedprice", target_points=700).rows


@query(
    "scatter_sample_heavy_points",
    """WITH numbered AS (SELECT l_quantity AS x, l_discount AS y,
        ROW_NUMBER() OVER (ORDER BY l_quantity, l_discount) AS rn, COUNT(*) OVER () AS total FROM lineitem)
    SELECT x, y FROM numbered WHERE (rn - 1) % CAST(CEIL(total / 900.0) AS BIGINT) = 0 ORDER BY rn LIMIT 900""",
)
def _(spark, folder):
    lines = table(spark, folder, "lineitem")
    # The spread form that large tables take.
    return reduce.scatter_sample(lines, "l_quantity", "l_discount", target_points=900, range_rows=2_000).rows


@query("scatter_raw", "SELECT CAST(c_nationkey AS DOUBLE) AS x, c_acctbal AS y FROM customer")
def _(spark, folder):
    rows = reduce.scatter_sample(table(spark, folder, "customer"), "c_nationkey", "c_acctbal", target_points=10_000_000)
    return rows.rows


@query(
    "density",
    """WITH s AS (SELECT MIN(l_quantity) AS x0, MAX(l_quantity) AS x1, MIN(l_extendedprice) AS y0, MAX(l_extendedprice) AS y1 FROM lineitem),
    b AS (SELECT s.*, LEAST(49, GREATEST(0, CAST(FLOOR(((l_quantity - x0) / (x1 - x0)) * 50) AS BIGINT))) AS i,
        LEAST(49, GREATEST(0, CAST(FLOOR(((l_extendedprice - y0) / (y1 - y0)) * 50) AS BIGINT))) AS j FROM lineitem, s)
    SELECT ROUND(x0 + (x1 - x0) * (i + 0.5) / 50, 6) AS x, ROUND(y0 + (y1 - y0) * (j + 0.5) / 50, 6) AS y,
        COUNT(*) AS source_count FROM b GROUP BY i, j, x0, x1, y0, y1""",
)
def _(spark, folder):
    rows = reduce.density(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice").rows
    return rounded(rows, "x", "y")


CROSSTAB_SQL = """WITH c AS (SELECT p_brand AS a, p_type AS b FROM part),
    ra AS (SELECT a, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, a) AS rank FROM c GROUP BY a),
    rb AS (SELECT b, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, b) AS rank FROM c GROUP BY b),
    long AS (SELECT CASE WHEN ra.rank <= 5 THEN c.a ELSE 'Other' END AS x,
        CASE WHEN rb.rank <= 3 THEN c.b ELSE 'Other' END AS y, COUNT(*) AS source_count
    FROM c JOIN ra ON c.a = ra.a JOIN rb ON c.b = rb.b GROUP BY 1, 2)"""


@query("crosstab", CROSSTAB_SQL + " SELECT x, y, source_count FROM long")
def _(spark, folder):
    return reduce.crosstab(table(spark, folder, "part"), "p_brand", "p_type", x_limit=5, y_limit=3).rows


@query(
    "box_quantiles",
    """WITH c AS (SELECT p_brand AS category, p_retailprice AS value FROM part),
    r AS (SELECT category, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, category) AS rank FROM c GROUP BY category)
    SELECT category, MIN(value) AS lower_fence, ROUND(QUANTILE_CONT(value, 0.25), 6) AS q1,
        ROUND(MEDIAN(value), 6) AS median, ROUND(QUANTILE_CONT(value, 0.75), 6) AS q3,
        MAX(value) AS upper_fence, COUNT(*) AS source_count
    FROM c JOIN r USING (category) WHERE rank <= 6 GROUP BY category""",
)
def _(spark, folder):
    rows = reduce.box_quantiles(table(spark, folder, "part"), "p_brand", "p_retailprice", limit=6).rows
    return rounded(rows, "q1", "median", "q3")


@query(
    "box_quantiles_spread",
    """SELECT o_orderpriority AS category, MIN(o_totalprice) AS lower_fence,
        ROUND(QUANTILE_CONT(o_totalprice, 0.25), 4) AS q1, ROUND(MEDIAN(o_totalprice), 4) AS median,
        ROUND(QUANTILE_CONT(o_totalprice, 0.75), 4) AS q3, MAX(o_totalprice) AS upper_fence,
        COUNT(*) AS source_count FROM orders GROUP BY o_orderpriority""",
)
def _(spark, folder):
    orders = table(spark, folder, "orders")
    # The spread form that large tables take.
    rows = reduce.box_quantiles(orders, "o_orderpriority", "o_totalprice", range_rows=2_000).rows
    return rounded(rows, "q1", "median", "q3", digits=4)


def _matrix_sql(columns: Sequence[str], source: str) -> str:
    parts = []
    for x in columns:
        for y in columns:
            value = f"CASE WHEN COUNT({x}) > 0 THEN 1.0 END" if x == y else f"CORR({x}, {y})"
            parts.append(
                f"SELECT '{x}' AS x, '{y}' AS y, ROUND(CAST({value} AS DOUBLE), 6) AS value, "
                f"COUNT(*) FILTER ({x} IS NOT NULL AND {y} IS NOT NULL) AS source_count FROM {source}"
            )
    return "\nUNION ALL\n".join(parts)


@query("correlation_matrix", f"WITH {LINES_GAPS} " + _matrix_sql(NUMBERS, "lines_gaps"))
def _(spark, folder):
    return rounded(reduce.correlation_matrix(lines_with_gaps(spark, folder), NUMBERS).rows, "value")


def _metadata(meta: DataFrame) -> DataFrame:
    return meta.select("original_rows", "rendered_rows", "method", "approximate")


@query(
    "reduction_metadata",
    """SELECT COUNT(*) AS original_rows, CAST(8 AS BIGINT) AS rendered_rows, 'top_n_with_other' AS method, FALSE AS approximate FROM part
    UNION ALL SELECT COUNT(*), CAST(300 AS BIGINT), 'time_window_mean', TRUE FROM events
    UNION ALL SELECT COUNT(*), CAST(CEIL(COUNT(*) / CEIL(COUNT(*) / 700.0)) AS BIGINT), 'uniform_sample', TRUE FROM lineitem
    UNION ALL SELECT COUNT(*), CAST(6 AS BIGINT), 'box_quantiles_top_n', TRUE FROM part
    UNION ALL SELECT COUNT(*), CAST(16 AS BIGINT), 'pearson_correlation_matrix', FALSE FROM lineitem""",
)
def _(spark, folder):
    part, events, lines = (table(spark, folder, name) for name in ("part", "events", "lineitem"))
    described = [
        reduce.category_counts(part, "p_brand", limit=7).metadata,
        reduce.time_series(events, "ts", "value", target_points=300).metadata,
        reduce.scatter_sample(lines, "l_quantity", "l_extendedprice", target_points=700).metadata,
        reduce.box_quantiles(part, "p_brand", "p_retailprice", limit=6).metadata,
        reduce.correlation_matrix(lines, NUMBERS).metadata,
    ]
    return functools.reduce(DataFrame.unionByName, [_metadata(meta) for meta in described])


@query(
    "pivot_grid",
    """WITH g AS (SELECT o_orderstatus AS x, o_orderpriority AS y, COUNT(*) AS n FROM orders GROUP BY 1, 2)
    SELECT y, CAST(COALESCE(SUM(n) FILTER (x = 'F'), 0) AS BIGINT) AS "F", CAST(COALESCE(SUM(n) FILTER (x = 'O'), 0) AS BIGINT) AS "O",
        CAST(COALESCE(SUM(n) FILTER (x = 'P'), 0) AS BIGINT) AS "P" FROM g GROUP BY y""",
)
def _(spark, folder):
    rows = reduce.crosstab(table(spark, folder, "orders"), "o_orderstatus", "o_orderpriority").rows
    return reduce.grid(rows)


# Sources and sinks over tables that were just written from the given ones.


@query("parquet_round_trip", "SELECT * FROM customer")
def _(spark, folder):
    path = scratch_path(spark, "table")
    sinks.export_table(table(spark, folder, "customer"), path, "parquet")
    return tables.read_parquet(spark, path)


DOCUMENT_DIGESTS = "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents"


@query("csv_round_trip", DOCUMENT_DIGESTS)
def _(spark, folder):
    path = scratch_path(spark, "delimited")
    documents = table(spark, folder, "documents")
    sinks.export_table(documents, path, "csv")
    back = tables.read_delimited(spark, path, schema=documents.schema, multi_line=True)
    return back.withColumn("text", F.md5("text")).withColumnRenamed("text", "digest")


@query("csv_multiline_round_trip", "SELECT doc_id, md5(text || chr(13) || chr(10) || '\"x\"') AS digest, lang, n_chars FROM documents")
def _(spark, folder):
    path = scratch_path(spark, "delimited")
    broken = F.concat("text", F.lit('\r\n"x"')).alias("text")
    rows = table(spark, folder, "documents").select("doc_id", broken, "lang", "n_chars")
    rows.write.options(**sinks.CSV_CELLS).option("sep", ";").option("header", True).csv(path)
    back = tables.read_delimited(spark, path, delimiter="semicolon", multi_line=True)
    return back.select(F.col("doc_id").cast("long"), F.md5("text").alias("digest"), "lang", F.col("n_chars").cast("long"))


@query(
    "csv_type_inference",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def _(spark, folder):
    path = scratch_path(spark, "delimited")
    customers = table(spark, folder, "customer")
    customers.write.option("sep", "|").option("header", True).csv(path)
    inferred = tables.read_delimited(spark, path, delimiter="pipe")
    return inferred.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query(
    "delimited_line_widths",
    "SELECT 5 AS cells, COUNT(*) AS lines FROM customer",
)
def _(spark, folder):
    path = scratch_path(spark, "delimited")
    table(spark, folder, "customer").write.option("sep", "\t").csv(path)
    return tables.ragged_rows(spark, path, delimiter="tab")


@query("export_result", "SELECT 'parquet' AS format, 'tabular' AS kind, COUNT(*) AS row_count FROM orders")
def _(spark, folder):
    done = sinks.export_table(table(spark, folder, "orders"), scratch_path(spark, "table"))
    return spark.createDataFrame(
        [(done.format, done.kind, done.rows)], "format string, kind string, row_count long"
    )
