"""Every registered query against its SQL on the smallest scale."""

from __future__ import annotations

import importlib.util
import os
import re

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("check_queries", f"{ROOT}/tools/check_queries.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def views():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, views, name):
    verdict, _ = check.compare(spark, views, FOLDER, name, queries()[name], oracle_sql().get(name))
    # Only the optional corpus operators may come without SQL; their own tests hold them.
    optional = re.match(r"op\d+_|pipeline$", name) and name not in oracle_sql()
    assert verdict.startswith("rows" if optional else "ok"), verdict
    assert " types " not in verdict, verdict


def test_entry_gives_the_flagship_rows(spark):
    result = entry(spark)
    assert result.columns == ["category", "value", "source_count"]
    assert [row["category"] for row in result.collect()][-1] == "Other"
