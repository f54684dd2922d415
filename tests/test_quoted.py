"""Records with line breaks in their cells, read in many splits, against Python's reader."""

from __future__ import annotations

import csv
import io
import random

import pytest

from fathom.sources import tables


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size", ["64", "1000000"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_in_many_splits(spark, tmp_path, small_splits, size, end):
    dealt = random.Random(7)
    cells = ["x", "two words", "a\nb", "\n\n", 'he said "no"', "a,b", '"', "é\nü", ",\n,", 'end"\n', "5\" pipe", "long " * 30]
    rows = [(str(i), dealt.choice(cells), dealt.choice(cells)) for i in range(400)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end)
    writer.writerow(["k", "t", "t"])
    writer.writerows(rows)
    text = out.getvalue().replace('"5"" pipe"', '5" pipe')
    (tmp_path / "a.csv").write_bytes(text.encode())
    small_splits(size)
    df = tables.read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert df.columns == ["k", "t", "t_2"] and df.dtypes[0] == ("k", "int")
    assert sorted((str(a), b, c) for a, b, c in df.collect()) == sorted(rows)
    assert "wholetext" not in df._jdf.queryExecution().executedPlan().toString()


def test_types_schema_and_malformed_records(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿i,l,d,day,at,flag,t,none\n1,3000000000,1.5,2024-01-02,2024-01-02 03:04:05,true,"x\ny",\n\n2,4,2,2024-01-03,2024-01-02,FALSE,1,\n')
    df = tables.read_delimited(spark, str(path), multi_line=True)
    assert [t for _, t in df.dtypes] == ["int", "bigint", "double", "date", "timestamp_ntz", "boolean", "string", "string"]
    assert [tuple(r)[6] for r in df.orderBy("i").collect()] == ["x\ny", "1"] and df.where("none is null").count() == 2
    schema = spark.createDataFrame([], "a string, b int").schema
    path.write_text('a,b\n"1\n2",7\n')
    assert [tuple(r) for r in tables.read_delimited(spark, str(path), multi_line=True, schema=schema).collect()] == [("1\n2", 7)]
    path.write_text('a,b\n"1\n2",x\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        tables.read_delimited(spark, str(path), multi_line=True, schema=schema).collect()
    plain = tables.read_delimited(spark, str(path), multi_line=True, has_header=False, delimiter="pipe")
    assert plain.columns == ["column_1"] and plain.count() == 2


def test_a_stray_quote_ends_the_preview_early(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("k,t\n" + "".join(f'{i},{chr(34) + "stray" if i == 2 else "v"}\n' for i in range(60_000)))
    seen = []
    before, tables.first_lines = tables.first_lines, lambda *a: seen.append(a[-1]) or before(*a)
    try:
        preview, warnings = tables.preview_delimited(spark, str(path), limit=5)
    finally:
        tables.first_lines = before
    assert [tuple(r) for r in preview.collect()] == [("0", "v"), ("1", "v"), ("2", '"stray'), ("3", "v"), ("4", "v")]
    assert warnings == ["unclosed_quotes"] and max(seen) <= 4 * tables.OPEN_LINES
