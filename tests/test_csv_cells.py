"""Cells of any text come back from CSV as they were written, against the queries' SQL."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from fathom.sources import sinks, tables

TEXTS = [
    None, "", " ", "  lead", "trail\t", "\n", "\nlead", "trail\r\n", "\r", "a\rb", "a\r\nb", "\n\n\n", '"', '""', '"a', 'a"', '","', ',"', "a,b",
    "a;b", '";', "\\", '\\"', "#c", "\x00", '\x00"', "a\x00", "\x0b", "\x1c", "\x85", "\u2028", "\ufeff", 'a\n\ufeff"b"\n', "\uffff", "1", "😀",
]
KINDS = [("en", "src1"), ("en", "src0"), (None, None), ("", ""), (" ", "\n"), ('"\r', "e,n")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """documents and labels with every text under every kind of language and source."""
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(text, *kind) for text in TEXTS for kind in KINDS]
    documents = [(i, *row, i if i % 5 else None) for i, row in enumerate(rows)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2 if i % 3 else None, i % 7 % 2) for i in range(0, len(rows), 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return folder


def differences(spark, folder, name):
    """Rows of the query that its SQL does not have, and the other way round."""
    connection = duckdb.connect()
    for table in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cursor = connection.execute(oracle_sql()[name])
    columns = [entry[0] for entry in cursor.description]
    got = sorted((tuple(row) for row in queries()[name](spark, folder).select(*columns).collect()), key=repr)
    want = sorted(cursor.fetchall(), key=repr)
    assert len(got) == len(want)
    return [(one, other) for one, other in zip(got, want) if one != other]


def test_corpus_export_keeps_every_content(spark, odd):
    assert differences(spark, odd, "corpus_csv_export") == []


def test_two_quotes_are_an_empty_text_and_no_number(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,t,u\n"",,x\n"7","","y"\n8,"a ""b""",z"z\n')
    read = tables.read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert read.dtypes[0] == ("n", "int")
    assert sorted(map(tuple, read.collect()), key=repr) == [(7, "", "y"), (8, 'a "b"', 'z"z'), (None, None, "x")]


@pytest.mark.parametrize("record", ["1", '1,"x"y', "1,x,y", '1,"x"y,z', '1,x,"y"z'])
def test_records_of_another_width_still_stop_the_read(spark, tmp_path, record):
    (tmp_path / "a.csv").write_text(f'n,t,u\n1,"x\ny",z\n{record}\n' if record != "1,x,y" else 'n,t\n1,"x\ny"\n1,x,y\n')
    schema = spark.createDataFrame([], "n int, t string" + (", u string" if record != "1,x,y" else "")).schema
    read = tables.read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True, schema=schema)
    if record in ('1,"x"y,z', '1,x,"y"z'):
        assert read.count() == 2 and len(read.collect()) == 2
    else:
        with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
            read.collect()


@pytest.mark.parametrize("encoding", ["utf-8", "gb18030"])
def test_only_the_mark_at_the_start_of_a_file_is_dropped(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes('\ufeff"x\ny",1\n"p\n\ufeffq",2\n'.encode(encoding))
    read = tables.read_delimited(spark, str(tmp_path / "a.csv"), encoding=encoding, has_header=False, multi_line=True)
    assert sorted(map(tuple, read.collect())) == [("p\n\ufeffq", 2), ("x\ny", 1)]


def test_multiline_round_trip_keeps_every_text(spark, odd):
    assert differences(spark, odd, "csv_multiline_round_trip") == []


def test_table_round_trip_keeps_every_cell(spark, odd):
    assert differences(spark, odd, "csv_round_trip") == []


def test_table_export_keeps_the_ends_of_cells(spark, tmp_path):
    rows = [(" a ", "\r"), ("", None), (None, "\tb\n")]
    df = spark.createDataFrame(rows, "t string, u string")
    sinks.export_table(df, str(tmp_path / "out"), "csv")
    back = tables.read_delimited(spark, str(tmp_path / "out"), schema=df.schema, multi_line=True)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(rows, key=repr)
