from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fathom.sources import corpora, sinks, tables


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_header_repair_and_types(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,a,,b\n1,x,2.5,true\n2,y,3.5,false\n", "utf-8-sig")
    df = tables.read_delimited(spark, path)
    assert df.columns == ["a", "a_2", "column_3", "b"]
    assert [t for _, t in df.dtypes] == ["int", "string", "double", "boolean"]


def test_headerless_semicolons(spark, tmp_path):
    df = tables.read_delimited(spark, write(tmp_path / "a.txt", "1;x\n2;y\n"), delimiter="semicolon", has_header=False)
    assert df.columns == ["column_1", "column_2"] and df.count() == 2


@pytest.mark.parametrize("encoding", ["gb18030", "shift_jis"])
def test_other_encodings(spark, tmp_path, encoding):
    path = write(tmp_path / "a.csv", "名,数\n日本,1\n", encoding)
    df = tables.read_delimited(spark, path, encoding=encoding)
    assert [tuple(row) for row in df.collect()] == [("日本", 1)] and df.columns == ["名", "数"]
    preview, _ = tables.preview_delimited(spark, path, encoding=encoding)
    assert [tuple(row) for row in preview.collect()] == [("日本", "1")]


def test_malformed_records_stop_the_read_or_are_counted(spark, tmp_path):
    path = write(tmp_path / "a.csv", "a,b\n1,2\n3,x\n4\n")
    schema = spark.createDataFrame([], "a int, b int").schema
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        tables.read_delimited(spark, path, schema=schema).collect()
    assert tables.malformed_rows(spark, path, schema).first()[0] == 2


def test_preview_pads_and_warns(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'a,,a\n1\n"x, y",2,3\n' + "4,5,6\n" * 300)
    preview, warnings = tables.preview_delimited(spark, path)
    got = [tuple(row) for row in preview.collect()]
    assert preview.columns == ["a", "column_2", "a_2"] and len(got) == 200
    assert got[:2] == [("1", "", ""), ("x, y", "2", "3")]
    assert warnings == ["blank_headers_renamed", "ragged_rows_padded"]


def test_exports_refuse_existing_targets(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", 'q"', 1)], "t string, u string, n int")
    for fmt in ("csv", "parquet"):
        target = str(tmp_path / fmt)
        done = sinks.export_table(df, target, fmt)
        assert done.rows == 1 and done.bytes_written > 0 and done.kind == "tabular"
        with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
            sinks.export_table(df, target, fmt)
    back = tables.read_delimited(spark, str(tmp_path / "csv"), multi_line=True)
    assert [tuple(row) for row in back.collect()] == [("a\nb", 'q"', 1)]
    with pytest.raises(ValueError):
        sinks.export_table(df, str(tmp_path / "x"), "jsonl")


def test_pasted_text(spark):
    texts = spark.createDataFrame([("log", "der Kran steht\n \nes regnet\n")], "scope string, content string")
    read = corpora.records_from_texts(texts, "c", default_category="Hafen", default_tags=("früh", "Pier 4"), default_source="Wache")
    one, two = read.records.collect()
    assert (one["content"], two["content"]) == ("der Kran steht", "es regnet")
    assert one["tags"] == two["tags"] == ["früh", "Pier 4"] and two["source"] == "Wache"
    assert two["id"] == "text_" + hashlib.sha256("log\0001\0es regnet".encode()).hexdigest()[:16]
    (category,) = read.categories.collect()
    assert category["name"] == "Hafen" and one["primary_category_id"] == category["id"]
    assert read.skipped.first()[0] == 1


def test_files_of_one_name_in_several_folders_keep_their_ids_apart(spark, tmp_path):
    for folder in ("a", "b c"):
        (tmp_path / folder).mkdir()
        write(tmp_path / folder / "part-0.txt", "first\nsecond\n")
    read = corpora.read_text_corpus(spark, f"{tmp_path}/*", "c")
    ids = {row["id"] for row in read.records.collect()}
    assert len(ids) == 4
    made = "text_" + hashlib.sha256("b c/part-0.txt\0001\0second".encode()).hexdigest()[:16]
    assert made in ids
    alone = corpora.read_text_corpus(spark, f"{tmp_path}/a/part-0.txt", "c").records.collect()
    assert "text_" + hashlib.sha256("part-0.txt\0000\0first".encode()).hexdigest()[:16] in {row["id"] for row in alone}


def test_preview_counts_records_with_line_breaks(spark, tmp_path):
    path = write(tmp_path / "a.csv", "k,t\n" + "".join(f'{i},"one\n\nthree {i}"\n' for i in range(40)))
    preview, warnings = tables.preview_delimited(spark, path, limit=5)
    assert [tuple(row) for row in preview.collect()] == [(str(i), f"one\n\nthree {i}") for i in range(5)]
    assert warnings == []
    assert tables.preview_delimited(spark, path)[0].count() == 40


def test_lines_of_a_split_file_are_numbered_through(spark, tmp_path):
    lines = [f" line {i} " if i % 5 else "" for i in range(4000)]
    path = write(tmp_path / "big.txt", "﻿" + "\r\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = corpora.read_text_corpus(spark, path, "c")
        assert corpora.numbered_lines(spark, path).select("split").distinct().count() > 5
        got = {row["content"]: row["id"] for row in read.records.collect()}
        assert read.skipped.first()[0] == 800
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = [line.strip() for line in lines if line.strip()]
    want = {
        text: "text_" + hashlib.sha256(f"big.txt\0{i}\0{text}".encode()).hexdigest()[:16]
        for i, text in enumerate(kept)
    }
    assert got == want


def test_whole_files_by_paragraph(spark, tmp_path):
    write(tmp_path / "a.md", "one\nline\r\n\r\ntwo\n\n\n")
    read = corpora.read_text_corpus(spark, str(tmp_path), "c", mode="paragraph")
    assert [row["content"] for row in read.records.orderBy("content").collect()] == ["one\nline", "two"]
    gb = write(tmp_path / "b.txt", "第一\n第二", "gb18030")
    read = corpora.read_text_corpus(spark, gb, "c", encoding="gb18030")
    assert sorted(row["content"] for row in read.records.collect()) == ["第一", "第二"]


def test_json_records(spark, tmp_path):
    payloads = [
        {"id": "n7", "content": "  wind from west ", "primary_category": "Weather", "tags": ["gale", " gale ", "", "sea"], "source": "buoy", "depth": {"m": [3, 4]}},
        {"content": "\t "},
        {"content": "pump failed", "primary_category": " Repair ", "tags": "pump,night", "record_time": "20240307T2215+0200", "shift": 3},
        {"content": 7.5, "time": "yesterday"},
    ]
    lines = [json.dumps(p) for p in payloads]
    path = write(tmp_path / "watch.jsonl", "\n".join([lines[0], "", "3", *lines[1:]]) + "\n")
    read = corpora.read_jsonl_corpus(spark, path, "c", default_tags=["all"])
    wind, pump, number = (
        {row["content"]: row for row in read.records.collect()}[c] for c in ("wind from west", "pump failed", "7.5")
    )
    assert wind["id"] == "n7" and wind["tags"] == ["all", "gale", "sea"] and wind["source"] == "buoy"
    assert json.loads(wind["custom_fields_json"]) == {"depth": {"m": [3, 4]}}
    assert pump["tags"] == ["all", "pump", "night"] and str(pump["record_time"]) == "2024-03-07 20:15:00"
    assert pump["id"] == "text_" + hashlib.sha256("watch.jsonl\0002\0pump failed".encode()).hexdigest()[:16]
    assert json.loads(pump["custom_fields_json"]) == {"shift": 3} and pump["source"].endswith("watch.jsonl")
    assert number["record_time"] is None and number["primary_category_id"] is None
    assert {row["name"] for row in read.categories.collect()} == {"Weather", "Repair"}
    assert tuple(read.skipped.first()) == (1, 1)


def test_json_records_in_another_encoding(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", json.dumps({"content": "港口"}, ensure_ascii=False) + "\n", "gb18030")
    assert [row["content"] for row in corpora.read_jsonl_corpus(spark, path, "c", encoding="gb18030").records.collect()] == ["港口"]


def test_invalid_json_stops_the_read(spark, tmp_path):
    path = write(tmp_path / "r.jsonl", '{"id": "a", "content": "x"}\n{bad\n')
    with pytest.raises(Exception, match="Not valid JSON"):
        corpora.read_jsonl_corpus(spark, path, "c").records.collect()


def test_corpus_exports(spark, tmp_path):
    records = corpora.corpus_records(
        spark.createDataFrame(
            [("a", "c", "x\ny", "k", ["t", "u"], "", '{"n": 1}'), ("b", "c", "z", None, [], "s", "{}")],
            "id string, corpus_id string, content string, primary_category_id string, tags array<string>, source string, custom_fields_json string",
        ).withColumn("created_at", F.lit("2026-01-01 00:00:00.5").cast("timestamp_ntz"))
    )
    categories = corpora.conform(spark.createDataFrame([("k", "Kind")], "id string, name string"), corpora.CATEGORY_SCHEMA)
    target = str(tmp_path / "j")
    assert sinks.export_corpus(records, categories, target, "jsonl").rows == 2
    payloads = {p["id"]: p for p in (json.loads(row[0]) for row in spark.read.text(target).collect())}
    assert payloads["a"]["tags"] == ["t", "u"] and payloads["a"]["source"] is None
    assert payloads["a"]["custom_fields"] == {"n": 1} and payloads["a"]["primary_category"] == "Kind"
    assert payloads["a"]["created_at"] == "2026-01-01T00:00:00.500000"
    assert payloads["b"]["tags"] == [] and payloads["b"]["primary_category"] == ""
    rows = sinks.corpus_csv_rows(records, categories).collect()
    assert rows[0]["tags"] == "t, u" and rows[1]["location"] == "" and len(rows[0]) == 13
    with pytest.raises(ValueError):
        sinks.export_corpus(records.limit(0), categories, str(tmp_path / "e"), "csv")
    with pytest.raises(ValueError):
        sinks.export_corpus(records, categories, str(tmp_path / "p"), "parquet")
