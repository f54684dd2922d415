"""Segments of text files read in many splits against the same text in one piece."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from fathom.sources import corpora


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


MODES = [("paragraph", ""), ("sentence", ""), ("custom_delimiter", ";"), ("custom_delimiter", "--"), ("custom_delimiter", ". ")]


def written(folder, seed):
    dealt = random.Random(seed)
    pieces = ["a", "Ünï", "word", " ", "  ", "\n", "\n", "\r\n", "\r", "\n\n", "\n \n", ".", ". ", "!", "。", "?", ";", "--", "-", "\t", "\x0b", " ", "3.14"]
    texts = {}
    for i in range(12):
        texts[f"f{i}.txt"] = "".join(dealt.choice(pieces) for _ in range(dealt.choice([1, 2, 3, 40, 400])))
    texts |= {"blank.txt": " \n \n", "one.txt": "\n", "cr.txt": "a\r", "bom.txt": "﻿a. b\n\nc", "spaces.txt": "  ", "open.txt": "a\n\n b"}
    for name, text in texts.items():
        (folder / name).write_bytes(text.encode())
    return {name: text for name, text in texts.items() if text}


@pytest.mark.parametrize("mode, delimiter", MODES)
@pytest.mark.parametrize("size", ["32", "100000"])
def test_segments_match_the_whole_text(spark, tmp_path, small_splits, mode, delimiter, size):
    texts = written(tmp_path, len(mode) + len(delimiter))
    small_splits(size)
    read = corpora.read_text_corpus(spark, str(tmp_path), "c", mode=mode, delimiter=delimiter)
    got = sorted((row["source"].rsplit("/", 1)[1], row["id"], row["content"]) for row in read.records.collect())
    rows = spark.createDataFrame([(name, name, text) for name, text in texts.items()], "scope string, source string, content string")
    whole = corpora.records_from_texts(rows, "c", mode=mode, delimiter=delimiter)
    assert got == sorted((row["source"], row["id"], row["content"]) for row in whole.records.collect())
    assert read.skipped.first()[0] == whole.skipped.first()[0]


def test_a_large_file_is_many_tasks_and_a_segment_may_cross_them(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i} of the long one" for i in range(3000))
    (tmp_path / "big.txt").write_text("first\n\n" + long + "\n\nlast\n")
    small_splits("4096")
    assert corpora.text_lines(spark, str(tmp_path)).select("split").distinct().count() > 10
    read = corpora.read_text_corpus(spark, str(tmp_path), "c", mode="paragraph")
    got = {row["content"] for row in read.records.collect()}
    assert got == {"first", long, "last"}
    plan = read.records._jdf.queryExecution().executedPlan().toString()
    assert "wholetext" not in plan


def test_other_encodings_and_line_breaks_in_delimiters(spark, tmp_path, small_splits):
    (tmp_path / "g.txt").write_bytes("第一。第二\n行。\r\n\r\n第三".encode("gb18030"))
    small_splits("8")
    read = corpora.read_text_corpus(spark, str(tmp_path), "c", mode="sentence", encoding="gb18030")
    assert sorted(r["content"] for r in read.records.collect()) == sorted(["第一。", "第二\n行。", "第三"])
    (tmp_path / "g.txt").write_text("a\n---\nb\n---\n")
    read = corpora.read_text_corpus(spark, str(tmp_path), "c", mode="custom_delimiter", delimiter="\n---\n")
    assert sorted(r["content"] for r in read.records.collect()) == ["a", "b"] and read.skipped.first()[0] == 1
    assert corpora.read_text_corpus(spark, str(tmp_path), "c", mode="whole_input").records.select(F.count("id")).first()[0] == 1


@pytest.mark.parametrize("mode, delimiter", [("sentence", ""), ("custom_delimiter", ";")])
def test_texts_are_not_shuffled_to_count_their_breaks(spark, tmp_path, mode, delimiter):
    (tmp_path / "a.txt").write_text("a. b; c\n" * 50)
    read = corpora.read_text_corpus(spark, str(tmp_path), "c", mode=mode, delimiter=delimiter)
    plan = read.records._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert not any("value#" in line or "content#" in line or "cut#" in line for line in windows)
    assert "MapInArrow" in plan and plan.count("Window [") == (0 if mode == "sentence" else 2)
