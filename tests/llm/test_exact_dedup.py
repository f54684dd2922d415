"""Exact copies against brute force."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Row

from fathom.llm import exact_dedup

SCHEMA = "doc_id long, text string, keep_id string, digest string"


def table(spark, rows):
    return spark.createDataFrame([Row(doc_id=i, text=t, keep_id="x", digest="y") for i, t in rows], SCHEMA)


def brute(rows):
    groups: dict[str, list] = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out


def test_copies_match_brute_force(spark):
    rows = [
        *[(i, "hot  text\n") for i in range(50, 250)],
        (3, "hot text "), (4, "hot text"), (5, None), (6, ""), (7, " "), (8, "\t\n"), (9, "a b"), (10, "a b"),
        (None, "hot\ttext"), (None, "alone"), (11, "x" * 200_000), (12, "x" * 200_000), (13, "x" * 200_000 + " "),
        (14, "same row"), (14, "same row"),
    ]
    got = [tuple(r) for r in exact_dedup.mark_copies(table(spark, rows).repartition(6)).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_dropping_keeps_whole_rows_and_empty_tables(spark):
    docs = table(spark, [(2, "a  b"), (1, "a b"), (3, None), (None, "c")])
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(
        [(1, "a b", "x", "y"), (3, None, "x", "y"), (None, "c", "x", "y")], key=repr
    )
    assert exact_dedup.mark_copies(docs.limit(0)).count() == 0
