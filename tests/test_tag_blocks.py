"""Pairs of the tags of records of any length."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from fathom.operators import corpus_profile


@pytest.mark.parametrize("block", [1, 3, 256])
def test_pairs_match_brute_force_in_blocks_of_any_size(spark, monkeypatch, block):
    monkeypatch.setattr(corpus_profile, "TAG_BLOCK", block)
    dealt = random.Random(5)
    names = [f"t{i:02d}" for i in range(20)]
    lists = [[dealt.choice(names) + dealt.choice(["", " "]) for _ in range(dealt.randrange(12))] for _ in range(40)]
    lists += [None, [], ["a"], ["a"] * 9, [" "] * 9, ["b", "a", "", " a "]]
    want = Counter(pair for tags in lists for pair in combinations(sorted({t.strip() for t in tags or []} - {""}), 2))
    records = spark.createDataFrame([(tags,) for tags in lists], "tags array<string>")
    found = corpus_profile.tag_cooccurrence(records).collect()
    assert [tuple(r) for r in found] == sorted(((*p, n) for p, n in want.items()), key=lambda e: (-e[2], *e[:2]))


def test_a_record_with_thousands_of_tags_is_dealt_over_tasks(spark):
    many = F.transform(F.sequence(F.lit(1), F.lit(3000)), lambda i: F.format_string("tag%05d", i))
    records = spark.range(1).select(many.alias("tags"))
    one = corpus_profile.tag_cooccurrence(records.unionByName(spark.createDataFrame([(["tag00007", "tag02999"],)], "tags array<string>")))
    counted = one.agg(F.count(F.lit(1)).alias("pairs"), F.sum("count").alias("records"), F.max("count").alias("most")).first()
    assert tuple(counted) == (3000 * 2999 // 2, 3000 * 2999 // 2 + 1, 2)
    assert tuple(one.first()) == ("tag00007", "tag02999", 2)
