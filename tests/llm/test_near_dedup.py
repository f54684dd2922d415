"""Near copies against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import Row

from fathom.llm import near_dedup, shingles
from fathom.llm.components import components

SCHEMA = "doc_id long, text string, node long, component string"


def sets_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent):
    sets = [(i, sets_of(t)) for i, t in rows]
    group = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            one, two = sets[a][1], sets[b][1]
            if one and two and 100 * len(one & two) >= percent * len(one | two):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, _), g in zip(sets, group):
        least[g] = min(least.get(g, doc_id), doc_id)
    return {i: (len(s), least[g], least[g] == i) for (i, s), g in zip(sets, group)}


def corpus():
    dealt = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  TWO"), (5, "one two three"), (6, "Ä ä É"), (7, "ä ä É")]
    passage = [dealt.choice(words) for _ in range(40)]
    for size in (12, 45, 60, 300):
        base = [dealt.choice(words) for _ in range(size)]
        for copy in range(25):
            text = list(base)
            for _ in range(dealt.choice([0, 0, 1, 1, 2, 3, max(1, size // 40)])):
                text[dealt.randrange(len(text))] = dealt.choice(words)
            rows.append((len(rows), " ".join(text)))
    for _ in range(60):
        own = [dealt.choice(words) for _ in range(dealt.choice([3, 8, 60]))]
        rows.append((len(rows), " ".join([*own, *passage])))
    chain = [dealt.choice(words) for _ in range(100)]
    for step in range(12):
        rows.append((len(rows), " ".join([*chain[step * 2 :], *[f"c{step}x{i}" for i in range(step * 2)]])))
    rows.append((len(rows), " ".join(dealt.choice(words) for _ in range(30_000))))
    dealt.shuffle(rows)
    return rows


@pytest.mark.parametrize(("percent", "small"), [(85, near_dedup.SMALL), (80, near_dedup.SMALL), (85, 1), (80, 3)])
def test_components_match_brute_force(spark, percent, small):
    rows = corpus()
    docs = spark.createDataFrame([Row(i, t, -1, "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_components(docs.repartition(5), percent, small=small).collect()}
    assert got == brute(rows, percent)


def test_nulls_repeats_and_empty_tables(spark):
    text = "a b c d e f g"
    rows = [(None, text), (9, text), (9, text), (None, "lone words here only once"), (4, None)]
    docs = spark.createDataFrame([Row(i, t, -1, "x") for i, t in rows], SCHEMA)
    got = sorted(map(tuple, near_dedup.near_components(docs).collect()), key=repr)
    assert got == sorted(
        [(None, 3, 9, False), (9, 3, 9, True), (9, 3, 9, True), (None, 1, None, True), (4, 0, 4, True)], key=repr
    )
    assert near_dedup.drop_near_copies(docs).columns == docs.columns
    assert near_dedup.near_components(docs.limit(0)).count() == 0


def test_least_shared_bounds_the_miss():
    assert near_dedup.least_shared(85) >= 24
    assert near_dedup.least_shared(80) < near_dedup.least_shared(85)


def test_components_of_a_path_a_star_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    got = {r.node: r.component for r in found.collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_that_collide_under_polynomial_hashes_stay_apart(spark):
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [word, other, f"one {word} two three four", f"one {other} two three four", word[:64], other[:64], word[:8], word[:7]]
    docs = spark.createDataFrame([Row(i, t, -1, "x") for i, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id: r.component_id for r in near_dedup.near_components(docs).collect()} == {i: i for i in range(len(texts))}


def test_sets_are_compared_by_their_words(monkeypatch):
    texts = ["a b c d e f", "A  b\nc d e g", "a b c d e f", "short", "", None, "x" * 200 + " b c d e"]
    sets = list(shingles.full_sets(texts))
    assert [set(s.words()) for s in sets[:2]] == [{b"a b c d e", b"b c d e f"}, {b"a b c d e", b"b c d e g"}]
    assert sets[0].shared(sets[1]) == 1 and sets[0].shared(sets[2]) == 2 and sets[4].shared(sets[0]) == 0
    assert sets[0].digest == sets[2].digest != sets[1].digest and sets[4].digest is sets[5].digest is None
    monkeypatch.setattr(shingles, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    one, other = shingles.full_sets(["a b c d e", "v w x y z"])
    assert shingles.shared(one.hashes, other.hashes) == 1 and one.shared(other) == 0 and one.digest != other.digest
