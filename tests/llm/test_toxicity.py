"""Folding, learning and held-out accuracy of the toxicity score."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from fathom.llm import toxicity


@pytest.mark.parametrize(
    "disguised", ["GRIBBEL", "gr1bbel", "gri\u200bbbel", "gr\u0456bb\u0435l", "g.r.i.b.b.e.l", "gr\u00efbb\u00e9l", "gribbel!!", "\uff47ribbel"]
)
def test_folding_reads_disguised_words(disguised):
    assert toxicity.words_of(disguised) == ["gribbel"]


def test_folding_leaves_numbers_and_signs_alone():
    assert toxicity.words_of("price 100 $$$ l0$er### looooser") == ["price", "loser", "loser"]


def tables(spark, rows):
    docs = spark.createDataFrame([Row(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, toxic string, score double")
    labels = spark.createDataFrame([Row(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    return docs, labels


def corpus():
    dealt = random.Random(2)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ra", "te", "su") for b in ("nar", "pel", "dok", "vin", "gam", "bri")]
    rows = []
    for i in range(1500):
        words = [dealt.choice(plain) for _ in range(dealt.randint(5, 60))]
        toxic = int(dealt.random() < 0.2)
        if toxic:
            words[dealt.randrange(len(words))] = dealt.choice(["gribbel", "Gribbel!", "gr1bbel", "snarfo", "SNARFO"])
        elif dealt.random() < 0.1:
            words[:2] = ["mild", "snarfo"]
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_rows_are_scored_right(spark):
    rows = [*corpus(), (5000, None, None), (5001, "", 0), (5002, "g.r.i.b.b.e.l " + "word " * 20_000, 1)]
    docs, labels = tables(spark, rows)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels.where("doc_id < 5000")).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, y) for i, _, y in rows if y is not None and got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert got[5000].score == got[5001].score < 0.5
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_change_no_score(spark):
    docs, labels = tables(spark, corpus())
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    one = sorted(map(tuple, toxicity.score_toxicity(docs, labels).collect()))
    two = sorted(map(tuple, toxicity.score_toxicity(docs, turned).collect()))
    assert one == two


def test_one_class_and_empty_tables(spark):
    docs, labels = tables(spark, [(1, "a b", 0), (2, "c", 0), (None, "d", None)])
    assert {r.score for r in toxicity.score_toxicity(docs, labels).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0
    lexicon = toxicity.Lexicon({" gribbel ": 4.0}, set(), [-3.0, 3.0, 0, 0, 0, 0], [0.0] * 5, [1.0] * 5)
    kept = toxicity.drop_toxic(tables(spark, [(1, "fine", 0), (2, "a gribbel b", 1), (3, None, 0)])[0], lexicon)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert kept.columns == docs.columns


def test_exception_phrases_take_the_weight_away():
    lexicon = toxicity.Lexicon({" snarfo ": 4.0}, {" mild snarfo "})
    finder = lexicon.finder()
    assert lexicon.features("a mild snarfo here", finder) == [0.0] * 5
    assert lexicon.features("a mild snarfo and snarfo", finder)[0] > 0


def test_rare_toxic_words_are_learned_beside_many_frequent_ones(spark):
    # Every row holds half of 11,000 harmless words, whose starts and forms are more than 20,000 entries.
    letters = "abcdefghijklmnopqrst"
    harmless = [f"{a}{b}{c}{d}" for a in letters for b in "aeiou" for c in letters for d in ("min", "rol", "sut", "vek", "dap", "zug")][:11_000]
    rows = []
    for i in range(120):
        toxic = int(i % 3 == 0)
        words = harmless[(i // 3) % 2 :: 2]
        rows.append((i, " ".join([*words, "gribbel"] if toxic and (i // 3) % 4 < 1 else words), toxic))
    docs, labels = tables(spark, [*rows, *rows[:3]])
    lexicon = toxicity.learned(docs, labels)
    assert any(" gribbel ".startswith(entry) for entry in lexicon.weights)
    assert toxicity.labelled_sample(docs, labels).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(120))
    entries = [(f" {word} ", 9 + i % 9, i % 2) for i, word in enumerate(harmless)] + [(" gribbel ", 5, 0), (" grib", 6, 0), (" mild ", 4, 0)]
    passed = toxicity.candidates(spark.createDataFrame(entries, "entry string, toxic long, clean long"), 40, 200).collect()
    got = {r.entry for r in passed}
    assert " gribbel " in got and not got & {" grib", " mild "} and len(got) == 11_001
