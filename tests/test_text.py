from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from fathom.functions import text as tx


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression).first()[0]


def test_tokens_of_mixed_scripts(spark):
    assert one(spark, "安装体验很好 HTTP 500", tx.tokens(F.col("t"))) == [
        "安装", "装体", "体验", "验很", "很好", "http", "500",
    ]
    assert one(spark, "差 a 很好的 Straße ſo x1", tx.tokens(F.col("t"))) == ["很好的", "strasse", "so", "x1"]


def test_folding_matches_python(spark):
    samples = ["Straße", "ŒUVRE ſ", "ΟΔΟΣ σς", "ﬁne ﬄ", "İstanbul", "plain", "µm", "ẞ"]
    df = spark.createDataFrame([(s,) for s in samples], "t string").select("t", tx.casefold(F.col("t")).alias("f"))
    assert {row["t"]: row["f"] for row in df.collect()} == {s: s.casefold() for s in samples}


@pytest.mark.parametrize(
    ("mode", "delimiter", "text", "kept", "dropped"),
    [
        ("non_empty_line", "", "第一条\n\n第二条\n", ["第一条", "第二条"], 1),
        ("sentence", "", "第一句。第二句！third?", ["第一句。", "第二句！", "third?"], 0),
        ("paragraph", "", "a\nb\n\n  c \n \n", ["a\nb", "c"], 1),
        ("custom_delimiter", "a|b", "1a|b2a|ba|b", ["1", "2"], 2),
        ("whole_input", "", "  x \n", ["x"], 0),
    ],
)
def test_split_modes(spark, mode, delimiter, text, kept, dropped):
    raw = tx.raw_segments(F.col("t"), mode, delimiter)
    segments = one(spark, text, tx.kept_segments(raw))
    assert segments == kept
    assert one(spark, text, tx.skipped_segments(raw, tx.kept_segments(raw), mode)) == dropped


def test_line_and_sentence_splits_match_python(spark):
    rng = random.Random(7)
    alphabet = "ab.!? 。\n\r\x0b\x1c "
    texts = ["".join(rng.choice(alphabet) for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t",
        tx.kept_segments(tx.raw_segments(F.col("t"), "non_empty_line")).alias("lines"),
        tx.kept_segments(tx.raw_segments(F.col("t"), "sentence")).alias("sentences"),
    )
    for text, lines, sentences in df.collect():
        assert lines == [s.strip() for s in text.splitlines() if s.strip()]
        assert sentences == [s.strip() for s in re.split(r"(?<=[。！？!?\.])\s*", text) if s.strip()]



def test_tags(spark):
    assert one(spark, " a, b,,a ，c", tx.split_tags(F.col("t"), ",，")) == ["a", "b", "c"]
    assert one(spark, "x, y", tx.with_default_tags(tx.split_tags(F.col("t")), ["y", "z"])) == ["y", "z", "x"]


def test_digest_keys_are_injective(spark):
    texts = ["a" * 64, "a" * 65, "a" * 66, "a" * 65 + "b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.digest_long(F.col("t")).alias("k"))
    assert df.distinct().count() == 4


def test_missing_delimiter_and_unknown_mode(spark):
    for mode in ("custom_delimiter", "by_page"):
        with pytest.raises(ValueError):
            tx.raw_segments(F.col("t"), mode)


def test_tokens_match_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab_1 Zß-ſé漢字体验很") for _ in range(rng.choice([0, 3, 40]))) for _ in range(200)]

    def want(text):
        runs = [run for run in re.findall("[\u4e00-\u9fff]+|[a-z0-9_]+", text.casefold()) if len(run) >= 2]
        long = [len(run) > 4 and "一" <= run[0] <= "鿿" for run in runs]
        return [t for run, cut in zip(runs, long) for t in ([run[i : i + 2] for i in range(len(run) - 1)] if cut else [run])]

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.tokens(F.col("t")).alias("tokens"))
    for text, tokens in df.collect():
        assert tokens == want(text)
    assert one(spark, None, tx.tokens(F.col("t"))) is None


def test_tokens_per_record_finds_the_tokens_of_a_text_once(spark):
    from fathom.plans.corpus_queries import QUERIES

    plan = QUERIES["tokens_per_record"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("regexp_extract_all" in line for line in plan.splitlines()) == 1
