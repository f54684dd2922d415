"""Multiset hash of paragraphs against plain arithmetic."""

from __future__ import annotations

import base64
import hashlib
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fathom.llm import paragraph_hash as ph

SCHEMA = "doc_id long, text string, key string, copies int, side int, line string, signs int"


def table(spark, rows):
    return spark.createDataFrame([Row(i, t, "k", 7, 1, "l", 3) for i, t in rows], SCHEMA)


def plain(text):
    """Lanes of a text, one paragraph after the other."""
    digests, signs = [0] * ph.DIGESTS, [0] * ph.SIGNS
    for line in (text or "").split("\n"):
        hashes = [hashlib.sha256(f"{i}:{line}".encode()).hexdigest() for i in (0, 1)]
        for lane in range(ph.DIGESTS):
            digests[lane] = (digests[lane] + int(hashes[lane // 8][lane % 8 * 8 :][:8], 16)) % ph.DIGEST_RING
        words = re.findall(ph.WORD, line)
        for at in range(max(len(words) - 2, 1) if words else 0):
            digits = hashlib.md5(" ".join(words[at : at + 3]).encode()).hexdigest()
            halves = int(digits[:15], 16), int(digits[15:30], 16)
            # Low bits of both halves come first, then the upper ones.
            bits = [halves[h] >> (part * ph.BITS + b) & 1 for part in range(2) for h in range(2) for b in range(ph.BITS)]
            signs = [(s + 2 * b - 1) % ph.SIGN_RING for s, b in zip(signs, bits)]
    return digests, signs


def near(a, b):
    centred = lambda x: x - ph.SIGN_RING * (x >= ph.SIGN_RING // 2)
    size = sum(centred(x) ** 2 for x in a[1]) + sum(centred(x) ** 2 for x in b[1])
    apart = sum(centred((x - y) % ph.SIGN_RING) ** 2 for x, y in zip(a[1], b[1]))
    return 1.0 if a[0] == b[0] else 0.0 if size == 0 else max(0.0, 1.0 - apart / size)


def encoded(lanes):
    return base64.b64encode(b"".join(x.to_bytes(4) for x in lanes[0]) + b"".join(x.to_bytes(3) for x in lanes[1])).decode()


def expected(rows):
    seen = sorted(set((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{'null' if r[0] is None else r[0]}:{r[1]}".encode()).digest()))
    out = {}
    for (i, text), (_, after) in zip(seen, seen[1:] + seen[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = plain(text), plain(edited), plain(after)
        out[i, text] = (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), encoded(a), encoded(b), near(a, b), near(a, c))
    return sorted((out[i, t or ""] for i, t in rows), key=repr)


ROWS = [
    (1, "one two three four\nfive six\n\nseven"), (2, None), (3, ""), (4, " \n\t"), (5, "é" * 50 + "\U0001F600 word\n" + "a b c d e f " * 40),
    (6, "x" * 5000), (6, "another text of one id"), (7, "same row of words here"), (7, "same row of words here"), (7, "same row of words here"),
    (None, "no id at all"), (None, "no id either"), (9, "seven\n\nfive six\none two three four"), (10, "word " * 3000), (-5, "minus five\n" * 9),
]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[7:10], []])
def test_rows_match_plain_arithmetic(spark, rows):
    got = ph.compare_edited(table(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)


def test_paragraphs_may_be_added_and_removed(spark):
    rows = [(1, "a b c d\ne f"), (2, "g h i\nj"), (3, "j\ng h i\ne f\na b c d"), (4, "j\na b c d\ne f\ng h i")]
    prints = {r.doc_id: r for r in ph.fingerprints(table(spark, rows)).collect()}
    assert prints[3].fingerprint == prints[4].fingerprint != prints[1].fingerprint
    lanes = ph.fingerprints(table(spark, rows)).select("doc_id", "digests", "signs")
    one, two, three = (lanes.where(F.col("doc_id") == i).drop("doc_id").toDF(f"d{i}", f"s{i}") for i in (1, 2, 3))
    row = one.crossJoin(two).crossJoin(three).select(
        (ph.joined(F.col("d1"), F.col("d2"), ph.DIGEST_RING) == F.col("d3")).alias("digests"),
        (ph.joined(F.col("s1"), F.col("s2"), ph.SIGN_RING) == F.col("s3")).alias("signs"),
        (ph.without(F.col("d3"), F.col("d2"), ph.DIGEST_RING) == F.col("d1")).alias("less_digests"),
        (ph.without(F.col("s3"), F.col("s1"), ph.SIGN_RING) == F.col("s2")).alias("less_signs"),
    ).first()
    assert all(row)


def test_main_path_runs_no_python(spark):
    plan = ph.compare_edited(table(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_rows_in_several_runs(spark, monkeypatch):
    monkeypatch.setattr(ph, "RUN", 3)
    rows = [(1, "a b c")] * 8 + [(2, "d")] * 3
    assert sorted(map(tuple, ph.compare_edited(table(spark, rows)).collect()), key=repr) == expected(rows)
