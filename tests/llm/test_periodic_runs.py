"""Runs of words against a scan of every lag, and whole rows by hand."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import Row

from fathom.llm import periodic_runs as pr

SCHEMA = "doc_id long, text string, runs int, words string, g int, a int, checksum string"


def table(spark, rows):
    return spark.createDataFrame([Row(i, t, 1, "w", 2, 3, "c") for i, t in rows], SCHEMA)


def brute(words):
    out, size = [], len(words)
    for lag in range(1, size // 4 + 1):
        i = 0
        while i + lag < size:
            if words[i] != words[i + lag]:
                i += 1
                continue
            start = i
            while i + lag < size and words[i] == words[i + lag]:
                i += 1
            stretch = words[start : i + lag]
            if len(stretch) >= max(6, 4 * lag):
                if all(any(stretch[k] != stretch[k + d] for k in range(len(stretch) - d)) for d in range(1, lag)):
                    out.append((start, len(stretch), lag))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_match_brute_force():
    dealt = random.Random(3)
    for _ in range(2500):
        texts = []
        for _ in range(dealt.randrange(1, 5)):
            size, kinds = dealt.randrange(60), dealt.choice([1, 2, 2, 3, 5, 20])
            words = [dealt.randrange(kinds) for _ in range(size)]
            for _ in range(dealt.randrange(4) if size else 0):
                lag, start = dealt.randrange(1, 9), dealt.randrange(size)
                for i in range(start + lag, min(size, start + dealt.randrange(1, 50))):
                    words[i] = words[i - lag]
            texts.append(words)
        offsets = np.cumsum([0] + [len(w) for w in texts]).astype(np.int64)
        got = pr.runs_of_texts(np.array([w for words in texts for w in words], dtype=np.int64), offsets)
        for i, words in enumerate(texts):
            assert got.get(i, []) == brute(words), words


def planted(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = planted(doc_id, text)
    runs = brute(words)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    hashes = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *hashes)


def test_rows_match_by_hand(spark):
    dealt = random.Random(9)
    chosen = [i for i in range(-30, 400) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, " ".join(dealt.choice("abcdefghij") * 2 for _ in range(dealt.randrange(1, 200)))) for i in [*range(100), *chosen]]
    rows += [(500, None), (501, ""), (502, " \t\n"), (None, "é é é é é é \x1c x"), (None, None), (503, "a b " * 900), (503, "a b " * 900)]
    rows += [(chosen[0], None), (chosen[1], "one"), (504, "u\xa0v w\x0bx " * 4), (505, "z " * 5), (506, " z" * 6), (507, "x" * 300_000)]
    docs = table(spark, rows).repartition(4)
    want = sorted((expected(i, t) for i, t in rows), key=repr)
    assert sorted(map(tuple, pr.summarise_seeded(docs).collect()), key=repr) == want
    small = pr.summarise_runs(pr.find_runs(pr.seeded(docs), together=100))
    assert sorted(map(tuple, small.collect()), key=repr) == want
    assert pr.summarise_seeded(table(spark, [])).count() == 0
    found = {r.doc_id: r for r in pr.find_runs(docs).where("doc_id in (503, 506)").collect()}
    assert found[503].collapsed == "a b" and found[503].n_words == 1800
    assert [tuple(r) for r in found[506].runs] == [(0, 6, 1)] and found[506].collapsed == "z"
