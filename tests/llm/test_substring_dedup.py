"""Repeated strings and chunks against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import Row

from fathom.llm import chunk_dedup, spans, suffix_dedup
from fathom.plans import storage

SCHEMA = "doc_id long, text string, place string, n int, data int"


def table(spark, rows):
    return spark.createDataFrame([Row(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def brute(rows, length):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for at in range(len(data) - length + 1):
            string = data[at : at + length]
            if string in seen:
                covered[at : at + length] = b"\1" * length
            seen.add(string)
        spans = sum(1 for i in range(len(data)) if covered[i] and (i == 0 or not covered[i - 1]))
        kept = bytes(b for b, c in zip(data, covered) if not c)
        out.append((doc_id, len(data), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    dealt = random.Random(12)
    letters = lambda n, of="abcdefghij klmn é漢": "".join(dealt.choice(of) for _ in range(n))
    passages = [letters(n) for n in (60, 99, 100, 101, 130, 400)]
    rows = [(None, passages[3]), (0, None), (1, ""), (2, "short"), (3, "ab" * 300), (4, "ab" * 200 + letters(50)), (5, "a" * 99)]
    for i in range(60):
        parts = [letters(dealt.randint(0, 150))]
        for _ in range(dealt.randint(0, 4)):
            parts += [dealt.choice(passages), letters(dealt.choice([0, 1, 40, 200]))]
        rows.append((10 + i, "".join(parts)))
    base = letters(2500)
    for i in range(40):
        at = dealt.randrange(len(base))
        rows.append((100 + i, base if i % 3 == 0 else base[:at] + letters(dealt.randint(1, 5)) + base[at + dealt.randint(0, 9) :]))
    rows += [(200, base[700:900] + base[100:300] + base[850:1100]), (201, letters(1500, "ab")), (202, letters(1500, "ab"))]
    rows += [(300 - i, "the hot text of many rows, " * 6) for i in range(50)]
    return rows


@pytest.mark.parametrize(("length", "first"), [(100, 32), (40, 12), (100, 100)])
def test_repeated_strings_match_brute_force(spark, length, first):
    rows = corpus()
    docs = table(spark, rows).repartition(4)
    got = sorted(map(tuple, suffix_dedup.remove_repeats(docs, length, first).collect()), key=repr)
    assert got == sorted(brute(rows, length), key=repr)


def test_long_texts_are_cut_into_overlapping_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 300)
    data = np.frombuffer(("x" * 150 + "".join(random.Random(1).choices("abcd", k=4000))).encode(), dtype=np.uint8).tobytes()
    whole = suffix_dedup.runs(np.frombuffer(data, dtype=np.uint8), np.array([len(data)]), 100, 32)
    _, low, high, *_ = suffix_dedup._text_runs([data], [0], 100, 32)
    cover = lambda low, high: sorted(p for a, b in zip(low, high) for p in range(a, b + 1))
    assert cover(low, high) == cover(whole[0], whole[1]) == list(range(len(data) - 99))


def test_same_rows_and_empty_tables(spark):
    text = "".join(random.Random(4).choices("abcdefgh ", k=500))
    docs = table(spark, [(1, text), (1, text), (2, text)])
    for operator in (suffix_dedup.remove_repeats, chunk_dedup.remove_repeats):
        got = sorted(map(tuple, operator(docs).collect()))
        assert [r[2] for r in got[:2]] == [0, 0] and got[2][2] > 300
        assert operator(docs.limit(0)).count() == 0
    kept = suffix_dedup.remove_repeats(docs, texts=True).where("doc_id = 1").first().kept
    assert bytes(kept).decode() == text


def test_chunks_cover_and_resist_shifts():
    dealt = random.Random(9)
    data = bytes(dealt.choices(range(97, 120), k=20_000))
    starts, ends = chunk_dedup.chunks(np.frombuffer(data, dtype=np.uint8))
    assert starts[0] == 0 and ends[-1] == len(data) and (starts[1:] == ends[:-1]).all()
    assert (ends - starts).max() <= chunk_dedup.LONGEST_CHUNK
    before = {data[a:b] for a, b in zip(starts, ends)}
    changed = data[:5000] + b"INSERTED" + data[5000:]
    starts, ends = chunk_dedup.chunks(np.frombuffer(changed, dtype=np.uint8))
    after = {changed[a:b] for a, b in zip(starts, ends)}
    assert len(before - after) <= 3
    for size in (0, 1, 15, 16, 17):
        starts, ends = chunk_dedup.chunks(np.frombuffer(data[:size], dtype=np.uint8))
        assert ends[-1] == size if size else len(starts) == 0 or ends[-1] == 0


def chunked(data):
    """Chunks by the definition, byte for byte."""
    gear = chunk_dedup._GEAR
    rolled, marks = 0, []
    for i, byte in enumerate(data):
        rolled = ((rolled << 1) + int(gear[byte])) & 0xFFFF
        if i >= chunk_dedup.MEMORY - 1 and rolled >> (16 - chunk_dedup.END_BITS) == 0:
            marks.append(i)
    ends = [m + 1 for k, m in enumerate(marks) if k == 0 or m - marks[k - 1] > chunk_dedup.GAP]
    bounds = sorted({0, *ends, len(data)})
    out = []
    for low, high in zip(bounds, bounds[1:]):
        out += [(a, min(high, a + chunk_dedup.LONGEST_CHUNK)) for a in range(low, high, chunk_dedup.LONGEST_CHUNK)]
    return out


def test_chunk_removal_matches_brute_force(spark):
    rows = corpus()
    seen, want = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        covered = bytearray(len(data))
        for low, high in chunked(data):
            if data[low:high] in seen:
                covered[low:high] = b"\1" * (high - low)
            seen.add(data[low:high])
        kept, spans, at = b"", 0, 0
        while at < len(data):
            end = at
            while end < len(data) and covered[end] == covered[at]:
                end += 1
            if covered[at] and end - at >= chunk_dedup.LEAST_RUN:
                spans += 1
            else:
                kept += data[at:end]
            at = end
        want.append((doc_id, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    got = chunk_dedup.remove_repeats(table(spark, rows).repartition(4)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r.n_removed for r in got) > 50_000


def test_long_text_behind_a_short_one_is_sliced(monkeypatch):
    texts = [b"a short text of its own", bytes(random.Random(8).choices(range(97, 120), k=9000)), b"another short text"]
    whole = suffix_dedup.runs(np.frombuffer(texts[1], dtype=np.uint8), np.array([9000]), 100, 32)
    monkeypatch.setattr(spans, "SLICE_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 1000)
    monkeypatch.setattr(suffix_dedup, "INDEX", np.uint64((1 << 12) - 1))
    groups = list(spans.text_groups(texts))
    assert groups == [[0], [1], [2]]
    owner, low, high, *_, halves = suffix_dedup._text_runs(texts, groups[1], 100, 32)
    assert set(owner) == {1} and (halves >= 0).all()
    assert sorted(p for a, b in zip(low, high) for p in range(a, b + 1)) == list(range(9000 - 99))
    assert len(whole[0]) <= len(low) <= len(whole[0]) + 40


def chunk_brute(text):
    """n_bytes, n_removed, n_spans, kept_sha256 of a text compared with itself alone."""
    seen, runs = set(), []
    for low, high in chunked(text.encode()):
        chunk = text.encode()[low:high]
        if chunk in seen:
            runs = [*runs[:-1], (runs[-1][0], high)] if runs and runs[-1][1] == low else [*runs, (low, high)]
        seen.add(chunk)
    runs = [run for run in runs if run[1] - run[0] >= chunk_dedup.LEAST_RUN]
    kept = text.encode()
    for low, high in reversed(runs):
        kept = kept[:low] + kept[high:]
    return len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(
    ("operator", "alone"),
    [(suffix_dedup.remove_repeats, lambda t: brute([(None, t)], 100)[0][1:]), (chunk_dedup.remove_repeats, chunk_brute)],
)
def test_many_texts_without_doc_id_keep_their_own_spans(spark, operator, alone):
    # Every text repeats one passage of its own, at an offset that differs between texts.
    dealt = random.Random(3)
    letters = lambda n: "".join(dealt.choices("abcdefghijklmnop", k=n))
    texts = [letters(20 + i % 97) + passage + letters(30) + passage for i in range(2000) for passage in [letters(300)]]
    got = operator(table(spark, [(None, t) for t in texts])).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(map(alone, texts))


def test_finished_tables_are_deleted_before_strings_are_met(spark):
    place = storage.mark()
    found = suffix_dedup.repeated_spans(table(spark, corpus()))
    left = [path.rsplit("/", 1)[1].removeprefix("fathom-").rsplit("-", 1)[0] for path in storage._written.paths[place:]]
    assert left == ["whole-runs", "strings", "repeated-keys"]
    assert found.count() > 0
