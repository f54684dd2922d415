"""Encoding, token files and shards against the library, round trips and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import Row
from tokenizers import Tokenizer

from fathom.llm import bpe, sharding, token_files

ODD = [
    None,
    "",
    " ",
    "\n\n  x \n",
    "don't  re'll\tIT'S 12 345 !!! ''s",
    "é́ ß İ Σας \x1c\x1f ½² ﬁ",
    "<|endoftext|> a<|endoftext|>b",
    "漢字" * 300,
    "a" * 9000,
    "ab1" * 4000,
    "   " * 500 + "z",
    "word " * 3000,
]


def documents(spark, texts, **extra):
    rows = [Row(doc_id=i, text=t, ids=f"extra {i}", part=-1, **extra) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_library(name):
    coder = bpe.Codec(public_tokenizers.path(name), piece=64, entries=50)
    dealt = random.Random(3)
    alphabet = ["a", "th", " ", "  ", "\n", "1", "'s", "!", "é", "漢", "<|endoftext|>", "\x1c", "İ", "é"]
    texts = [t for t in ODD if t] + [
        "".join(dealt.choice(alphabet[: dealt.randint(1, len(alphabet))]) for _ in range(dealt.randint(1, 300)))
        for _ in range(400)
    ]
    for text in texts:
        want = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode(text), dtype="<u4").tolist() == want, text[:50]


def test_joined_spans_equal_the_whole():
    coder = bpe.Codec(public_tokenizers.path(bpe.BYTE_LEVEL))
    dealt = random.Random(4)
    for _ in range(300):
        kinds = dealt.choice([["ab", "a"], ["th", "ing", " "], [" ", "\n", "x"], ["<|endoftext|>", "1"], ["é", "'", "s"]])
        text = "".join(dealt.choice(kinds) for _ in range(dealt.randint(2, 500)))
        size = dealt.choice([40, 90, 200])
        parts = [
            (text[i : i + size], np.frombuffer(coder.encode(text[i : i + size]), dtype="<u4"))
            for i in range(0, len(text), size)
        ]
        want = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert bpe.concatenated(coder, parts).tolist() == want


def test_encode_decode_of_a_table(spark):
    docs = documents(spark, ODD)
    library = Tokenizer.from_file(public_tokenizers.path(bpe.BYTE_LEVEL))
    got = {r.doc_id: r for r in bpe.encode_decode(docs, span=1000, piece=200).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_decode(docs.limit(0)).count() == 0
    real = {r.doc_id: r.decoded for r in bpe.encode_decode(docs, span=1000, outputs="ids").collect()}
    assert real[8] == ODD[8] and real[0] == ""


@pytest.mark.parametrize("values", [[0], [5, 5, 9], list(range(0, 5000, 7)), [0] * 300 + [10**6], [2**40, 2**41]])
def test_boundaries_round_trip(values):
    packed = token_files.Boundaries.pack(np.array(values, dtype=object if max(values) > 2**31 else np.int64))
    back, end = token_files.Boundaries.unpack(memoryview(packed), 0)
    assert end == len(packed) and back.all().tolist() == values
    assert [back.value(i) for i in range(len(values))] == values


def test_token_files_hold_every_document(spark):
    docs = documents(spark, [*ODD, "same", "same"]).unionByName(
        spark.createDataFrame([Row(doc_id=None, text="no id", ids="", part=0)], "doc_id long, text string, ids string, part int")
    )
    library = Tokenizer.from_file(public_tokenizers.path(token_files.WORDS))
    got = token_files.encode_to_files(docs.repartition(3), block_ids=500).orderBy("start").collect()
    order = [(None, "no id"), *[(i, t) for i, t in enumerate([*ODD, "same", "same"])]]
    start = 0
    assert len(got) == len(order)
    for row, (doc_id, text) in zip(got, order):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), crc)
        start += len(ids)
    assert token_files.encode_to_files(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1, 2, 3, 64, 65, 1000, 4097])
def test_the_permutation_is_one_and_can_be_undone(rows):
    numbers = np.arange(rows)
    places = sharding.permuted(numbers, rows)
    assert sorted(places.tolist()) == numbers.tolist()
    assert sharding.unpermuted(places, rows).tolist() == numbers.tolist()
    if rows > 100:
        assert (places != numbers).mean() > 0.9
        assert sharding.permuted(numbers, rows, seed=1).tolist() != places.tolist()


def test_shards_are_even_without_gaps_and_reproducible(spark):
    docs = documents(spark, [*ODD, *[f"text {i % 7}" for i in range(500)]]).withColumn("slot", docs_null())
    rows = sharding.assign_shards(docs.repartition(5)).collect()
    again = sharding.assign_shards(docs.coalesce(1)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    slots: dict[int, list[int]] = {}
    for row in rows:
        slots.setdefault(row.shard, []).append(row.slot)
        text = (ODD + [f"text {i % 7}" for i in range(500)])[row.doc_id] or ""
        assert row["size"] == len(text.encode()) + 8 and row.text_crc32 == zlib.crc32(text.encode())
    assert set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    numbers = np.array([r.row_number for r in rows])
    places = sharding.permuted(numbers, len(rows))
    assert [(r.shard, r.slot) for r in rows] == [(p % 24, p // 24) for p in places.tolist()]
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def docs_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")
