"""Byte spans of documents: packing, first occurrences by key, and cutting out.

A document is one text under one doc_id. A span travels as three numbers: ``doc`` (the
doc_id, null as the least number), ``variant`` (the hash of the text, which tells rows
apart that repeat a doc_id with another text) and ``place``, which packs the first byte,
a flag for a key seen earlier in the same document, and the length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shingles import Powers, _constants, mixed
from fathom.plans.storage import discard_since, materialise, release_shuffles

NO_ID = -(1 << 63)
SIZE_BITS = 13
LONGEST = (1 << SIZE_BITS) - 1
SLICE_BYTES = 1 << 20
_VALUES = _constants(256, 21)
_POWERS = Powers(0xD1342543DE82EF95)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Hashes of any substrings of a buffer from one pass over it."""

    def __init__(self, data: np.ndarray):
        up, self.down = _POWERS.upto(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_VALUES[data] * up[: len(data)])])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            return mixed(raw + (ends - starts).astype(np.uint64) * _LENGTH)


def pack(at: np.ndarray, size: np.ndarray, again: np.ndarray) -> np.ndarray:
    return at.astype(np.int64) << (SIZE_BITS + 1) | again.astype(np.int64) << SIZE_BITS | size


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """at, size."""
    return place >> (SIZE_BITS + 1), place & LONGEST


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, doc, variant and text of every row."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("variant"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, doc, variant and the compressed bytes of every text, ready to be moved."""

    def rows(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(data, pa.binary())],
                names=["doc_id", "doc", "variant", "data"],
            )

    return identified(docs).mapInArrow(rows, "doc_id long, doc long, variant long, data binary")


def repeated_within(rows: np.ndarray, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which entries repeat a key of the same row at an earlier byte."""
    order = np.lexsort((at, keys, rows))
    again = np.zeros(len(keys), dtype=bool)
    if len(order) > 1:
        same = (rows[order][1:] == rows[order][:-1]) & (keys[order][1:] == keys[order][:-1])
        again[order[1:][same]] = True
    return again


def text_groups(texts: list[bytes]) -> Iterator[list[int]]:
    """Indexes of texts, in groups of about ``SLICE_BYTES``; a text above that is alone."""
    group: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        if group and len(text) > SLICE_BYTES:
            yield group
            group, size = [], 0
        group.append(i)
        size += len(text)
        if size >= SLICE_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def later_occurrences(rows: DataFrame, key: str) -> DataFrame:
    """doc, variant, place of the rows whose key an earlier document holds, or this one earlier.

    ``rows`` (key, doc, variant, place) may be computed twice: once to find the keys that occur
    in more than one place with their first document, once to meet them. The first is
    summed before it moves, the second is an equal join whose skewed keys Spark splits.
    """
    first = rows.groupBy(key).agg(F.min("doc").alias("first_doc"), F.count(F.lit(1)).alias("n"))
    known = materialise(first.where("n > 1").select(key, "first_doc"), "repeated-keys")
    release_shuffles(rows.sparkSession)
    again = F.col("place").bitwiseAND(F.lit(1 << SIZE_BITS)) != 0
    return rows.join(known, key).where((F.col("doc") > F.col("first_doc")) | again).select("doc", "variant", "place")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(at: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of the covered bytes that are at least ``least`` long."""
    if not len(at):
        return at, at
    order = np.argsort(at, kind="stable")
    starts, ends = at[order], np.maximum.accumulate((at + size)[order])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    first = np.flatnonzero(fresh)
    starts, ends = starts[first], ends[np.concatenate([first[1:] - 1, [len(ends) - 1]])]
    long = ends - starts >= least
    return starts[long], ends[long]


def cut_out(docs: DataFrame, spans: DataFrame, least: int, *, since: int, texts: bool = False) -> DataFrame:
    """Every document without the bytes its spans (doc, variant, place) cover.

    Runs shorter than ``least`` stay. The result has doc_id, n_bytes, n_removed, n_spans
    and kept_sha256, and the kept bytes as ``kept`` where ``texts`` is set. Tables written
    after ``since``, which led to the spans, are deleted when these are written.
    """
    per_doc = materialise(spans.groupBy("doc", "variant").agg(F.collect_list("place").alias("places")), "spans")
    discard_since(docs.sparkSession, since, per_doc)
    release_shuffles(docs.sparkSession)
    joined = packed_texts(docs).join(per_doc, ["doc", "variant"], "left").select("doc_id", "data", "places")

    def cut(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            made = []
            for doc_id, data, places in zip(*(batch.column(i) for i in range(3))):
                text = unpacker.decompress(data.as_py())
                row = [doc_id.as_py(), len(text), 0, 0]
                kept = text
                if places.is_valid:
                    starts, ends = merged(*unpack(places.values.to_numpy(zero_copy_only=False)), least)
                    ends = np.minimum(ends, len(text))
                    if len(starts):
                        row[2:] = [int((ends - starts).sum()), len(starts)]
                        keep_from = [0, *ends.tolist()]
                        keep_to = [*starts.tolist(), len(text)]
                        kept = b"".join(text[a:b] for a, b in zip(keep_from, keep_to))
                made.append((*row, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = list(zip(*made)) if made else [[]] * (5 + texts)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names[: len(columns)])

    return joined.mapInArrow(cut, RESULT + (", kept binary" if texts else ""))
