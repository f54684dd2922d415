"""Repeated passages by content-defined chunks.

A gear rolling hash (each step shifts left by one and adds a number for the byte, so
sixteen bits remember sixteen bytes) marks chunk ends where its highest bits are zero,
unless another end lies within the ``GAP`` bytes before; a chunk that reaches
``LONGEST_CHUNK`` is cut. Ends depend on nearby bytes only, so an insertion changes the
chunks it touches and no others. A chunk whose digest occurs in an earlier document, or
earlier in the same one, is a repeat; runs of neighbouring repeats of ``LEAST_RUN``
bytes and more are removed, shorter ones are chance and stay.

Defined cases: null and empty texts have no bytes; doc_id orders documents and null comes
first; rows that repeat a doc_id and text get the same result, and with another text are
not compared with each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathom.llm.shingles import _constants
from fathom.llm.spans import Hasher, cut_out, identified, later_occurrences, pack, repeated_within, text_groups
from fathom.plans.storage import mark

MEMORY = 16
END_BITS = 5
GAP = 8
LONGEST_CHUNK = 256
LEAST_RUN = 100
_GEAR = (_constants(256, 31) >> np.uint64(48)).astype(np.uint16)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends (exclusive) that the content of ``data`` marks."""
    gears = _GEAR[data]
    rolled = gears.copy()
    for back in range(1, min(MEMORY, len(data))):
        rolled[back:] += gears[:-back] << np.uint16(back)
    marks = rolled >> np.uint16(16 - END_BITS) == 0
    marks[: MEMORY - 1] = False
    recent = np.concatenate([[0], np.cumsum(marks)])
    at = np.flatnonzero(marks)
    return at[recent[at] == recent[np.maximum(at - GAP, 0)]] + 1


def chunks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks that cover ``data``."""
    bounds = np.unique(np.concatenate([[0], chunk_ends(data), [len(data)]])).astype(np.int64)
    pieces = -(-np.diff(bounds) // LONGEST_CHUNK)
    if (pieces > 1).any():
        within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        bounds = np.concatenate([np.repeat(bounds[:-1], pieces) + within * LONGEST_CHUNK, [len(data)]])
    return bounds[:-1], bounds[1:]


def chunk_rows(docs: DataFrame) -> DataFrame:
    """digest, doc, variant, place of every chunk."""

    def rows(batches):
        for batch in batches:
            docs_of, variants = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(3).to_pylist()]
            for group in text_groups(texts):
                starts, ends, owners, bases = [], [], [], []
                data = np.frombuffer(b"".join(texts[i] for i in group), dtype=np.uint8)
                base = 0
                for i in group:
                    size = len(texts[i])
                    if size:
                        low, high = chunks(data[base : base + size])
                        starts.append(low + base)
                        ends.append(high + base)
                        owners.append(np.full(len(low), i))
                        bases.append(np.full(len(low), base))
                    base += size
                if not starts:
                    continue
                low, high, owner, base_of = map(np.concatenate, (starts, ends, owners, bases))
                digests = Hasher(data).of(low, high)
                at = low - base_of
                place = pack(at, high - low, repeated_within(owner, digests, at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests.view(np.int64)), pa.array(docs_of[owner]), pa.array(variants[owner]), pa.array(place)],
                    names=["digest", "doc", "variant", "place"],
                )

    return identified(docs).mapInArrow(rows, "digest long, doc long, variant long, place long")


def remove_repeats(docs: DataFrame, least: int = LEAST_RUN, *, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    since = mark()
    return cut_out(docs, later_occurrences(chunk_rows(docs), "digest"), least, since=since, texts=texts)
