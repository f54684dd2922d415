"""Shuffled shards by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in order of doc_id; a four-round Feistel network over the
smallest even number of bits that holds n permutes the numbers, walking the cycle
until a result lies below n. The permuted number p gives ``shard = p mod shards`` and
``slot = p div shards``: the shuffle is reproducible, shards differ by one row at most,
slots have no gaps, and the place of any row is computed from its number and n alone
(and back, by :func:`unpermuted`).

Numbers come from range partitions: each row's place in its partition plus the rows of
the partitions before, one short row a partition.

Defined cases: null texts have no bytes and no checksum of their own (crc32 0 of the
empty text); null doc_ids come first; rows that repeat a doc_id are numbered by size and
checksum, and equal rows are interchangeable; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.plans.storage import materialise_measured

SHARDS = 24
SEED = 20240229
ROUNDS = 4
ROW_BYTES = 8
LAW = "rows"
MASK = np.uint64((1 << 64) - 1)


def half_bits(rows: int) -> int:
    """Bits of each half of the smallest balanced network that holds ``rows`` numbers."""
    return max(1, -(-max(rows - 1, 1).bit_length() // 2))


def _mixed(half: np.ndarray, key: int) -> np.ndarray:
    """A keyed scramble of 64-bit words (wrapping multiplication and shifts)."""
    with np.errstate(over="ignore"):
        x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def round_keys(seed: int) -> list[int]:
    return [int(_mixed(np.array([seed], dtype=np.uint64), i + 1)[0]) & ((1 << 63) - 1) for i in range(ROUNDS)]


def _network(numbers: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = numbers >> np.uint64(bits), numbers & mask
    for key in keys:
        left, right = right, left ^ (_mixed(right, key) & mask)
    return (left << np.uint64(bits)) | right


def _inverse(numbers: np.ndarray, bits: int, keys: list[int]) -> np.ndarray:
    mask = np.uint64((1 << bits) - 1)
    left, right = numbers >> np.uint64(bits), numbers & mask
    for key in reversed(keys):
        left, right = right ^ (_mixed(left, key) & mask), left
    return (left << np.uint64(bits)) | right


def _walked(numbers: np.ndarray, rows: int, seed: int, network) -> np.ndarray:
    bits, keys = half_bits(rows), round_keys(seed)
    out = network(numbers.astype(np.uint64), bits, keys)
    while (beyond := out >= np.uint64(rows)).any():
        out[beyond] = network(out[beyond], bits, keys)
    return out.astype(np.int64)


def permuted(numbers: np.ndarray, rows: int, seed: int = SEED) -> np.ndarray:
    """The places of row numbers 0..rows-1 in the shuffle."""
    return _walked(numbers, rows, seed, _network)


def unpermuted(places: np.ndarray, rows: int, seed: int = SEED) -> np.ndarray:
    """The row numbers that :func:`permuted` sends to ``places``."""
    return _walked(places, rows, seed, _inverse)


def global_row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with numbers 0..n-1 in ``order`` (nulls first), and n.

    Keep ``df`` narrow: it is written once, range partitioned.
    """
    by = [F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    stored, measured = materialise_measured(placed, "row-numbers")
    part = F.shiftright("_at", 33)
    counts = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.expr("sum(_n) over (order by _part)") - F.col("_n")).alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stored.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + within)
    return numbered.drop("_part", "_before", "_at"), measured["rows"]


def assign_shards(docs: DataFrame, shards: int = SHARDS, *, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number for every row of ``docs``."""
    body = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(body) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    numbered, rows = global_row_numbers(sized, ["doc_id", "size", "text_crc32"])

    def places(batches):
        for batch in batches:
            number = batch.column("row_number").to_numpy()
            place = permuted(number, rows, seed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"]
            )

    schema = "doc_id long, size long, text_crc32 long, row_number long, place long"
    placed = numbered.select(F.col("doc_id").cast("long"), "size", "text_crc32", "row_number").mapInArrow(places, schema)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(LAW).alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
    )
