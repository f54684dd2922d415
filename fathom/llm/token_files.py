"""Token files: one id array per block with Elias-Fano coded document boundaries.

Documents are dealt by ascending ``doc_id`` over range partitions, encoded there and
written as binary files, one file a partition. A file is a chain of blocks::

    magic, header, ids (2 or 4 bytes each), Elias-Fano of the documents' ends,
    Elias-Fano of the doc_ids' distances from the first, one line feed

An Elias-Fano sequence of n numbers up to u holds the low bits of each number side by
side and the high bits in unary; the byte position of every ``SAMPLE``-th one is kept
as 32-bit number, so that any offset is found by reading a few bytes (``Boundaries.end``)
and no table of 64-bit offsets is stored. Blocks hold at most ``BLOCK_IDS`` ids beyond
their first document, so positions inside a block stay small.

Spark writes and reads the files, so any store that Spark reaches will do. Offsets
of blocks come from one short row a block.

Defined cases: a null text is empty and has only the end id; null doc_ids come first;
rows that repeat a doc_id stay side by side and each gets its own start; an empty
table gives no file content and no rows; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm.bpe import codec
from fathom.plans.storage import materialise, scratch_path

WORDS = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 2_000_000
SAMPLE = 256
PARTITION_BYTES = 128 * 1024 * 1024
MAGIC = b"EFTK1"
HEADER = struct.Struct("<IIQQqQQBB")  # part, block, documents, nulls, first doc_id, ids, id span, id bytes, spare
SEQUENCE = struct.Struct("<QQBII")  # numbers, largest, low bits, high bytes, samples


class Boundaries:
    """A non-decreasing sequence in Elias-Fano form."""

    def __init__(self, count: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.samples = count, low_bits, low, high, samples

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        count = len(values)
        largest = int(values[-1]) if count else 0
        low_bits = max(0, (largest // count).bit_length() - 1) if count else 0
        numbers = values.astype(np.uint64)
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            bits = ((numbers[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(bits.ravel(), bitorder="little").tobytes()
        else:
            low = b""
        ones = (numbers >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        flags = np.zeros(int(ones[-1]) + 1 if count else 0, dtype=np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").tobytes()
        samples = (ones[::SAMPLE]).astype("<u4")
        head = SEQUENCE.pack(count, largest, low_bits, len(high), len(samples))
        return head + low + high + samples.tobytes()

    @classmethod
    def unpack(cls, data: memoryview, at: int) -> tuple[Boundaries, int]:
        count, _, low_bits, high_size, sample_count = SEQUENCE.unpack_from(data, at)
        at += SEQUENCE.size
        low_size = (count * low_bits + 7) // 8
        low = bytes(data[at : at + low_size])
        high = bytes(data[at + low_size : at + low_size + high_size])
        at += low_size + high_size
        samples = np.frombuffer(data, dtype="<u4", count=sample_count, offset=at)
        return cls(count, low_bits, low, high, samples), at + 4 * sample_count

    def _low(self, index: int) -> int:
        start = index * self.low_bits
        chunk = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little")
        return (chunk >> (start % 8)) & ((1 << self.low_bits) - 1)

    def value(self, index: int) -> int:
        """The number at ``index``: select in the high bits from the nearest sample on."""
        place = int(self.samples[index // SAMPLE])
        left = index % SAMPLE
        byte, keep = place // 8, 0xFF << (place % 8) & 0xFF
        while True:
            ones = (self.high[byte] & keep).bit_count()
            if ones > left:
                break
            left -= ones
            byte, keep = byte + 1, 0xFF
        bits = self.high[byte] & keep
        for _ in range(left):
            bits &= bits - 1
        place = byte * 8 + (bits & -bits).bit_length() - 1
        return ((place - index) << self.low_bits) | self._low(index)

    def all(self) -> np.ndarray:
        flags = np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little")
        high = np.flatnonzero(flags)[: self.count] - np.arange(self.count)
        if not self.low_bits:
            return high.astype(np.int64)
        bits = np.unpackbits(np.frombuffer(self.low, dtype=np.uint8), bitorder="little")
        bits = bits[: self.count * self.low_bits].reshape(self.count, self.low_bits).astype(np.int64)
        return (high.astype(np.int64) << self.low_bits) | (bits << np.arange(self.low_bits)).sum(axis=1)


def pack_block(part: int, block: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """One block; ``ids`` are little-endian unsigned 32-bit integers of each document."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    ends = np.cumsum([len(x) // 4 for x in ids])
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    distances = np.array([d - first for d in known], dtype=object)
    span = int(distances[-1]) if known else 0
    head = HEADER.pack(part, block, len(ids), len(ids) - len(known), first, len(flat), span, width, 0)
    return b"".join(
        [MAGIC, head, flat.astype(f"<u{width}").tobytes(), Boundaries.pack(ends), Boundaries.pack(distances)]
    )


def unpack_blocks(data: bytes) -> Iterator[tuple[int, int, list[int | None], np.ndarray, np.ndarray]]:
    """(part, block, doc_ids, ends, ids) of every block of a file."""
    view, at = memoryview(data), 0
    while at < len(data) and data[at : at + len(MAGIC)] == MAGIC:
        at += len(MAGIC)
        part, block, count, nulls, first, n_ids, _, width, _ = HEADER.unpack_from(view, at)
        at += HEADER.size
        ids = np.frombuffer(view, dtype=f"<u{width}", count=n_ids, offset=at)
        ends, at = Boundaries.unpack(view, at + n_ids * width)
        distances, at = Boundaries.unpack(view, at)
        doc_ids = [None] * nulls + [first + int(x) for x in distances.all()]
        yield part, block, doc_ids, ends.all(), ids
        at += 1  # the line feed


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    *,
    end_id: int | None = END_ID,
    block_ids: int = BLOCK_IDS,
    partition_bytes: int = PARTITION_BYTES,
) -> str:
    """Encode ``docs`` (doc_id, text) into token files under ``path``, which must not exist."""
    tokenizer = vocabulary or public_tokenizers.path(WORDS)
    spark = docs.sparkSession
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // partition_bytes))

    def blocks(batches):
        coder, part, block = codec(tokenizer), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        ids: list[bytes] = []
        held = 0

        def packed():
            return pa.RecordBatch.from_arrays([pa.array([pack_block(part, block, doc_ids, ids)], pa.binary())], names=["block"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held >= block_ids:
                    yield packed()
                    block, doc_ids, ids, held = block + 1, [], [], 0
                encoded = coder.encode(text.as_py()) + tail
                doc_ids.append(doc_id)
                ids.append(encoded)
                held += len(encoded) // 4
        if ids:
            yield packed()

    # A text row is written byte for byte, so a column of blocks becomes a binary file.
    (
        texts.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .mapInArrow(blocks, "block binary")
        .select(F.col("block").cast("string"))
        .write.text(path)
    )
    return path


READ = "part int, block int, rank int, doc_id long, block_start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it: the sums of earlier blocks,
    one row a block, are added to the offset in its own block.
    """

    def documents(batches):
        for batch in batches:
            for content in batch.column(0):
                for part, block, doc_ids, ends, ids in unpack_blocks(content.as_py()):
                    starts = np.concatenate([[0], ends[:-1]])
                    crcs = [
                        zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(starts.tolist(), ends.tolist())
                    ]
                    n = len(doc_ids)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, part), pa.int32()),
                            pa.array(np.full(n, block), pa.int32()),
                            pa.array(np.arange(n), pa.int32()),
                            pa.array(doc_ids, pa.int64()),
                            pa.array(starts, pa.int64()),
                            pa.array(ends - starts, pa.int64()),
                            pa.array(crcs, pa.int64()),
                        ],
                        names=["part", "block", "rank", "doc_id", "block_start", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = materialise(files.mapInArrow(documents, READ), "token-rows")
    totals = rows.groupBy("part", "block").agg(F.sum("n_tokens").alias("n"))
    per_part = totals.groupBy("part").agg(F.sum("n").alias("n"))
    # One short row a file, then one a block: windows over them stay small at any size.
    before_part = per_part.select(
        "part", (F.expr("sum(n) over (order by part)") - F.col("n")).alias("before_part")
    )
    before = totals.join(before_part, "part").select(
        "part",
        "block",
        (F.col("before_part") + F.expr("sum(n) over (partition by part order by block)") - F.col("n")).alias("before"),
    )
    return rows.join(before, ["part", "block"]).select(
        "doc_id", (F.col("before") + F.col("block_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_to_files(docs: DataFrame, vocabulary: str | None = None, **options) -> DataFrame:
    """Write the token files of ``docs`` into the shared folder and report what they hold."""
    spark = docs.sparkSession
    path = write_token_files(docs, scratch_path(spark, "tokens"), vocabulary, **options)
    return read_token_files(spark, path)
