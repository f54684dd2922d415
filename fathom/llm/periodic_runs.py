"""Periodic runs of words: stretches that repeat the same few words again and again.

A run is a stretch of consecutive words with smallest period q and at least ``max(6, 4 q)`` words
that no neighbouring word extends keeping the period. A word is dropped if any run contains it
after that run's first q words.

1. Frequency splitting. Every word of a run occurs at least four times in it, so a word that occurs
   less often within the current segment is in no run: the segment splits there. The parts are
   counted again until no part splits; parts of under six words are left out. All texts of a batch
   are counted together, a level at a time, and only parts that changed are counted again.
2. Lag scan of each part that is left. A run of period q holds three multiples of q in a row whose
   words equal the words q later, so only multiples of q are compared, ``n / q`` for lag q. What
   passes, and agrees at a few words in between, is compared word by word to both sides; what lies inside a known run whose period divides
   q has no smallest period q and is passed over.

Texts are split, coded and joined in Arrow; numbers of words, not words, are counted.

Defined cases: a null or blank text has no words, no runs and an empty collapsed text; words are
``[^\\x20\\x09-\\x0D]+``; repeated rows each get their row; doc_id may be null; a text of any length is
read whole, in memory of some 60 bytes a word; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.statistics import whole_division

WHITE_SPACE = r"[\x20\x09-\x0D]+"
LEAST_WORDS = 6
REPEATS = 4
# Words tried between the multiples of a lag before a stretch is compared in full.
PROBES = 16
# Texts are handled together up to this many bytes.
TOGETHER = 8 * 1024 * 1024


def split_by_frequency(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Parts of the segments ``starts[i]:ends[i]`` in which every word occurs at least four times."""
    stable: list[tuple[int, int]] = []
    vocabulary = int(codes.max()) + 1 if len(codes) else 1
    while True:
        long = ends - starts >= LEAST_WORDS
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return sorted(stable)
        sizes = ends - starts
        segment = np.repeat(np.arange(len(starts)), sizes)
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        at = np.arange(len(segment)) - first[segment] + starts[segment]
        _, where, counts = np.unique(segment * vocabulary + codes[at], return_inverse=True, return_counts=True)
        common = counts[where] >= REPEATS
        whole = np.logical_and.reduceat(common, first)
        stable += zip(starts[whole].tolist(), ends[whole].tolist())
        # Stretches of common words in the segments that split.
        inside = common & ~whole[segment]
        before = np.concatenate(([False], inside[:-1])) & np.concatenate(([False], segment[1:] == segment[:-1]))
        after = np.concatenate((inside[1:], [False])) & np.concatenate((segment[1:] == segment[:-1], [False]))
        starts, ends = at[inside & ~before], at[inside & ~after] + 1


def _reach(equal: np.ndarray) -> int:
    """How many leading entries are true."""
    return int(np.argmin(equal)) if not equal.all() else len(equal)


def _extent(codes: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch around ``at`` with equal words ``lag`` apart."""
    size, step, high = len(codes), 64, at
    while high + lag < size:
        stop = min(high + step, size - lag)
        n = _reach(codes[high:stop] == codes[high + lag : stop + lag])
        high += n
        if high < stop:
            break
        step *= 2
    low, step = at, 64
    while low > 0:
        start = max(low - step, 0)
        n = _reach((codes[start:low] == codes[start + lag : low + lag])[::-1])
        low -= n
        if low > start:
            break
        step *= 2
    return low, high + lag


def lag_scan(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every run in one segment."""
    found: list[tuple[int, int, int]] = []
    extents: set[tuple[int, int]] = set()
    starts: dict[int, np.ndarray] = {}
    ends: dict[int, np.ndarray] = {}
    size = len(codes)
    for lag in range(1, size // REPEATS + 1):
        marks = codes[::lag]
        same = marks[1:] == marks[:-1]
        if len(same) < 3:
            break
        hits = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        # What lies in a run whose period divides the lag has that period. Runs of one period overlap
        # by less than it, so only the last one that begins before can hold a stretch.
        for period, lows in starts.items():
            if lag % period == 0 and len(hits):
                at = hits * lag
                last = np.searchsorted(lows, at, side="right") - 1
                hits = hits[(last < 0) | (at + 3 * lag >= ends[period][np.maximum(last, 0)])]
        # Words between the multiples must match, too: a few are tried at once.
        for step in range(1, min(PROBES, 2 * lag)):
            if not len(hits):
                break
            at = hits * lag + (2 * lag * step // PROBES if 2 * lag > PROBES else step)
            hits = hits[codes[at] == codes[at + lag]]
        done, new = -1, []
        for hit in hits.tolist():
            at = hit * lag
            if at < done:
                continue
            low, high = _extent(codes, at, lag)
            done = high - 3 * lag
            if high - low >= max(LEAST_WORDS, REPEATS * lag) and (low, high) not in extents:
                extents.add((low, high))
                new.append((low, high))
        if new:
            found += [(low, high - low, lag) for low, high in new]
            starts[lag], ends[lag] = np.array(new).T
    return found


def runs_of_texts(codes: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs by text; text i has the words ``offsets[i]:offsets[i + 1]``. Texts without runs are absent."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for start, end in split_by_frequency(codes, offsets[:-1], offsets[1:]):
        text = int(np.searchsorted(offsets, start, side="right")) - 1
        for low, length, period in lag_scan(codes[start:end]):
            found.setdefault(text, []).append((start - int(offsets[text]) + low, length, period))
    return {text: sorted(runs, key=lambda run: (run[0], run[2])) for text, runs in found.items()}


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of all texts, a number for each that tells equal words, and the offset of each text."""
    pieces = pc.split_pattern_regex(pc.fill_null(texts, "").cast(pa.large_string()), WHITE_SPACE)
    owners = pc.list_parent_indices(pieces).to_numpy(zero_copy_only=False)
    words = pc.list_flatten(pieces)
    real = pc.not_equal(words, "")
    words, owners = words.filter(real), owners[real.to_numpy(zero_copy_only=False)]
    counts = np.bincount(owners, minlength=len(texts))
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    return words, words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
SPACE = pa.scalar(" ", pa.large_string())
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _collapsed(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    words, codes, offsets = word_codes(texts)
    by_text = runs_of_texts(codes, offsets)
    kept = np.ones(len(codes), dtype=bool)
    for text, runs in by_text.items():
        base = int(offsets[text])
        for start, length, period in runs:
            kept[base + start + period : base + start + length] = False
    ends = np.concatenate(([0], np.cumsum(kept)))[offsets]
    rest = words if kept.all() else words.filter(pa.array(kept))
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), rest), SPACE).cast(pa.string())
    names = ("start", "length", "period")
    runs = [[dict(zip(names, run)) for run in by_text.get(i, ())] for i in range(len(ids))]
    columns = [ids, pa.array(np.diff(offsets), pa.int64()), pa.array(runs, RUN_TYPE), joined]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, together: int = TOGETHER) -> DataFrame:
    """doc_id, n_words, ``runs`` by start, and the ``collapsed`` text of every row of ``docs``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes, dtype=np.int64) // together
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    yield _collapsed(batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, {RESULT}")


def seeded(docs: DataFrame) -> DataFrame:
    """``docs`` with a run planted in every tenth text by the checksum of its doc_id.

    From word a on, a text repeats its words a to a + p - 1. A null doc_id has no checksum and
    leaves the text as it is.
    """
    checksum = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), WHITE_SPACE), lambda word: word != "")
    rows = docs.select("doc_id", "text", checksum.alias("checksum"))
    chosen = F.col("checksum") % 10 == 0
    g, n = whole_division(F.col("checksum"), F.lit(10).cast("long")), F.size("words").cast("long")
    rows = rows.withColumn("words", F.when(chosen, words))
    rows = rows.select("doc_id", "text", "words", n.alias("n"), g.alias("g"), (g % F.greatest(n, F.lit(1))).alias("a"))
    rows = rows.withColumn("p", 1 + whole_division(F.col("n") - F.col("a"), 3 + F.col("g") % 8))

    def place(i: Column) -> Column:
        return F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")

    repeated = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i)))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def summarise_runs(found: DataFrame) -> DataFrame:
    """The digest of :func:`find_runs`: the run with most repeats, and hashes of runs and text."""

    def better(best: Column, run: Column) -> Column:
        # Exact: length / period compared by products; a tie stays with the earlier start, then period.
        ahead = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best["period"].isNull() | ahead, run).otherwise(best)

    empty = F.lit(None).cast("struct<start: long, length: long, period: long>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.aggregate("runs", empty, better).alias("best"),
                        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        whole_division(1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def summarise_seeded(docs: DataFrame) -> DataFrame:
    """Runs of every text of ``docs`` after planting."""
    return summarise_runs(find_runs(seeded(docs)))
