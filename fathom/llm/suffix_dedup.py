"""Repeated strings of ``LENGTH`` bytes by prefix doubling over chosen positions.

Of every ``LENGTH``-byte string, one position stands for it: the least hash among its
``FIRST``-byte strings (the leftmost on ties). The choice depends on the string alone,
so equal strings choose alike, and neighbouring strings mostly share a position: about
one position in 35 is ranked instead of every byte. Ranks are names (hashes of what is
ranked, met by Spark's shuffles), and rounds rank ever longer contexts:

1. ``FIRST`` bytes at the position: unique ones leave.
2. The whole run of strings a position stands for (``LENGTH`` bytes and more): all but
   the first document with an equal run lose every string of the run at once.
3. Positions that are first of their run, while the same ``FIRST`` bytes also occur in
   other runs, may hold strings seen in those. Every such string covers the position
   with half of the remaining bytes before it, or with half of them after it: of these
   two contexts (66 bytes), unique ones leave.
4. What remains are the ends of repeated passages: their strings of ``LENGTH`` bytes are
   ranked one by one, which passes the threshold and ends the doubling.

An equal earlier string has the same position in a run with the same first bytes, and
the first of that run reaches round 3, so no string is missed. Every byte covered
by a repeated string is removed.

Defined cases: null and empty texts have no bytes; doc_id orders documents and null comes
first; rows that repeat a doc_id and text get the same result, and with another text are
not compared with each other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.spans import (
    SIZE_BITS,
    SLICE_BYTES,
    Hasher,
    cut_out,
    identified,
    later_occurrences,
    pack,
    packed_texts,
    repeated_within,
    text_groups,
    unpack,
)
from fathom.plans.storage import discard_since, mark, materialise, release_shuffles

LENGTH = 100
FIRST = 32
HALF_BITS, OFFSET_BITS = 27, 8
INDEX = np.uint64((1 << 24) - 1)


def _window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every ``width`` neighbours."""
    least, have = keys, 1
    while have * 2 <= width:
        least, have = np.minimum(least[:-have], least[have:]), have * 2
    rest = width - have
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def runs(data: np.ndarray, ends: np.ndarray, length: int, first: int):
    """Runs of strings with one position: first string, last string, and three names: of the
    ``first`` bytes, of the run, and the packed names of the contexts before and after.

    ``ends`` are the ends of the texts that lie side by side in ``data``.
    """
    none = np.empty(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none.view(np.uint64), none.view(np.uint64), none
    hasher = Hasher(data)
    at = np.arange(len(data) - first + 1)
    names = hasher.of(at, at + first)
    positions = (_window_least(names & ~INDEX | at.astype(np.uint64), length - first + 1) & INDEX).astype(np.int64)
    strings = np.arange(len(data) - length + 1)
    strings = strings[strings + length <= ends[np.searchsorted(ends, strings, side="right")]]
    if not len(strings):
        return none, none, none.view(np.uint64), none.view(np.uint64), none
    chosen = positions[strings]
    fresh = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (strings[1:] != strings[:-1] + 1)])
    low = strings[fresh]
    high = strings[np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(strings) - 1]])]
    at, half = chosen[fresh], (length - first) // 2
    before, after = at - low >= half, at - high <= half
    halves = at - low
    halves[before] |= _short(hasher.of(at[before] - half, at[before] + first)) << (HALF_BITS + OFFSET_BITS)
    halves[after] |= _short(hasher.of(at[after], at[after] + length - half)) << OFFSET_BITS
    return low, high, names[at], hasher.of(low, high + length), halves


def _short(names: np.ndarray) -> np.ndarray:
    """Names cut to ``HALF_BITS`` bits but never 0, which stands for no context."""
    return np.maximum((names >> np.uint64(64 - HALF_BITS)).astype(np.int64), 1)


def _text_runs(texts: list[bytes], group: list[int], length: int, first: int):
    """Owner, first string, last string and names of the runs of some texts."""
    if len(group) == 1 and len(texts[group[0]]) > SLICE_BYTES:
        text, parts = np.frombuffer(texts[group[0]], dtype=np.uint8), []
        for start in range(0, len(text) - length + 1, SLICE_BYTES):
            piece = text[start : start + SLICE_BYTES + length - 1]
            low, high, *names = runs(piece, np.array([len(piece)]), length, first)
            parts.append((np.full(len(low), group[0]), low + start, high + start, *names))
        return map(np.concatenate, zip(*parts))
    data = np.frombuffer(b"".join(texts[i] for i in group), dtype=np.uint8)
    ends = np.cumsum([len(texts[i]) for i in group])
    low, high, *names = runs(data, ends, length, first)
    place = np.searchsorted(ends, low, side="right")
    base = np.concatenate([[0], ends[:-1]])[place] if len(low) else low
    return np.array(group)[place] if len(low) else low, low - base, high - base, *names


def run_rows(docs: DataFrame, length: int, first: int) -> DataFrame:
    """name, context, halves, doc, variant, place of every run."""

    def rows(batches):
        for batch in batches:
            docs_of, variants = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(3).to_pylist()]
            for group in text_groups(texts):
                owner, low, high, names, contexts, halves = _text_runs(texts, group, length, first)
                if len(low):
                    place = pack(low, high - low + length, repeated_within(owner, contexts, low))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names.view(np.int64)),
                            pa.array(contexts.view(np.int64)),
                            pa.array(halves),
                            pa.array(docs_of[owner]),
                            pa.array(variants[owner]),
                            pa.array(place),
                        ],
                        names=["name", "context", "halves", "doc", "variant", "place"],
                    )

    return identified(docs).mapInArrow(rows, "name long, context long, halves long, doc long, variant long, place long")


def string_rows(docs: DataFrame, chosen: DataFrame, length: int) -> DataFrame:
    """string, doc, variant, place of the strings in the chosen runs (doc, variant, place)."""
    per_doc = chosen.groupBy("doc", "variant").agg(F.collect_list("place").alias("places"))
    joined = packed_texts(docs).join(per_doc, ["doc", "variant"]).select("doc", "variant", "data", "places")

    def rows(batches):
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, variant, data, places in zip(*(batch.column(i) for i in range(4))):
                at, size = unpack(places.values.to_numpy(zero_copy_only=False))
                counts = size - length + 1
                if not counts.sum():
                    continue
                text = np.frombuffer(unpacker.decompress(data.as_py()), dtype=np.uint8)
                within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                low = np.unique(np.repeat(at, counts) + within)
                names = Hasher(text).of(low, low + length)
                again = repeated_within(np.zeros(len(low)), names, low)
                place = pack(low, np.full(len(low), length), again)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names.view(np.int64)),
                        pa.array(np.full(len(low), doc.as_py())),
                        pa.array(np.full(len(low), variant.as_py())),
                        pa.array(place),
                    ],
                    names=["string", "doc", "variant", "place"],
                )

    return joined.mapInArrow(rows, "string long, doc long, variant long, place long")


def passage_ends(heads: DataFrame, length: int, first: int) -> DataFrame:
    """doc, variant, place of the parts of ``heads`` whose context before or after the position recurs."""
    half = (length - first) // 2
    mask = (1 << HALF_BITS) - 1
    offset = F.col("halves").bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))
    size = F.col("place").bitwiseAND(F.lit((1 << SIZE_BITS) - 1))
    start = F.shiftright("place", SIZE_BITS + 1)
    # Strings up to the split hold the context before the position, those from it on the one after.
    split = F.least(F.greatest(offset - half, F.lit(0)), size - length)

    def part(name: str, bits: int, low: Column, high: Column) -> Column:
        place = F.shiftleft(start + low, SIZE_BITS + 1).bitwiseOR(high - low + length)
        return F.struct(F.lit(name).alias("side"), F.shiftright("halves", bits).bitwiseAND(F.lit(mask)).alias("half"), place.alias("place"))

    sides = F.array(
        part("before", HALF_BITS + OFFSET_BITS, F.lit(0), split), part("after", OFFSET_BITS, split, size - length)
    )
    halves = materialise(heads.select("name", "doc", "variant", F.inline(sides)).where("half <> 0"), "halves")
    recurring = halves.groupBy("name", "side", "half").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return halves.join(materialise(recurring.drop("n"), "recurring-halves"), ["name", "side", "half"]).select("doc", "variant", "place")


def repeated_spans(docs: DataFrame, length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """doc, variant, place of spans whose bytes are all covered by repeated strings.

    Of the tables it writes, only those the spans are read from are left.
    """
    since = mark()
    ranked = run_rows(docs, length, first)
    frequent = ranked.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    known = materialise(frequent, "names")
    release_shuffles(docs.sparkSession)
    left = materialise(ranked.join(known, "name"), "runs")
    release_shuffles(docs.sparkSession)
    whole = materialise(later_occurrences(left.select("context", "doc", "variant", "place"), "context"), "whole-runs")
    mixed = left.groupBy("name").agg(F.min("context").alias("least"), F.max("context").alias("most")).where("least <> most")
    firsts = left.groupBy("context").agg(F.min("doc").alias("first_doc"))
    heads = (
        left.join(materialise(mixed.select("name"), "mixed"), "name", "left_semi")
        .where(F.col("place").bitwiseAND(F.lit(1 << SIZE_BITS)) == 0)
        .join(materialise(firsts, "firsts"), "context")
        .where("doc = first_doc")
        .select("name", "halves", "doc", "variant", "place")
    )
    strings = materialise(string_rows(docs, passage_ends(heads, length, first), length), "strings")
    discard_since(docs.sparkSession, since, whole, strings)
    release_shuffles(docs.sparkSession)
    return whole.unionByName(later_occurrences(strings, "string"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, first: int = FIRST, *, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs``."""
    since = mark()
    return cut_out(docs, repeated_spans(docs, length, first), 1, since=since, texts=texts)
