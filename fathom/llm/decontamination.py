"""Benchmark passages in documents by windows over canonical templates.

Texts become sequences of words without case and outer punctuation; numbers, names
(capitalised words inside a sentence) and units (after a number) become typed
placeholders, their values slots. Windows of five template words are joined by hash.
A document holds an item where at least ``SHARE`` of the item's windows occur under one
reading of its slots, taken from the matches of one occurrence (windows whose distances
from their places in the item differ by less than the item is long) before those elsewhere: each slot value of the item stands for one value in the document; two
may stand for the same (3 and 5 both asked as 4), one may not stand for two. So copies
are found as well as questions with other parameters.

Hashes of the item windows go to all tasks when a count has shown that they are few
(``NEAR_WINDOWS``); they only spare sending windows that no item has. Beyond that bound
all windows go through the join, with the same result.

Defined cases: null and empty texts hold nothing; a text or item of fewer than five
words is one window and matches only a text that is as short; windows with fewer than
two plain words say nothing about the question and are left out on both sides, but an
item made of such windows alone (number sequences, lists of names) is matched by its
words as they are, in any window of a document; rows that repeat a doc_id are judged
each; empty tables give no rows; extra columns are ignored here and kept by
:func:`drop_contaminated`.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.names import unused
from fathom.llm.shingles import WIDTH, _combined, mixed
from fathom.plans.storage import materialise

SHARE = 0.8
PLAIN_WORDS = 2
NEAR_WINDOWS = 2_000_000
CACHE_TOKENS = 500_000
NUMBER = re.compile(r"[+-]?\d[\d.,:/%]*|[+-]?[\d.,]*\d")
NUMBER_UNIT = re.compile(r"([+-]?\d[\d.,]*)([a-zµ°]{1,8})")
CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.DOTALL)
ENDS = (".", "!", "?", ":", ";")
# Units of measurement and currencies that may follow a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml cl dl l litre litres liter liters gallon gallons pint pints cup cups "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kmh km/h m/s hz khz mhz ghz w kw mw kwh j kj cal kcal v mv a ma ohm ohms pa kpa bar psi "
    "c f k degree degrees percent % usd eur gbp dollar dollars euro euros cent cents "
    "bit bits byte bytes kb mb gb tb".split()
)
WORD, NUM, NAME, UNIT, NONE = range(5)
TYPES = ["", "<number>", "<name>", "<unit>"]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


LITERAL = np.uint64(_hash("<literal>"))
PLACEHOLDERS = np.array([_hash(t) for t in TYPES], dtype=np.uint64)


class Vocabulary(dict):
    """Tokens seen by this worker: hash of the plain word and what the token may be."""

    def __init__(self):
        self.hashes, self.kinds = array("Q"), array("B")

    def __missing__(self, token: str) -> int:
        core = CORE.search(token)
        word = core[0] if core else ""
        lower = word.lower()
        number = bool(word) and bool(NUMBER.fullmatch(lower))
        flags = 0 if word else 1
        flags |= 2 * number
        flags |= 4 * (word[:1].isupper() and not word.isupper() and not number)
        flags |= 8 * (lower in UNITS or (not word and token == "%"))
        flags |= 16 * token.rstrip("\"'”’)]").endswith(ENDS)
        mixed = NUMBER_UNIT.fullmatch(lower)
        if mixed and mixed[2] in UNITS:
            flags |= 2
        place = self[token] = len(self.hashes)
        self.hashes.append(_hash(lower))
        self.kinds.append(flags)
        return place

    def template(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Words, kinds, hashes of the template of ``text`` and hashes of the words themselves."""
        tokens = text.split() if text else []
        if len(self) > CACHE_TOKENS:
            self.clear()
            self.hashes, self.kinds = array("Q"), array("B")
        places = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if not len(places):
            return [], np.empty(0, dtype=np.int8), np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        flags = np.frombuffer(self.kinds, dtype=np.uint8)[places]
        hashes = np.frombuffer(self.hashes, dtype=np.uint64)[places]
        after_number = np.concatenate([[False], (flags[:-1] & 2) > 0])
        opens = np.concatenate([[True], (flags[:-1] & 16) > 0])
        kinds = np.zeros(len(places), dtype=np.int8)
        kinds[((flags & 4) > 0) & ~opens] = NAME
        kinds[((flags & 8) > 0) & after_number] = UNIT
        kinds[(flags & 2) > 0] = NUM
        real = (flags & 1) == 0
        kept = np.flatnonzero(real)
        kinds, literal = kinds[kept], hashes[kept]
        hashes = np.where(kinds > 0, PLACEHOLDERS[kinds], literal)
        return [tokens[i] for i in kept.tolist()] if len(kept) < len(tokens) else tokens, kinds, hashes, literal


def windows(words: list[str], kinds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and first words of the usable windows, and the width."""
    width = min(WIDTH, len(words))
    if not width:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
    found = _combined(hashes, width).view(np.int64)
    plain = np.concatenate([[0], np.cumsum(kinds == WORD)])
    usable = plain[width:] - plain[:-width] >= min(PLAIN_WORDS, width)
    at = np.flatnonzero(usable)
    return found[at], at, width


def literal_windows(literal: np.ndarray) -> np.ndarray:
    """Hashes of all windows by their words as they are, apart from those of templates."""
    width = min(WIDTH, len(literal))
    if not width:
        return np.empty(0, dtype=np.int64)
    return mixed(_combined(literal, width) ^ LITERAL).view(np.int64)


def _slots(words: list[str], kinds: np.ndarray, at: int, width: int) -> list[str]:
    """Typed values of the window's placeholders, empty for plain words."""
    return [
        TYPES[k] + CORE.search(w)[0].lower() if k else ""
        for w, k in zip(words[at : at + width], kinds[at : at + width].tolist())
    ]


WINDOWS = "row long, doc_id long, text_hash long, hash long, at int, slots array<string>"


def document_windows(docs: DataFrame, only: np.ndarray | None, literals: bool = False) -> DataFrame:
    """The template windows of ``docs``, those in the sorted ``only`` where it is given.

    With ``literals`` also the windows of words as they are, which have no slots.
    """
    shared = docs.sparkSession.sparkContext.broadcast(only) if only is not None else None

    def rows(batches):
        vocabulary = Vocabulary()
        wanted = shared.value if shared is not None else None
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            ids = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for (row, doc_id, text_hash), text in zip(ids, batch.column(3)):
                words, kinds, hashes, literal = vocabulary.template(text.as_py())
                found, places, width = windows(words, kinds, hashes)
                templates = np.ones(len(found), dtype=bool)
                if literals:
                    plain = literal_windows(literal)
                    found, places = np.concatenate([found, plain]), np.concatenate([places, np.arange(len(plain))])
                    templates = np.arange(len(found)) < len(templates)
                if wanted is not None and len(found):
                    if not len(wanted):
                        continue
                    near = np.minimum(np.searchsorted(wanted, found), len(wanted) - 1)
                    hit = wanted[near] == found
                    found, places, templates = found[hit], places[hit], templates[hit]
                for value, at, template in zip(found.tolist(), places.tolist(), templates.tolist()):
                    slots = _slots(words, kinds, at, width) if template else []
                    for column, cell in zip(columns, (row, doc_id, text_hash, value, at, slots)):
                        column.append(cell)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["row", "doc_id", "text_hash", "hash", "at", "slots"]
            )

    texts = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )
    return texts.mapInArrow(rows, WINDOWS)


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, hash, place, item_slots and n_windows of every benchmark item.

    ``item_slots`` is empty for windows of words as they are, which stand in where no
    template window is usable.
    """

    def rows(batches):
        vocabulary = Vocabulary()
        for batch in batches:
            made = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, kinds, hashes, literal = vocabulary.template(text)
                found, places, width = windows(words, kinds, hashes)
                template = len(found) > 0
                if not template:
                    found = literal_windows(literal)
                    places = np.arange(len(found))
                made += [
                    (item_id, value, at, _slots(words, kinds, at, width) if template else [], len(found))
                    for value, at in zip(found.tolist(), places.tolist())
                ]
            columns = list(zip(*made)) if made else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["item_id", "hash", "place", "item_slots", "n_windows"]
            )

    schema = "item_id long, hash long, place int, item_slots array<string>, n_windows int"
    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(rows, schema)


def _ranked(votes: Counter) -> dict[str, str]:
    """The document value with most votes of each item value, its own value first on ties."""
    reading: dict[str, str] = {}
    for (item, doc), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0][0] != v[0][1], v[0])):
        reading.setdefault(item, doc)
    return reading


def _readings(pairs: list[tuple[int, int, list[str], list[str]]]) -> Iterator[dict[str, str]]:
    """Document values of the item's slot values: its own, those of each occurrence, the most frequent.

    Windows of one alignment (``at`` less ``place``) vote first, then those of alignments up to
    an item's length further, where inserted words may have moved them, then all others.
    """
    votes: dict[int, list[tuple[str, str]]] = {}
    for place, at, item, doc in pairs:
        votes.setdefault(at - place, []).extend((i, d) for i, d in zip(item, doc) if i)
    whole = _ranked(Counter(v for one in votes.values() for v in one))
    yield {i: i for i in whole}
    yield whole
    aligned = sorted(votes)
    reach = max(p[0] for p in pairs)
    near: Counter = Counter()
    end = 0
    for start in aligned:
        while end < len(aligned) and aligned[end] <= start + reach:
            near.update(votes[aligned[end]])
            end += 1
        yield whole | _ranked(near) | _ranked(Counter(votes[start]))
        near.subtract(votes[start])
        near = +near


def consistent(pairs: list[tuple[int, int, list[str], list[str]]]) -> tuple[int, bool]:
    """How many places of the item agree with the reading that most places agree with.

    ``pairs`` holds (place, at, item slots, document slots); the flag tells whether some
    slot of those places differs from the item's.
    """
    items: dict[int, set[tuple[str, ...]]] = {}
    found: dict[tuple[int, tuple[str, ...]], set[tuple[str, ...]]] = {}
    for place, _, item, doc in pairs:
        items.setdefault(place, set()).add(tuple(item))
        found.setdefault((place, tuple(item)), set()).add(tuple(doc))
    most, differs, tried = 0, False, set()
    for reading in _readings(pairs):
        key = tuple(sorted(reading.items()))
        if key in tried:
            continue
        tried.add(key)
        agreed, other = 0, False
        for place, kinds in items.items():
            # A place has several slot lists only if items share an item_id.
            meant = [(item, tuple(reading[i] if i else "" for i in item)) for item in kinds]
            held = [(item, doc) for item, doc in meant if doc in found[place, item]]
            agreed += bool(held)
            other |= any(item != doc for item, doc in held)
        if agreed > most:
            most, differs = agreed, other
        if most == len(items):
            break
    return most, differs


def find_leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, near_windows: int = NEAR_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, reparameterised, text_hash of each leak."""
    known = materialise(item_windows(items), "item-windows")
    only = None
    if known.select("hash").distinct().count() <= near_windows:
        only = np.sort(np.array([r.hash for r in known.select("hash").distinct().collect()], dtype=np.int64))
    literals = not known.where(F.size("item_slots") == 0).isEmpty()
    matched = document_windows(docs, only, literals).join(known, "hash")
    # A group holds the windows of one item in one document: its size follows the
    # document's length, and pairs that cannot reach the share are gone before.
    keys = ["row", "doc_id", "text_hash", "item_id", "n_windows"]
    open_pairs = matched.groupBy(*keys).agg(
        F.count_distinct("place").alias("found"), F.collect_set(F.struct("place", "at", "item_slots", "slots")).alias("pairs")
    ).where(F.col("found") >= F.col("n_windows") * share)

    def judge(frames):
        for frame in frames:
            agreed, other = [], []
            for pairs in frame["pairs"]:
                places, differs = consistent([(p["place"], p["at"], list(p["item_slots"]), list(p["slots"])) for p in pairs])
                agreed.append(places)
                other.append(differs)
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "item_id": frame["item_id"].astype("Int64"),
                    "n_windows": frame["n_windows"].astype("int64"),
                    "n_matched": pd.Series(agreed, dtype="int64", index=frame.index),
                    "reparameterised": pd.Series(other, dtype="bool", index=frame.index),
                    "text_hash": frame["text_hash"],
                }
            )

    schema = "doc_id long, item_id long, n_windows long, n_matched long, reparameterised boolean, text_hash long"
    return open_pairs.mapInPandas(judge, schema).where(F.col("n_matched") >= F.col("n_windows") * share)


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """One row a leaked item of a document."""
    return find_leaks(docs, items, share).drop("text_hash").distinct()


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    doc, text = unused(docs, "leaking_id"), unused(docs, "leaking_hash")
    found = materialise(
        find_leaks(docs, items, share).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct(), "leaks"
    )
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text))
    return docs.join(found, same, "left_anti")
