"""Toxicity by a weighted lexicon that an Aho-Corasick automaton finds in folded texts.

Folding lower-cases, drops accents and invisible characters, replaces look-alike
letters of other scripts, reads digits and signs inside words as the letters they
stand for, joins letters spelled out with separators and shortens stretched letters.

The lexicon is learned: word starts and whole words whose share of toxic labelled rows
exceeds their share of the others get the log ratio as weight. Phrases of a lexicon
word and a neighbour that clean rows have and toxic rows do not are exceptions: inside
them the word does not count. A text's weights are summed over its words (the heaviest
entry of each word), related to its length, and a logistic curve fitted on the same
rows turns that into a score between 0 and 1.

Learning reads at most ``SAMPLE_ROWS`` labelled rows, chosen by a hash of doc_id and one
for each (of several texts of a doc_id the least), which is the only sample; all entries
of the sample that pass the tests are used; scoring covers every whole text. Rows of the held-out fold are never
learned from, and lang, source, labels and doc_id never enter a score.

Defined cases: null and empty texts have no matches and get the score of a text
without any; null or missing labels are not learned from; several labels of a row count
as toxic if one does; without toxic or without clean labels every score is the share of
toxic rows; repeated rows are scored each; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.plans.storage import materialise

SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 5, 0
COUNTED_ENTRIES = 500_000
START_LENGTHS = (4, 5, 6, 7, 8, 10)
LEAST_ROWS = 5
LEAST_WEIGHT = 0.7
ERRORS = 1.64
GAIN = 0.7
SPREAD = 1.3
CACHE_TOKENS = 500_000

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(
    zip(
        "аеорсухіјѕԁһӏкмтвнгпαεορυικντχγβηωμ",
        "aeopcyxijsdhlkmtbhrnaeopuikvtxybnwm",
    )
)
# Digits and signs read as letters.
SUBSTITUTES = str.maketrans("0134578@$!|+", "oieastbasiit")
INVISIBLE = "​‌‍⁠﻿­"
PLAIN = str.maketrans(LOOK_ALIKES | {ch: None for ch in INVISIBLE})
MIXED_WORD = re.compile(r"[a-z0-9@$!|+]*[0-9@$!|+][a-z0-9@$!|+]*")
SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_*·][^\W\d_]){3,}(?![^\W_])")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
WORD = re.compile(r"[^\W\d_]+")


def _mixed(match: re.Match) -> str:
    word = match[0].rstrip("@$!|+")
    if not any("a" <= ch <= "z" for ch in word):
        return match[0]
    return word.translate(SUBSTITUTES) + " "


def folded(text: str) -> str:
    """``text`` as the lexicon sees it."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(ch for ch in text if not unicodedata.combining(ch)) if not text.isascii() else text
        text = text.lower().translate(PLAIN)
    text = MIXED_WORD.sub(_mixed, text)
    text = SPELLED.sub(lambda m: re.sub(r"[.\-_*·]", "", m[0]), text)
    return STRETCHED.sub(r"\1", text)


def words_of(text: str) -> list[str]:
    return WORD.findall(folded(text))


def entries_of(word: str) -> list[str]:
    """The lexicon entries a word can match: its starts and itself, marked by spaces."""
    return [" " + word[:n] for n in START_LENGTHS if len(word) >= n] + [f" {word} "]


class Finder(dict):
    """Whether a token holds a lexicon entry, remembered for a bounded number of tokens.

    Most texts have none, and no entry crosses white space, so only the others are
    folded and searched as a whole.
    """

    def __init__(self, automaton, entries: int = CACHE_TOKENS):
        self.automaton, self.entries = automaton, entries

    def __missing__(self, token: str) -> bool:
        if len(self) >= self.entries:
            self.clear()
        line = f" {' '.join(words_of(token))} "
        found = self[token] = any(weight is not None for _, (_, weight) in self.automaton.iter(line))
        return found


@dataclass
class Lexicon:
    """Weights of entries, exception phrases and the curve from matches to a score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: list[float] = field(default_factory=list)
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    base: float = 0.0

    def finder(self) -> Finder:
        return Finder(self.automaton())

    def automaton(self):
        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found

    def features(self, text: str | None, finder: Finder) -> list[float]:
        """Weighted matches, matches, heaviest match and the first two by length."""
        if not self.weights or not text or not any(map(finder.__getitem__, text.split())):
            return [0.0] * 5
        words = words_of(text)
        line = f" {' '.join(words)} "
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, weight) in finder.automaton.iter(line):
            start = end - length + 1
            if weight is None:
                spared.append((start, end))
            elif weight > best.get(start, -1e9):
                best[start] = weight
        for start, end in spared:
            for inside in [s for s in best if start <= s < end]:
                del best[inside]
        if not best:
            return [0.0] * 5
        total, size = sum(best.values()), len(words)
        return [np.log1p(total), np.log1p(len(best)), max(best.values()), np.log1p(100 * total / size), 100 * len(best) / size]

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.curve:
            return np.full(len(features), self.base)
        x = (features - np.array(self.centre)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.curve[1:]) + self.curve[0], -40, 40)))


def fitted(features: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> tuple[list, list, list]:
    """Logistic regression by Newton steps on standardised features."""
    centre, scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-6)
    x = np.column_stack([np.ones(len(features)), (features - centre) / scale])
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - toxic) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist(), centre.tolist(), scale.tolist()


def candidates(counts: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """Entries of enough toxic rows whose ratio is well above its standard error.

    A start must cover clearly more rows than its most frequent word, or the word itself
    serves.
    """
    counts = counts.where(F.col("toxic") >= LEAST_ROWS)
    starts = F.array_distinct(F.array(*(F.substring("entry", 1, n + 1) for n in START_LENGTHS)))
    words = counts.where(F.col("entry").endswith(" ")).select(F.explode(starts).alias("entry"), F.col("toxic").alias("word"))
    most = words.groupBy("entry").agg(F.max("word").alias("word"))
    toxic, clean = F.col("toxic") + 0.5, F.col("clean") + 0.5
    # The driver repeats this test; the small allowance is for the last bit of the logarithm.
    weight = F.log(toxic / (toxic_rows + 1)) - F.log(clean / (clean_rows + 1))
    clear = weight - ERRORS * F.sqrt(1 / toxic + 1 / clean) >= LEAST_WEIGHT - 1e-9
    covers = F.col("entry").endswith(" ") | F.col("word").isNull() | (F.col("toxic") >= SPREAD * F.col("word"))
    return counts.where(clear).join(most, "entry", "left").where(covers).select("entry", "toxic", "clean")


def chosen(counts: dict[str, tuple[int, int]], toxic_rows: int, clean_rows: int) -> dict[str, float]:
    """The candidates with their log ratios; a longer one beside a shorter must say clearly more."""
    weights: dict[str, float] = {}
    for entry in sorted(counts, key=lambda e: (len(e), e)):
        toxic, clean = counts[entry]
        weight = float(np.log((toxic + 0.5) / (toxic_rows + 1)) - np.log((clean + 0.5) / (clean_rows + 1)))
        error = ERRORS * float(np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))
        shorter = max((weights[entry[:n]] for n in range(2, len(entry)) if entry[:n] in weights), default=None)
        if weight - error >= LEAST_WEIGHT and (shorter is None or weight >= shorter + GAIN):
            weights[entry] = weight
    return weights


def fold_of(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string")) % FOLDS).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Text and label of at most ``rows`` rows outside the held-out fold, chosen by hash."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # At most ``rows`` short rows, so the broadcast is bounded by the parameter.
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    single = texts.groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"), F.max("toxic").alias("toxic"))
    dealt = single.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id")
    return materialise(dealt.select("text", "toxic"), "labelled")


def _counted(sample: DataFrame, entries) -> DataFrame:
    """Rows with each entry, by label; ``entries`` maps a text to its distinct entries."""

    def batch_of(found):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([e for e, _ in found], pa.string()),
                pa.array([t for _, t in found], pa.int32()),
                pa.array(list(found.values()), pa.int64()),
            ],
            names=["entry", "toxic", "n"],
        )

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.update((entry, toxic) for entry in entries(text))
                # Full counters move on; Spark sums the parts.
                if len(found) > COUNTED_ENTRIES:
                    yield batch_of(found)
                    found = Counter()
        if found:
            yield batch_of(found)

    counted = sample.select("text", F.col("toxic").cast("int")).mapInArrow(count, "entry string, toxic int, n long")
    return counted.groupBy("entry").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("toxic") == 1, 0).otherwise(F.col("n"))).alias("clean"),
    )


def learned(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Lexicon:
    """The lexicon, its exceptions and the curve from a bounded labelled sample."""
    sample = labelled_sample(docs, labels, rows)
    sizes = {bool(r.toxic): r.n for r in sample.groupBy((F.col("toxic") == 1).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic_rows, clean_rows = sizes.get(True, 0), sizes.get(False, 0)
    lexicon = Lexicon(base=toxic_rows / max(1, toxic_rows + clean_rows))
    if not toxic_rows or not clean_rows:
        return lexicon

    def all_entries(text):
        return {e for word in set(words_of(text)) for e in entries_of(word)}

    # Only entries that pass the tests reach the driver: few, and bounded by the sample.
    counts = materialise(_counted(sample, all_entries).where(F.col("toxic") >= LEAST_ROWS), "entries")
    passed = candidates(counts, toxic_rows, clean_rows).collect()
    lexicon.weights = chosen({r.entry: (r.toxic, r.clean) for r in passed}, toxic_rows, clean_rows)
    if not lexicon.weights:
        return lexicon
    entries = frozenset(lexicon.weights)

    def phrases(text):
        words = words_of(text)
        at = [i for i, word in enumerate(words) if not entries.isdisjoint(entries_of(word))]
        pairs = [pair for i in at for pair in (words[max(0, i - 1) : i + 1], words[i : i + 2])]
        return {f" {' '.join(pair)} " for pair in pairs if len(pair) == 2}

    spared = _counted(sample, phrases).where((F.col("clean") >= LEAST_ROWS) & (F.col("toxic") == 0))
    lexicon.exceptions = {r.entry for r in spared.collect()}

    def measured(batches):
        finder = lexicon.finder()
        for batch in batches:
            rows = [lexicon.features(t, finder) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    points = sample.select("text", F.col("toxic").cast("int")).mapInArrow(measured, "x array<double>, toxic int").collect()
    features = np.array([p.x for p in points])
    toxic = np.array([float(p.toxic == 1) for p in points])
    lexicon.curve, lexicon.centre, lexicon.scale = fitted(features, toxic)
    return lexicon


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""

    def score(batches):
        finder = lexicon.finder()
        for batch in batches:
            features = np.array([lexicon.features(t.as_py(), finder) for t in batch.column(1)]).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lexicon.score(features), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    held_out = F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return rows.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted")
    )


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    return scored(docs, learned(docs, labels, rows))


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows of ``docs`` scored below one half, with all their columns."""

    def keep(batches):
        finder = lexicon.finder()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            features = np.array([lexicon.features(t.as_py(), finder) for t in texts]).reshape(-1, 5)
            yield batch.filter(pa.array(lexicon.score(features) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
