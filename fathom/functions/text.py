"""Text expressions: trimming, folding, tokens, segments, tags, ids."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped from both ends of free text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Full case folding where it differs from lower case and yields
# letters that tokens or keywords can contain.
FOLD_ONE_TO_ONE = {"\u017f": "s", "\u03c2": "\u03c3", "\u00b5": "\u03bc"}
FOLD_ONE_TO_MANY = {
    "\u00df": "ss",
    "\u0149": "\u02bcn",
    "\u01f0": "j\u030c",
    "\u1e96": "h\u0331",
    "\u1e97": "t\u0308",
    "\u1e98": "w\u030a",
    "\u1e99": "y\u030a",
    "\u1e9a": "a\u02be",
    "\ufb00": "ff",
    "\ufb01": "fi",
    "\ufb02": "fl",
    "\ufb03": "ffi",
    "\ufb04": "ffl",
    "\ufb05": "st",
    "\ufb06": "st",
}

# Token and segment patterns.
TOKEN_RUN = "([\u4e00-\u9fff]{2,}+|[a-z0-9_]{2,}+)"
IDEOGRAPH_START = "^[\u4e00-\u9fff]"
IDEOGRAPHS_TO_PAIR = "[\u4e00-\u9fff]{5}"
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
PARAGRAPH_BREAK = "(?U)(?:\\r?\\n[\\s\\x1c-\\x1f]*){2,}"
SENTENCE_END = "(?<=[。！？!?\\.])"
SENTENCE_BREAK = f"(?U){SENTENCE_END}[\\s\\x1c-\\x1f]*"

SPLIT_MODES = ("non_empty_line", "paragraph", "sentence", "custom_delimiter", "whole_input")


def strip(text: Column) -> Column:
    """Remove white space of any script from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def casefold(text: Column) -> Column:
    """Fold case for matching. Texts without special letters pay for one test only."""
    lowered = F.lower(text)
    folded = lowered
    for letter, replacement in {**FOLD_ONE_TO_ONE, **FOLD_ONE_TO_MANY}.items():
        folded = F.replace(folded, F.lit(letter), F.lit(replacement))
    # ASCII characters, which are most, fail the first half of the class.
    special = "[[^\\x00-\\x7f]&&[" + "".join((*FOLD_ONE_TO_ONE, *FOLD_ONE_TO_MANY)) + "]]"
    return F.when(lowered.rlike(special), folded).otherwise(lowered)


def run_tokens(run: Column) -> Column:
    """Tokens of one run: long ideograph runs become overlapping pairs."""
    pairs = F.transform(
        F.sequence(F.lit(1), F.length(run) - 1), lambda start: F.substring(run, start, 2)
    )
    return F.when(
        (F.length(run) > 4) & run.rlike(IDEOGRAPH_START), pairs
    ).otherwise(F.array(run))


def tokens(text: Column) -> Column:
    """All tokens of a text in order; one-character runs are dropped.

    Only texts with a long ideograph run pay for a look at every run.
    """
    runs = F.regexp_extract_all(casefold(text), F.lit(TOKEN_RUN), F.lit(1))
    return F.when(text.rlike(IDEOGRAPHS_TO_PAIR), F.flatten(F.transform(runs, run_tokens))).otherwise(runs)


def raw_segments(text: Column, mode: str, delimiter: str = "") -> Column:
    """Split a text by ``mode``; segments are neither trimmed nor dropped yet."""
    if mode == "whole_input":
        return F.array(text)
    if mode == "paragraph":
        return F.split(text, PARAGRAPH_BREAK, -1)
    if mode == "custom_delimiter":
        if not delimiter:
            raise ValueError("custom_delimiter needs a delimiter.")
        return F.split(text, re.escape(delimiter), -1)
    if mode not in SPLIT_MODES:
        raise ValueError(f"Unknown split mode: {mode}")
    return F.split(text, SENTENCE_BREAK if mode == "sentence" else LINE_BREAK, -1)


def line_pieces(line: Column, mode: str, delimiter: str = "") -> Column:
    """One line cut at the sentence ends or delimiters in it."""
    if mode == "custom_delimiter":
        return raw_segments(line, mode, delimiter)
    return F.split(line, SENTENCE_END, -1)


def kept_segments(raw: Column) -> Column:
    return F.filter(F.transform(raw, strip), lambda segment: segment != "")


def skipped_segments(raw: Column, kept: Column, mode: str) -> Column:
    """How many blank segments were dropped.

    A final line or sentence break ends the last segment; it starts no empty one.
    """
    skipped = F.size(raw) - F.size(kept)
    if mode in ("non_empty_line", "sentence"):
        skipped -= (F.element_at(raw, -1) == "").cast("int")
    return skipped


def clean_tags(parts: Column) -> Column:
    """Trim, drop blanks, keep the first of equal tags."""
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda tag: tag != ""))


def split_tags(text: Column, separators: str = ",") -> Column:
    return clean_tags(F.split(text, "[" + re.escape(separators) + "]", -1))


def with_default_tags(tags: Column, defaults: Sequence[str]) -> Column:
    first = F.array(*[F.lit(tag) for tag in defaults]) if defaults else F.array().cast("array<string>")
    return F.array_distinct(F.concat(first, F.coalesce(tags, F.array().cast("array<string>"))))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def record_id(scope: Column, index: Column, content: Column) -> Column:
    return F.concat(
        F.lit("text_"), short_hash(F.concat_ws("\0", scope, index.cast("string"), content))
    )


def category_id(name: Column) -> Column:
    return F.concat(F.lit("cat_"), short_hash(name))


def digest_long(text: Column, limit: int = 64) -> Column:
    """A grouping key of at most ``limit`` + 72 characters that is equal only for equal texts.

    Long texts shuffle as their first characters and a SHA-256 digest. A digest
    key is longer than any text that stays as it is, so the two never meet.
    """
    return F.when(
        F.length(text) > limit,
        F.concat(F.substring(text, 1, limit), F.lit("\0sha256:"), F.sha2(text, 256)),
    ).otherwise(text)
