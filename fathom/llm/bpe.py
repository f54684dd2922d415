"""Byte-pair encoding and decoding by tree concatenation.

A text is cut at places where the tokenizer's own pre-tokenization always cuts,
and each piece is encoded once per worker and kept in a bounded cache. Text that
offers no such place is encoded in parts: documents beyond ``SPAN`` characters are
cut into spans that Spark deals over the cluster, and pieces beyond ``PIECE``
characters are halved. Neighbours are then joined pairwise, level by level: a
window around the join is encoded again and grown until it agrees with the left
and with the right side, so the result equals the encoding of the whole.

Defined cases: a null text is the empty text and has no ids; rows keep their
``doc_id`` whatever it is (null, repeated); strings of special tokens inside a
text become the special id, as the tokenizers library does; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

BYTE_LEVEL = "byte_bpe_50k.json"
SPAN = 32_768
PIECE = 4_096
WINDOW = 64
CACHE_ENTRIES = 400_000

GAP_BEFORE_SPACE = re.compile(r"\s ")
BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
# Texts for which Python and the tokenizer agree on classes, case and composition.
LATIN = re.compile("[\n\x20-\x7e\xa1-\xff]*")
LETTERS, DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
# The tokenizers' own patterns, with their letter and number classes
# written out for the characters above.
SPACED_WORDS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^\\s{LETTERS}{DIGITS}]+|\\s+(?!\\S)|\\s+"
)
BARE_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^\\s{LETTERS}{DIGITS}]+")
# One class of characters that a single pre-token covers whatever stands around it.
RUN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}']+")


class _Cache(dict):
    """Ids of pieces as bytes; emptied when full, which costs time and nothing else."""

    def __init__(self, encode, entries: int):
        self.encode, self.entries = encode, entries

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.entries:
            self.clear()
        found = self[piece] = self.encode(piece)
        return found


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """One tokenizer file; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, *, piece: int = PIECE, entries: int = CACHE_ENTRIES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.keeps_space = spec["normalizer"] is None
        self.piece = piece
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.symbols = {b: s for s, b in byte_symbols().items()}
        self.cuts = SPACED_WORDS if self.keeps_space else BARE_WORDS
        self.words = _Cache(self._merge, entries)
        self.first = _Cache(self._encode_piece, entries)
        self.spaced = _Cache(lambda word: self._encode_piece(" " + word), entries)
        if self.keeps_space:
            symbols = byte_symbols()
            size = max(spec["model"]["vocab"].values()) + 1
            self.bytes_of: list[bytes] = [b""] * max(size, 1 + max((t["id"] for t in spec["added_tokens"]), default=0))
            for token, token_id in spec["model"]["vocab"].items():
                known = all(ch in symbols for ch in token)
                self.bytes_of[token_id] = bytes(symbols[ch] for ch in token) if known else token.encode()
            for token in spec["added_tokens"]:
                self.bytes_of[token["id"]] = token["content"].encode()
            self.lengths = np.array([len(b) for b in self.bytes_of], dtype=np.int64)

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _merge(self, word: str) -> bytes:
        """The ids of one pre-token, by the library's model."""
        tokens = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.symbols))
        return np.array([t.id for t in tokens], dtype="<u4").tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        if len(piece) > self.piece:
            return (self._halved if self.keeps_space else self._library)(piece).tobytes()
        if LATIN.fullmatch(piece) and not any(s in piece for s in self.specials):
            words = self.cuts.findall(piece if self.keeps_space else piece.lower())
            return b"".join(map(self.words.__getitem__, words))
        return self._library(piece).tobytes()

    def _halved(self, piece: str) -> np.ndarray:
        if len(piece) <= self.piece:
            return self._library(piece)
        middle = len(piece) // 2
        left, right = piece[:middle], piece[middle:]
        return self.joined(left, self._halved(left), right, self._halved(right))

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as the library gives them."""
        if not text:
            return b""
        if not self.keeps_space:
            # White space is dropped and no token crosses it; the information separators
            # are white space for Python alone.
            if re.search("[\x1c-\x1f]", text):
                return b"".join(map(self.first.__getitem__, text.split(" ")))
            return b"".join(map(self.first.__getitem__, text.split()))
        if GAP_BEFORE_SPACE.search(text):
            return b"".join(map(self.first.__getitem__, BEFORE_SPACE.split(text)))
        words = text.split(" ")
        return self.first[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:]))

    def decode(self, ids: bytes) -> str:
        """The text of ``ids``; special tokens keep their strings."""
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")

    def joined(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """The ids of ``left + right`` from the ids of both.

        A token boundary of the window counts as agreed where the text itself forces a
        cut (no space before, a space after), or inside a run of one class of characters
        where the window and the side have the same token next to the boundary: in
        byte-pair encoding a sequence is the encoding exactly if all neighbouring pairs
        are, and each pair then comes from one of the two.
        """
        if not left or not right:
            return right_ids if not left else left_ids
        reach = WINDOW
        left_ends = np.cumsum(self.lengths[left_ids])
        right_starts = np.concatenate([[0], np.cumsum(self.lengths[right_ids])])
        while True:
            head, tail = left[-reach:], right[:reach]
            text = head + tail
            data = text.encode("utf-8", "surrogatepass")
            cut = len(head.encode("utf-8", "surrogatepass"))
            ids = self._library(text)
            bounds = np.concatenate([[0], np.cumsum(self.lengths[ids])])
            base = int(left_ends[-1]) - cut if len(left_ends) else 0
            in_run = not any(s in text for s in self.specials)
            a = (0, 0, 0) if reach >= len(left) else self._agree_left(
                data, cut, bounds, ids, left_ends - base, left_ids, in_run
            )
            b = (len(data), len(ids), len(right_ids)) if reach >= len(right) else self._agree_right(
                data, cut, bounds, ids, right_starts + cut, right_ids, in_run
            )
            if a and b and a[0] <= b[0]:
                return np.concatenate([left_ids[: a[2]], ids[a[1] : b[1]], right_ids[b[2] :]])
            reach *= 2

    @staticmethod
    def _forced(data: bytes, at: int) -> bool:
        return 0 < at < len(data) and data[at] == 0x20 and not data[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:].isspace()

    @staticmethod
    def _one_run(data: bytes, start: int, end: int) -> bool:
        """Whether data[start:end] lies inside characters of one class."""
        try:
            return bool(RUN.fullmatch(data[start:end].decode("utf-8")))
        except UnicodeDecodeError:
            return False

    def _agree_left(self, data, cut, bounds, ids, ends, side, in_run):
        """(byte, window tokens before it, side tokens before it), or None."""
        place = {int(v): i for i, v in enumerate(bounds)}
        for i in range(len(ends) - 1, -1, -1):
            at = int(ends[i])
            if at <= 0:
                break
            if at in place:
                k = place[at]
                if self._forced(data, at):
                    return at, k, i + 1
                if in_run and k and at < cut and ids[k - 1] == side[i] and self._one_run(data, 0, at) and self._same_class(data, at):
                    return at, k, i + 1
        return None

    def _agree_right(self, data, cut, bounds, ids, starts, side, in_run):
        place = {int(v): i for i, v in enumerate(bounds)}
        for i in range(len(side)):
            at = int(starts[i])
            if at >= len(data):
                break
            if at in place:
                k = place[at]
                if self._forced(data, at):
                    return at, k, i
                if in_run and at > cut and k < len(ids) and ids[k] == side[i] and self._one_run(data, at, len(data)) and self._same_class(data, at):
                    return at, k, i
        return None

    def _same_class(self, data: bytes, at: int) -> bool:
        """Whether the characters before and after ``at`` belong to one run."""
        before = data[max(0, at - 4) : at].decode("utf-8", "ignore")[-1:]
        after = data[at : at + 4].decode("utf-8", "ignore")[:1]
        return bool(before and after and RUN.fullmatch(before + after))


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, piece: int = PIECE) -> Codec:
    """One codec per worker process and file."""
    key = (path, piece)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, piece=piece)
    return _CODECS[key]


def concatenated(coder: Codec, parts: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """Join encoded neighbours pairwise until one is left."""
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = [
            (p[0][0] + p[1][0], coder.joined(p[0][0], p[0][1], p[1][0], p[1][1])) if len(p) == 2 else p[0]
            for p in pairs
        ]
    return parts[0][1] if parts else np.empty(0, dtype="<u4")


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(coder: Codec, ids: bytes) -> tuple[int, str, str]:
    decoded = coder.decode(ids).encode("utf-8", "replace")
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode_decode(
    docs: DataFrame,
    vocabulary: str | None = None,
    *,
    span: int = SPAN,
    piece: int = PIECE,
    outputs: str = "digests",
) -> DataFrame:
    """Encode and decode every text of ``docs`` (doc_id, text).

    ``outputs``: ``digests`` gives doc_id, n_tokens, ids_sha256 and decoded_sha256;
    ``ids`` gives doc_id, ids (binary, little-endian unsigned 32-bit) and decoded.
    """
    path = vocabulary or public_tokenizers.path(BYTE_LEVEL)
    schema = RESULT if outputs == "digests" else "doc_id long, ids binary, decoded string"
    arrow = (
        pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
        if outputs == "digests"
        else pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    )

    def rows(coder: Codec, doc_ids: list, encoded: Iterator[bytes]) -> pa.RecordBatch:
        if outputs == "digests":
            made = [(doc_id, *_digests(coder, ids)) for doc_id, ids in zip(doc_ids, encoded)]
        else:
            made = [(doc_id, ids, coder.decode(ids)) for doc_id, ids in zip(doc_ids, encoded)]
        columns = list(zip(*made)) if made else [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def whole(batches):
        coder = codec(path, piece)
        for batch in batches:
            yield rows(coder, batch.column(0).to_pylist(), (coder.encode(t.as_py()) for t in batch.column(1)))

    def spans(batches):
        coder = codec(path, piece)
        for batch in batches:
            ids = pa.array([coder.encode(t) for t in batch.column("part").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    def tree(table: pa.Table) -> pa.Table:
        coder = codec(path, piece)
        table = table.sort_by("at")
        parts = [
            (text, np.frombuffer(ids, dtype="<u4"))
            for text, ids in zip(table.column("part").to_pylist(), table.column("ids").to_pylist())
        ]
        ids = concatenated(coder, parts).astype("<u4").tobytes()
        return pa.Table.from_batches([rows(coder, table.column("doc_id").to_pylist()[:1], iter([ids]))])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    short = texts.where(size <= span).mapInArrow(whole, schema)
    starts = F.sequence(F.lit(0), F.floor((size - 1) / span).cast("int"))
    cut = (
        texts.where(size > span)
        .withColumn("row", F.monotonically_increasing_id())
        .select("doc_id", "row", "text", F.explode(starts).alias("at"))
        .select("doc_id", "row", "at", F.expr(f"substring(text, at * {span} + 1, {span})").alias("part"))
        .repartition("row", "at")
        .mapInArrow(spans, "doc_id long, row long, at int, part string, ids binary")
    )
    long = cut.groupBy("row").applyInArrow(tree, schema)
    return short.unionByName(long)
