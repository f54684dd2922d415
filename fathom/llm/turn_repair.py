"""Cheapest repairs of conversations by iterative-deepening A*.

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``. Each row may be kept
(no cost), given the role user or assistant (2) or deleted (3); blank rows and rows that repeat an
earlier role and text must be deleted; an empty turn of a user or assistant may be inserted anywhere
(2); a truncated row that stays adds 1. An audit is the string of the edits' initials. As the
pattern allows one role after another, it says what each Rerole and Insert makes.

:func:`cheapest` searches depth first, edits in ASCII order (Delete, Insert, Keep, Rerole), under a
cost bound that grows to the least cost that exceeded it. States (row, expected role) that failed
under the bound are remembered with their cost, and the first accepting path is the answer: all
paths within the last bound cost the same, so it is the ASCII-least of the cheapest. The heuristic
adds what the faults of the remaining rows cost at least and 2 for every two neighbours in them
that cannot follow each other: no edit costs less than 2 more, and none mends more than two such
pairs.

The bound must not grow with the conversation, so it is searched in blocks of ``BLOCK`` rows, from
each state a block may be entered in to each it may be left in, and the blocks' costs are chained
from the end. A path through a block ends with an edit of the block's last row, so of two such
audits none begins with the other, and the least block audit is the beginning of the least whole.

Rows meet sorted by conversation, and tasks read them as a stream: a task holds one code a row of
the conversation at hand, and its texts up to ``HELD`` bytes; more go to a temporary file of the
task. A text over the whole conversation, as its hash, needs its rows in one task.

Defined cases: null roles and texts are one space; rows go by turn, nulls first, rows of one turn by
role and text; equal initials are equal roles to the pattern, and a role of another initial is never
kept; rows with a null conv_id are one conversation; a conversation without rows has no row here; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 8
HELD = 32 * 1024 * 1024
BLANKS = " \t\n\x0b\f\r"

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
# States of the pattern: begin, after system, after user, after assistant (0 and 3 accept).
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
MADE = (2, 2, 3, 2)
STANDING = {"s": 1, "u": 2, "a": 3}
ACCEPT = -1


def _ends(state: int, goal: int) -> bool:
    return state in (0, 3) if goal == ACCEPT else state == goal


@functools.lru_cache(maxsize=1 << 16)
def cheapest(codes: str, entry: int = 0, goal: int = ACCEPT) -> tuple[int, str] | None:
    """Least cost and audit of the rows ``codes`` from state ``entry`` to ``goal``.

    A row is its role's initial (``x`` for others), in upper case if truncated, or ``-`` if it must
    go. Only the goal ``ACCEPT`` lets inserts follow the last row.
    """
    size = len(codes)
    if goal == 0 and entry != 0 or goal == 1 and not (entry == 1 or entry == 0 and "s" in codes.lower()):
        return None
    # From each row on: what faults cost at least, the next row that may stay, neighbours that clash.
    faults, alive, clashes = [0] * (size + 1), [size] * (size + 1), [0] * (size + 1)
    for i in range(size - 1, -1, -1):
        code = codes[i]
        if code == "-":
            faults[i], alive[i], clashes[i] = faults[i + 1] + DELETE, alive[i + 1], clashes[i + 1]
            continue
        after, state = alive[i + 1], STANDING.get(code.lower())
        if after < size:
            good = state is not None and codes[after].lower() in FOLLOWS[state]
        else:
            good = state is not None and _ends(state, goal)
        faults[i], alive[i], clashes[i] = faults[i + 1] + (TRUNCATED if code.isupper() else 0), i, clashes[after] + (not good)

    def least(i: int, state: int) -> int:
        first = alive[i]
        good = codes[first].lower() in FOLLOWS[state] if first < size else _ends(state, goal)
        return faults[i] + 2 * ((clashes[first] + (not good) + 1) // 2)

    bound = least(0, entry)
    while True:
        failed: dict[int, int] = {}
        beyond = [1 << 60]

        def search(i: int, state: int, cost: int) -> str | None:
            total = cost + least(i, state)
            if total > bound:
                beyond[0] = min(beyond[0], total)
                return None
            if i == size and _ends(state, goal):
                return ""
            if failed.get(4 * i + state, 1 << 60) <= cost:
                return None
            row = codes[i] if i < size else ""
            if row:
                rest = search(i + 1, state, cost + DELETE)
                if rest is not None:
                    return "D" + rest
            if row or goal == ACCEPT:
                rest = search(i, MADE[state], cost + INSERT)
                if rest is not None:
                    return "I" + rest
            if row and row != "-":
                worse = TRUNCATED if row.isupper() else 0
                kept = FOLLOWS[state].get(row.lower())
                if kept is not None:
                    rest = search(i + 1, kept, cost + worse)
                    if rest is not None:
                        return "K" + rest
                rest = search(i + 1, MADE[state], cost + REROLE + worse)
                if rest is not None:
                    return "R" + rest
            failed[4 * i + state] = cost
            return None

        audit = search(0, entry, 0)
        if audit is not None:
            return bound, audit
        bound = beyond[0]


def best_audit(codes: str, block: int = BLOCK) -> tuple[int, str]:
    """Least cost and ASCII-least audit of a whole conversation, block by block."""
    blocks = [codes[i : i + block] for i in range(0, len(codes), block)] or [""]
    # For each block, from its end: by state of entry the cost to go, the audit and the state left in.
    plans: list[list[tuple[int, str, int] | None]] = []
    last = blocks.pop()
    plans.append([(*cheapest(last, state), ACCEPT) for state in range(4 if blocks else 1)])
    while blocks:
        codes = blocks.pop()
        ahead = plans[-1]
        plan: list[tuple[int, str, int] | None] = []
        for state in range(4 if blocks else 1):
            found = [(cheapest(codes, state, goal), goal) for goal in range(4)]
            plan.append(min((way[0] + ahead[goal][0], way[1], goal) for way, goal in found if way is not None))
        plans.append(plan)
    cost, state, parts = plans[-1][0][0], 0, []
    while plans:
        _, part, state = plans.pop()[state]
        parts.append(part)
    return cost, "".join(parts)


class _Turns:
    """Role and text of the rows of one conversation; beyond ``HELD`` bytes in a temporary file."""

    def __init__(self, held: int):
        self.held, self.size, self.rows, self.file = held, 0, [], None

    def add(self, role: str, text: str) -> None:
        self.rows.append((role, text))
        self.size += len(role) + len(text) + 100
        if self.size > self.held:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump(self.rows, self.file)
            self.rows, self.size = [], 0

    def __iter__(self) -> Iterator[tuple[str, str]]:
        if self.file:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield from pickle.load(self.file)
        yield from self.rows

    def close(self) -> None:
        if self.file:
            self.file.close()


def repaired(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """edit, role and text of the rows that an audit leaves."""
    rows, state = iter(turns), 0
    for edit in audit:
        if edit == "I":
            state = MADE[state]
            yield "I", "user" if state == 2 else "assistant", ""
            continue
        role, text = next(rows)
        if edit == "K":
            state = FOLLOWS[state][role[:1]]
            yield "K", role, text
        elif edit == "R":
            state = MADE[state]
            yield "R", "user" if state == 2 else "assistant", text


# Faults of a row, the first that holds.
BLANK, DUPLICATE, CUT = 1, 2, 3


def with_faults(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and ``fault`` (null if none) of every row.

    ``copy`` orders rows that are otherwise alike; without such a column all are alike. Repeats are
    found per role and text, whatever the size of the conversation.
    """
    copy = F.col("copy") if "copy" in conversations.columns else F.lit(0)
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copy.alias("copy")
    )
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    alike = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    fault = (
        F.when(last == "", BLANK)
        .when(F.row_number().over(alike) > 1, DUPLICATE)
        .when(~last.isin(".", "!", "?"), CUT)
    )
    return rows.select("*", fault.alias("fault"))


def _conversations(conversations: DataFrame, schema: str, made: Callable, held: int) -> DataFrame:
    """Rows that ``made(conv_id, codes, facts, turns)`` yields for each conversation, read as a stream."""
    id_type = conversations.schema["conv_id"].dataType
    faulty = with_faults(conversations)
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    dealt = faulty.repartition("conv_id").sortWithinPartitions(*order)
    fields = T.StructType([T.StructField("conv_id", id_type), *T._parse_datatype_string(schema).fields])
    out = pa.schema([(f.name, _arrow(f.dataType)) for f in fields.fields])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple] = []
        size = 0
        current, codes, facts, turns, latest, before = None, [], None, None, None, None

        def finish() -> Iterator[tuple]:
            yield from made(current, "".join(codes), facts, turns)
            turns.close()

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*ready))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)]
            for conv_id, turn, role, text, fault in zip(*columns):
                if turns is None or conv_id != current:
                    if turns is not None:
                        for row in finish():
                            ready.append(row)
                            size += sum(len(v) for v in row if isinstance(v, str)) + 100
                            if size > held:
                                yield flushed()
                                ready, size = [], 0
                    current, codes, turns, latest, before = conv_id, [], _Turns(held), None, None
                    facts = {"least": None, "most": None, "turns": 0, BLANK: 0, DUPLICATE: 0, CUT: 0, "illegal": 0}
                if turn is not None and (latest is None or turn != latest):
                    facts["turns"] += 1
                    facts["least"] = turn if facts["least"] is None else facts["least"]
                    facts["most"] = latest = turn
                initial = role[:1]
                if before is not None and before + initial not in ("su", "ua", "au"):
                    facts["illegal"] += 1
                before = initial
                if fault:
                    facts[fault] += 1
                code = initial if initial in STANDING else "x"
                codes.append("-" if fault in (BLANK, DUPLICATE) else code.upper() if fault == CUT else code)
                turns.add(role, text)
        if turns is not None:
            for row in finish():
                ready.append(row)
                size += sum(len(v) for v in row if isinstance(v, str)) + 100
                if size > held:
                    yield flushed()
                    ready, size = [], 0
        if ready:
            yield flushed()

    return dealt.mapInArrow(stream, fields)


def _arrow(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


REPORT = (
    "n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_rows long, repaired_sha256 string"
)


def repair_report(conversations: DataFrame, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """One row a conversation: counts of faults, cost and audit of the cheapest repair, and its hash."""

    def made(conv_id, codes, facts, turns):
        cost, audit = best_audit(codes, block)
        digest, rows = hashlib.sha256(), 0
        for _, role, text in repaired(turns, audit):
            digest.update(f"{chr(10) if rows else ''}{role}:{text}".encode())
            rows += 1
        gaps = facts["most"] - facts["least"] + 1 - facts["turns"] if facts["turns"] else 0
        counts = (facts[BLANK], facts[DUPLICATE], facts[CUT], facts["illegal"])
        yield (conv_id, len(codes), gaps, *counts, cost, audit, rows, digest.hexdigest())

    return _conversations(conversations, REPORT, made, held)


def repair_rows(conversations: DataFrame, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """The repaired conversations: conv_id, place from 0, edit (K, R or I), role, text."""

    def made(conv_id, codes, facts, turns):
        _, audit = best_audit(codes, block)
        for place, row in enumerate(repaired(turns, audit)):
            yield (conv_id, place, *row)

    return _conversations(conversations, "place long, edit string, role string, text string", made, held)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults dealt by the checksum of conversation and turn."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        (F.crc32(name) % 20).alias("fault_kind"),
    ).where("fault_kind <> 0")

    def on(kind: int, changed: Column, column: str) -> Column:
        return F.when(F.col("fault_kind") == kind, changed).otherwise(F.col(column))

    emptied = F.when(F.col("fault_kind") == 1, F.lit("")).when(F.col("fault_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
    return rows.select(
        "conv_id",
        "turn",
        on(4, F.lit("user"), "role").alias("role"),
        emptied.when(~F.col("fault_kind").isin(1, 2), F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(0), F.when(F.col("fault_kind") == 3, 1).otherwise(0))).alias("copy"),
    )


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Damage ``conversations`` and repair them: one row for every conv_id there was."""
    report = repair_report(damaged(conversations))
    all_ids = conversations.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = hashlib.sha256(b"").hexdigest()
    found = report.withColumnRenamed("conv_id", "found_id")
    return all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id",
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
