"""Cheapest repairs against a search over costs to go, and whole conversations by hand."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from pyspark.sql import Row

from fathom.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, fault string, found_id int, copies int"


def table(spark, rows):
    return spark.createDataFrame([Row(c, t, r, x, "f", 1, 2) for c, t, r, x in rows], SCHEMA)


def brute(codes):
    """Least cost and ASCII-least audit from exact costs to go."""
    size = len(codes)

    def inserts(costs):
        costs = dict(costs)
        for _ in range(4):
            for s in range(4):
                costs[s] = min(costs.get(s, 1 << 60), costs.get(tr.MADE[s], 1 << 60) + 2)
        return costs

    togo = [{} for _ in range(size)] + [inserts({0: 0, 3: 0})]

    def steps(i, s):
        code = codes[i] if i < size else ""
        worse = code.isupper()
        if code:
            yield "D", i + 1, s, 3
        yield "I", i, tr.MADE[s], 2
        if code and code != "-":
            kept = tr.FOLLOWS[s].get(code.lower())
            if kept is not None:
                yield "K", i + 1, kept, worse
            yield "R", i + 1, tr.MADE[s], 2 + worse

    for i in range(size - 1, -1, -1):
        togo[i] = inserts({s: min(c + togo[j][n] for e, j, n, c in steps(i, s) if e != "I") for s in range(4)})
    i = state = 0
    audit = ""
    while not (i == size and state in (0, 3)):
        edit, i, state, _ = next(x for x in steps(i, state) if x[3] + togo[x[1]][x[2]] == togo[i][state])
        audit += edit
    return togo[0][0], audit


def test_audits_match_brute_force():
    dealt = random.Random(4)
    for _ in range(1500):
        codes = "".join(dealt.choice(dealt.choice(["suax-SUAX", "uaua-UA", "sua", "ua"])) for _ in range(dealt.randrange(14)))
        want = brute(codes)
        for block in (1, 2, 5, 8, 32):
            assert tr.best_audit(codes, block) == want, (codes, block)
    codes = "".join(dealt.choice("uauauaUAsx-") for _ in range(3000))
    assert tr.best_audit(codes) == brute(codes)


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def expected(rows):
    by_conv = {row[0]: [] for row in rows}
    for row in damaged(rows):
        by_conv[row[0]].append(row)
    out = []
    for conv, turns in by_conv.items():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, codes, counts, illegal = set(), "", [0, 0, 0], 0
        for place, (_, _, role, text) in enumerate(turns):
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            code = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "-" if fault in (0, 1) else code.upper() if fault == 2 else code
            illegal += place > 0 and turns[place - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        numbers = {t for _, t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        cost, audit = brute(codes)
        kept = [f"{role}:{text}" for _, role, text in tr.repaired(iter([(r, t) for _, _, r, t in turns]), audit)]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_damaged_conversations_match_by_hand(spark):
    dealt = random.Random(8)
    roles = ["user", "assistant", "system", "tool", "", None, "umpire"]
    texts = ["Yes.", "No!", "cut off", "", None, " \t\n", "é?\n", "a b. c"]
    rows = [
        (dealt.choice([1, 2, 3, 4, 5, None]), dealt.choice([None, *range(40)]), dealt.choice(roles), dealt.choice(texts) if dealt.random() < 0.4 else f"Text {dealt.random()}.")
        for _ in range(220)
    ]
    rows += [(9, t, "user" if t % 2 == 0 else "assistant", "Same." if t % 7 == 0 else f"Turn {t}.") for t in range(300)]
    rows += [rows[0], rows[5], (10, 3, "user", "x" * 100_000)]
    rows += [(c, t, "user", "Alone.") for c in range(20, 60) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = tr.repair_damaged(table(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(rows)
    assert tr.repair_damaged(table(spark, [])).count() == 0


def test_rows_beyond_memory_and_in_any_block(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t} of {c}." * 20) for c in range(3) for t in range(100) if (c * t) % 9 != 1]
    whole = sorted(map(tuple, tr.repair_report(table(spark, rows)).collect()))
    assert whole == sorted(map(tuple, tr.repair_report(table(spark, rows), block=3, held=500).collect()))
    kept = tr.repair_rows(table(spark, rows), held=500).collect()
    for conv_id, *_, n, digest in whole:
        lines = [f"{r.role}:{r.text}" for r in sorted((r for r in kept if r.conv_id == conv_id), key=lambda r: r.place)]
        assert len(lines) == n and hashlib.sha256("\n".join(lines).encode()).hexdigest() == digest
