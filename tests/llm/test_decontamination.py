"""Benchmark leaks: copies, other parameters, inconsistent slots, clean rows."""

from __future__ import annotations

import random

from pyspark.sql import Row

from fathom.llm import decontamination as decon

DOCS = "doc_id long, text string, item_id string, hash long, n_windows int"
ITEM = (
    "A train leaves the old station with 45 passengers and 12 km later meets Maria who counts 45 seats. "
    "How many seats stay empty when 12 km more have passed?"
)
PLAIN = "the quick brown fox jumps over a lazy dog while seven small owls watch from their cold branch"


def docs_of(spark, rows):
    return spark.createDataFrame([Row(i, t, "x", 1, 2) for i, t in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame([Row(i, t, 0) for i, t in rows], "item_id long, text string, doc_id int")


def cases():
    dealt = random.Random(6)
    filler = lambda n: " ".join(dealt.choice(["la", "mo", "ti", "su", "ne"]) + str(dealt.choice("abc")) for _ in range(n))
    leaking = {
        1: f"{filler(30)} {ITEM} {filler(20)}",
        2: ITEM.replace("45", "80").replace("12", "7").replace("Maria", "Paulo"),
        3: f"{filler(9)}\n{PLAIN.upper().replace(' ', '!! ')} {filler(9)}",
        4: filler(20_000) + " " + PLAIN,
        5: "only four short words",
    }
    clean = {
        10: ITEM.replace("45", "80", 1).replace("12", "7", 1).replace("Maria", "Paulo"),
        11: " ".join(PLAIN.split()[:9]) + " " + filler(40),
        12: f"{filler(10)} only four short words {filler(10)}",
        13: None,
        14: "",
        15: "1 2 3 4 5 6 7 8 9",
        16: filler(300),
    }
    return leaking, clean


def test_leaks_are_found_and_clean_rows_left(spark):
    leaking, clean = cases()
    docs = docs_of(spark, [*leaking.items(), *clean.items(), (1, leaking[1])])
    items = items_of(spark, [(1, ITEM), (2, PLAIN), (3, "only four short words"), (4, None), (5, "")])
    got = {(r.doc_id, r.item_id): r for r in decon.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3)}
    assert [got[k].reparameterised for k in sorted(got)] == [False, True, False, False, False]
    far = decon.find_leaks(docs, items, near_windows=0).drop("text_hash").distinct()
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, got.values()))
    kept = decon.drop_contaminated(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean)
    assert kept.columns == docs.columns


def test_empty_tables(spark):
    docs, items = docs_of(spark, [(1, ITEM)]), items_of(spark, [(1, ITEM)])
    assert decon.leaks(docs.limit(0), items).count() == 0
    assert decon.leaks(docs, items.limit(0)).count() == 0
    assert decon.drop_contaminated(docs, items.limit(0)).count() == 1


def test_real_tables_against_shared_word_runs(spark):
    folder = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    runs = lambda text: {tuple(w[i : i + 5]) for w in [text.lower().split()] for i in range(max(1, len(w) - 4))}
    known = [(r.item_id, runs(r.text)) for r in items.collect()]
    want = {
        (r.doc_id, item_id) for r in docs.collect() for item_id, run in known if len(run & runs(r.text)) >= 0.8 * len(run)
    }
    got = {(r.doc_id, r.item_id) for r in decon.leaks(docs, items).collect()}
    assert want <= got and len(got) <= 1.2 * len(want)


def test_two_item_values_may_share_a_document_value(spark):
    item = (
        "A baker fills 3 trays with warm rolls before the shop opens and sells 5 bags to hungry people "
        "while the other rolls wait on the wooden shelf near the old oven"
    )
    docs = docs_of(spark, [(1, item.replace("3", "4").replace("5", "4")), (2, item)])
    got = {r.doc_id: (r.n_matched == r.n_windows, r.reparameterised) for r in decon.leaks(docs, items_of(spark, [(1, item)])).collect()}
    assert got == {1: (True, True), 2: (True, False)}


SUM = (
    "Each of the 45 green boxes holds 12 apples that a farmer picked before sunrise and carried slowly "
    "down to the market"
)


def test_copies_with_different_parameters_are_read_apart(spark):
    one, two = SUM.replace("45", "80").replace("12", "7"), SUM.replace("45", "30").replace("12", "9")
    swapped = SUM.replace("45", "30").replace("12", "7")
    inserted = one.replace("that a", "that indeed a")
    docs = docs_of(
        spark,
        [(1, f"{one}. {two}."), (2, f"{one}. {two}. {swapped}."), (3, f"{two} so what. {inserted}. {SUM}."), (4, one), (5, "80 and 7. " + SUM)],
    )
    got = {r.doc_id: (r.n_windows - r.n_matched, r.reparameterised) for r in decon.leaks(docs, items_of(spark, [(1, SUM)])).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (0, False), 4: (0, True), 5: (0, False)}


def test_a_reading_spans_inserted_words_and_parts():
    slots = lambda *values: ["", *values]
    item = [slots("<number>1", "<number>2"), slots("<number>2", "<number>3"), slots("<number>3", "<number>4")]
    copy = lambda at, *n: [
        (p, a, i, slots(f"<number>{n[p]}", f"<number>{n[p + 1]}")) for p, (a, i) in enumerate(zip(at, item))
    ]
    worksheet = copy((10, 11, 12), 5, 6, 7, 8) + copy((30, 31, 33), 9, 1, 4, 6) + copy((60, 61, 62), 5, 1, 7, 6)
    assert decon.consistent(worksheet) == (3, True)
    assert decon.consistent(copy((30, 31, 90), 9, 1, 4, 6)) == (3, True)
    # No reading gives 2 two values, as the halves of these copies would need.
    mixed = copy((10,), 5, 6) + [(1, 11, item[1], slots("<number>7", "<number>8"))]
    assert decon.consistent(mixed) == (1, True)


def test_items_of_slots_alone_are_found_as_they_are(spark):
    numbers, names = "1 1 2 3 5 8 13 21 34 55", "Anna, Boris, Carla, Dmitri, Emil, Fatima, Goran"
    around = lambda text: f"{PLAIN}. It holds {text} in its {PLAIN}"
    docs = docs_of(
        spark,
        [
            (1, around(numbers)),
            (2, around(names.replace(",", "."))),
            (3, numbers),
            (4, around("1 1 2 3 5 9 13 21 34 55")),
            (5, around("Anna, Boris, Carla, Igor, Emil, Fatima, Goran")),
            (6, around("1 1 2 3 5")),
            (7, "7 8 9"),
            (8, around("7 8 9")),
        ],
    )
    items = items_of(spark, [(1, numbers), (2, names), (3, "7 8 9"), (4, ITEM)])
    for near_windows in (100, 0):
        got = decon.find_leaks(docs, items, near_windows=near_windows).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (3, 1), (7, 3)}
        assert not any(r.reparameterised for r in got)
