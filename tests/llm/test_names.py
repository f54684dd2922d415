"""Stages keep extra columns of any name and never take them for their own."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathom.llm import decontamination, exact_dedup, near_dedup
from fathom.llm.names import unused

TEXT = "what remains of fifteen green apples after the second visitor has eaten three of them"
NAMES = ["_digest", "_keep", "digest", "KEEP_ID", "_kept", "kept_id", "Kept_Id_", "_doc", "_hash", "leaking_id", "leaking_hash", "body", "row"]


@pytest.fixture
def docs(spark):
    rows = [(1, TEXT), (2, TEXT), (3, f"{TEXT} today"), (4, None), (5, "some other words that nothing repeats at all")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.select("*", *[F.lit(-i).alias(name) for i, name in enumerate(NAMES)])


def test_names_are_free_in_any_case(docs):
    assert unused(docs, "digest") == "digest_" and unused(docs, "kept_id") == "kept_id__" and unused(docs, "free") == "free"


def test_stages_keep_clashing_columns(spark, docs):
    items = spark.createDataFrame([(7, TEXT)], "item_id long, text string")
    for kept, ids in (
        (exact_dedup.drop_copies(docs), [1, 3, 4, 5]),
        (near_dedup.drop_near_copies(docs), [1, 4, 5]),
        (decontamination.drop_contaminated(docs, items), [4, 5]),
    ):
        rows = kept.orderBy("doc_id").collect()
        assert kept.columns == docs.columns and [r["doc_id"] for r in rows] == ids
        assert all(tuple(r)[2:] == tuple(-i for i in range(len(NAMES))) for r in rows)
