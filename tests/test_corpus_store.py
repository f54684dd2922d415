"""Versions of corpora on disk."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fathom.operators import corpus_store as store
from fathom.sources import corpora


def records_of(spark, ids, corpus_id="c1"):
    df = spark.createDataFrame([(i, f"text {i}", corpus_id) for i in ids], "id string, content string, corpus_id string")
    return corpora.corpus_records(df.withColumn("created_at", F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz")))


def categories_of(spark, *names):
    return corpora.conform(spark.createDataFrame([(n, n) for n in names], "id string, name string"), corpora.CATEGORY_SCHEMA)


def seen(version):
    return sorted((r["corpus_id"], r["id"]) for r in version.records.collect()), sorted(r["id"] for r in version.categories.collect())


@pytest.fixture
def path(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.open_corpora(spark, path).number == 0 and store.open_corpora(spark, path).records.count() == 0
    assert store.replace_corpus(spark, path, "c1", records_of(spark, ["r1", "r3"]), categories_of(spark, "k")) == 1
    assert store.replace_corpus(spark, path, "c2", records_of(spark, ["r2"]), categories_of(spark, "k", "m")) == 2
    return path


def test_replaced_and_moved_records_do_not_come_back(spark, path):
    assert seen(store.open_corpora(spark, path)) == ([("c1", "r1"), ("c1", "r3"), ("c2", "r2")], ["k", "m"])
    store.replace_corpus(spark, path, "c1", records_of(spark, []), categories_of(spark, "n"))
    assert seen(store.open_corpora(spark, path)) == ([("c2", "r2")], ["k", "m", "n"])
    store.replace_corpus(spark, path, "c1", records_of(spark, ["r2", "r9"]), categories_of(spark, "k"))
    assert seen(store.open_corpora(spark, path))[0] == [("c1", "r2"), ("c1", "r9")]
    assert seen(store.open_corpora(spark, path, 2))[0] == [("c1", "r1"), ("c1", "r3"), ("c2", "r2")]


def test_a_change_that_fails_between_its_writes_is_not_seen(spark, path, monkeypatch):
    before = seen(store.open_corpora(spark, path))

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(store, "_publish", fails)
        with pytest.raises(OSError):
            store.replace_corpus(spark, path, "c1", records_of(spark, ["x"]), categories_of(spark, "z"))
    assert seen(store.open_corpora(spark, path)) == before
    assert store.replace_corpus(spark, path, "c1", records_of(spark, ["x"]), categories_of(spark, "z")) == 3


def test_readers_keep_their_version_and_late_writers_fail(spark, path):
    reader = store.open_corpora(spark, path)
    store.replace_corpus(spark, path, "c2", records_of(spark, ["r5"]), categories_of(spark, "k"))
    assert seen(reader)[0] == [("c1", "r1"), ("c1", "r3"), ("c2", "r2")]
    with pytest.raises(RuntimeError, match="version 3"):
        store.commit_corpora(spark, path, reader.number, {"c1": records_of(spark, ["late"])})
    with pytest.raises(Exception, match="exists"):
        store._publish(spark, path, 3, {})
    store.vacuum(spark, path)
    assert seen(store.open_corpora(spark, path))[0] == [("c1", "r1"), ("c1", "r3"), ("c2", "r5")]
    with pytest.raises(ValueError):
        store.open_corpora(spark, path, 2)
