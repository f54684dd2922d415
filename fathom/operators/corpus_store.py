"""Corpora on disk, changed by whole versions.

Records lie in a folder a corpus and change, categories and audit in a folder a change. A manifest
names the folders that make up a version; it is written last, so records, categories and audit of one
change become visible together or not at all, and a change writes only the corpora it touches. Folders
of earlier versions stay until :func:`vacuum`, so readers keep the version they opened.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators.corpus import AUDIT_SCHEMA, upsert_categories
from fathom.sources.corpora import CATEGORY_SCHEMA, RECORD_SCHEMA, conform


class Version(NamedTuple):
    number: int
    records: DataFrame
    categories: DataFrame
    audit: DataFrame


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def _numbers(spark: SparkSession, path: str, ending: str) -> list[int]:
    files, place = _files(spark, path)
    folder = place(f"{path}/_versions")
    if not files.exists(folder):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(folder)]
    return sorted(int(name.split(".")[0]) for name in names if name.endswith(ending) and name.split(".")[0].isdigit())


def _manifest(spark: SparkSession, path: str, number: int | None) -> tuple[int, dict]:
    known = _numbers(spark, path, ".json")
    if number is None and not known:
        return 0, {"corpora": {}, "categories": None, "audit": []}
    chosen = known[-1] if number is None else number
    if chosen not in known:
        raise ValueError(f"The corpus store has no version {chosen}; it has {known}.")
    text = spark.read.text(f"{path}/_versions/{chosen}.json", wholetext=True).first()[0]
    return chosen, json.loads(text)


def _publish(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Write a manifest under its number; a second one of the same number fails."""
    files, place = _files(spark, path)
    # Creating a file that must not exist is the one step that two writers cannot both do.
    files.create(place(f"{path}/_versions/{number}.taken"), False).close()
    out = files.create(place(f"{path}/_versions/{number}.tmp"), True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not files.rename(place(f"{path}/_versions/{number}.tmp"), place(f"{path}/_versions/{number}.json")):
        raise OSError(f"Version {number} could not be published.")


def open_corpora(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version of the store, the latest by default; a new store is version 0 and empty."""
    number, manifest = _manifest(spark, path, number)

    def read(folders: list[str], schema) -> DataFrame:
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{path}/{folder}" for folder in folders])

    categories = [manifest["categories"]] if manifest["categories"] else []
    return Version(
        number,
        read(list(manifest["corpora"].values()), RECORD_SCHEMA),
        read(categories, CATEGORY_SCHEMA),
        read(manifest["audit"], AUDIT_SCHEMA),
    )


def commit_corpora(
    spark: SparkSession,
    path: str,
    base: int,
    changed: dict[str, DataFrame],
    categories: DataFrame | None = None,
    audit: DataFrame | None = None,
) -> int:
    """Publish a change to version ``base`` and return its number.

    ``changed`` has all records of every corpus that changed; a corpus without records is left out
    of the new version. Should someone else have changed the store since, the commit fails.
    """
    latest, manifest = _manifest(spark, path, None)
    if latest != base:
        raise RuntimeError(f"The store is at version {latest}; the change was made to {base}.")
    label = uuid.uuid4().hex
    for index, (corpus_id, records) in enumerate(changed.items()):
        folder = f"records/{label}-{index}"
        wanted = conform(records.where(F.col("corpus_id") == corpus_id), RECORD_SCHEMA)
        wanted.write.parquet(f"{path}/{folder}")
        manifest["corpora"].pop(corpus_id, None)
        if not spark.read.parquet(f"{path}/{folder}").isEmpty():
            manifest["corpora"][corpus_id] = folder
    if categories is not None:
        manifest["categories"] = f"categories/{label}"
        conform(categories, CATEGORY_SCHEMA).write.parquet(f"{path}/{manifest['categories']}")
    if audit is not None:
        manifest["audit"] = [*manifest["audit"], f"audit/{label}"]
        conform(audit, AUDIT_SCHEMA).write.parquet(f"{path}/audit/{label}")
    number = max([base, *_numbers(spark, path, ".taken")]) + 1
    _publish(spark, path, number, manifest)
    return number


def replace_corpus(spark: SparkSession, path: str, corpus_id: str, incoming: DataFrame, named: DataFrame) -> int:
    """Swap the records of one corpus, and upsert the categories they use, in one change.

    A record id is unique in the store: an incoming record also leaves the corpus it was in, which is
    then written anew. Other corpora are not read beyond their ids.
    """
    version = open_corpora(spark, path)
    fresh = conform(incoming.withColumn("corpus_id", F.lit(corpus_id)), RECORD_SCHEMA)
    others = version.records.where(F.col("corpus_id") != corpus_id)
    ids = fresh.select("id").distinct()
    # At most one row a corpus.
    touched = [row[0] for row in others.join(ids, "id", "left_semi").select("corpus_id").distinct().collect()]
    changed = {corpus_id: fresh}
    for other in touched:
        changed[other] = others.where(F.col("corpus_id") == other).join(ids, "id", "left_anti").select(*RECORD_SCHEMA.names)
    return commit_corpora(spark, path, version.number, changed, upsert_categories(version.categories, named))


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete folders and manifests that the last ``keep`` versions do not use."""
    files, place = _files(spark, path)
    known = _numbers(spark, path, ".json")
    used = set()
    for number in known[-keep:]:
        manifest = _manifest(spark, path, number)[1]
        used |= {*manifest["corpora"].values(), manifest["categories"], *manifest["audit"]}
    for number in known[:-keep]:
        files.delete(place(f"{path}/_versions/{number}.json"), False)
    for kind in ("records", "categories", "audit"):
        if files.exists(place(f"{path}/{kind}")):
            for entry in files.listStatus(place(f"{path}/{kind}")):
                if f"{kind}/{entry.getPath().getName()}" not in used:
                    files.delete(entry.getPath(), True)
