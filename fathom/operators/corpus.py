"""Corpus tables: views, search, label edits and category governance.

Inputs are never changed: every function returns new DataFrames for the caller
to write. Guards read small aggregates before anything is returned.
"""

from __future__ import annotations

import functools
import operator
import uuid
from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import text as tx
from fathom.operators.steps import deduplicate_rows
from fathom.plans.ordering import page_rows
from fathom.sources.corpora import CATEGORY_SCHEMA, RECORD_SCHEMA, categories_for_names, conform

UNCATEGORIZED = "__uncategorized__"
AUDIT_LIMIT = 100
SEARCHED = ("content", "source", "location", "speaker", "note")

AUDIT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("corpus_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("source_category_id", T.StringType()),
        T.StructField("source_category_name", T.StringType()),
        T.StructField("target_category_id", T.StringType()),
        T.StructField("target_category_name", T.StringType()),
        T.StructField("affected_record_count", T.LongType()),
        T.StructField("note", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("schema_version", T.IntegerType()),
    ]
)


class Governed(NamedTuple):
    records: DataFrame
    categories: DataFrame
    audit: DataFrame


def record_view(records: DataFrame, corpus_id: str) -> DataFrame:
    """The records of one corpus in their order, with custom fields as a map."""
    fields = F.from_json(F.coalesce("custom_fields_json", F.lit("{}")), "map<string,string>")
    return (
        records.where(F.col("corpus_id") == corpus_id)
        .withColumn("custom_fields", fields)
        .orderBy("created_at", "id")
    )


def record_filter(
    search_text: str = "", category_id: str | None = None, uncategorized_only: bool = False
) -> Column:
    """Literal text in any searched column, ignoring case, and a category or none."""
    tests = [F.lit(True)]
    needle = search_text.strip().casefold()
    if needle:
        hits = [F.contains(tx.casefold(F.coalesce(F.col(name), F.lit(""))), F.lit(needle)) for name in SEARCHED]
        tests.append(functools.reduce(operator.or_, hits))
    if uncategorized_only:
        tests.append(F.col("primary_category_id").isNull())
    elif category_id:
        tests.append(F.col("primary_category_id") == category_id)
    return functools.reduce(operator.and_, tests)


def search_records(
    records: DataFrame,
    corpus_id: str,
    *,
    search_text: str = "",
    category_id: str | None = None,
    uncategorized_only: bool = False,
) -> DataFrame:
    return records.where(F.col("corpus_id") == corpus_id).where(
        record_filter(search_text, category_id, uncategorized_only)
    )


def record_page(
    records: DataFrame, corpus_id: str, *, limit: int, offset: int = 0, **filters: object
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of a search by creation time and id."""
    found = search_records(records, corpus_id, **filters)
    return page_rows(found, ["created_at", "id"], limit, offset)


def record_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("record_count"))


def category_usage(records: DataFrame, corpus_id: str) -> DataFrame:
    used = records.where((F.col("corpus_id") == corpus_id) & F.col("primary_category_id").isNotNull())
    return used.groupBy("primary_category_id").agg(F.count(F.lit(1)).alias("record_count"))


def category_list(categories: DataFrame) -> DataFrame:
    return categories.orderBy("name")


def category_label(uncategorized: str = "Uncategorised") -> Column:
    """Name of the joined category; a missing id has its own label, a dangling id names itself."""
    return F.coalesce(
        F.col("category_name"), F.col("primary_category_id"), F.lit(uncategorized)
    )


def with_category_names(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """Look up names for rows with ``primary_category_id``; pass counted rows, not records."""
    names = categories.select(F.col("id").alias("_category"), F.col("name").alias("category_name"))
    return rows.join(names, F.col("primary_category_id") == F.col("_category"), "left").drop("_category")


def upsert_categories(categories: DataFrame, incoming: DataFrame) -> DataFrame:
    """Replace categories that share an id or a name with an incoming one."""
    fresh = conform(incoming, CATEGORY_SCHEMA)
    kept = categories.join(fresh.select("id"), "id", "left_anti").join(
        fresh.select("name"), "name", "left_anti"
    )
    return kept.select(*CATEGORY_SCHEMA.names).unionByName(fresh)


def ensure_categories(categories: DataFrame, names: DataFrame) -> DataFrame:
    """Add the names that no category has yet, ignoring case."""
    folded = tx.casefold(F.col("name"))
    folded_names = categories_for_names(names).withColumn("folded", folded)
    new = (
        deduplicate_rows(folded_names, ["folded"], order_by=[F.asc("name")])
        .join(categories.select(folded.alias("folded")), "folded", "left_anti")
        .drop("folded")
    )
    return categories.select(*CATEGORY_SCHEMA.names).unionByName(new)


def replace_corpus(
    records: DataFrame, categories: DataFrame, corpus_id: str, incoming: DataFrame, named: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Swap the records of one corpus and upsert the categories they use.

    A record id is unique in the table, so an incoming record also replaces one
    of another corpus with its id.
    """
    fresh = conform(incoming.withColumn("corpus_id", F.lit(corpus_id)), RECORD_SCHEMA)
    kept = records.where(F.col("corpus_id") != corpus_id).join(fresh.select("id"), "id", "left_anti")
    merged = kept.select(*RECORD_SCHEMA.names).unionByName(fresh)
    return merged, upsert_categories(categories, named)


def write_corpus(records: DataFrame, path: str) -> None:
    """Write records by corpus; only the corpora present in ``records`` are replaced."""
    (
        records.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("corpus_id")
        .parquet(path)
    )


def edit_records(
    records: DataFrame,
    categories: DataFrame,
    corpus_id: str,
    edits: DataFrame,
    *,
    changed_at: datetime | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Apply edits (``id`` and any of content, category_name, tags_text, source, …) by id.

    An edit names the columns it sets; a column the edits do not have stays.
    Unknown ids and blank contents are refused before anything is returned.
    """
    known = records.where(F.col("corpus_id") == corpus_id)
    unknown = edits.join(known.select("id"), "id", "left_anti").select("id").take(5)
    if unknown:
        raise ValueError(f"Records not in corpus {corpus_id}: {', '.join(r['id'] for r in unknown)}")
    if edits.groupBy("id").count().where("count > 1").head(1):
        raise ValueError("An id is edited more than once.")
    if "content" in edits.columns:
        blank = F.coalesce(tx.strip(F.col("content")), F.lit("")) == ""
        if edits.where(blank).head(1):
            raise ValueError("An edit would leave a record without content.")
    changes: dict[str, Column] = {}
    if "content" in edits.columns:
        changes["content"] = tx.strip(F.col("content"))
    for name in ("source", "location", "speaker"):
        if name in edits.columns:
            changes[name] = F.nullif(tx.strip(F.col(name)), F.lit(""))
    if "note" in edits.columns:
        changes["note"] = F.coalesce(tx.strip(F.col("note")), F.lit(""))
    if "tags_text" in edits.columns:
        changes["tags"] = tx.split_tags(F.coalesce("tags_text", F.lit("")), ",，")
    resolved = edits
    if "category_name" in edits.columns:
        categories = ensure_categories(categories, edits.select(F.col("category_name").alias("name")))
        # Names may differ in case alone; an edit means the first of them by name.
        by_name = categories.groupBy(tx.casefold(F.col("name")).alias("_folded")).agg(
            F.min_by("id", F.struct("name", "id")).alias("_category")
        )
        folded = tx.casefold(tx.strip(F.coalesce("category_name", F.lit(""))))
        resolved = edits.join(by_name, folded == F.col("_folded"), "left")
        changes["primary_category_id"] = F.col("_category")
    new = resolved.select(
        F.col("id").alias("_edited"), *[value.alias(f"_new_{name}") for name, value in changes.items()]
    )
    joined = records.join(
        new, (F.col("id") == F.col("_edited")) & (F.col("corpus_id") == corpus_id), "left"
    )
    edited = F.col("_edited").isNotNull()
    changes_at = _time(changed_at)
    values = {name: F.when(edited, F.col(f"_new_{name}")).otherwise(F.col(name)) for name in changes}
    values["updated_at"] = F.when(edited, changes_at).otherwise(F.col("updated_at"))
    return joined.withColumns(values).select(*RECORD_SCHEMA.names), categories


def _time(moment: datetime | None) -> Column:
    moment = moment or datetime.now(timezone.utc)
    return F.lit(moment.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def _category(categories: DataFrame, category_id: str, role: str):
    row = categories.where(F.col("id") == category_id).head(1)
    if not row:
        raise ValueError(f"No category with id {category_id} ({role}).")
    return row[0]


def usage_outside(records: DataFrame, corpus_id: str, category_id: str) -> int:
    """Records of other corpora under a category."""
    used = F.col("primary_category_id") == category_id
    return records.where((F.col("corpus_id") != corpus_id) & used).count()


def _guarded_usage(records: DataFrame, corpus_id: str, category_id: str) -> int:
    """Records of the corpus under the category; use by another corpus is refused."""
    counts = (
        records.where(F.col("primary_category_id") == category_id)
        .agg(
            F.count_if(F.col("corpus_id") != corpus_id).alias("outside"),
            F.count_if(F.col("corpus_id") == corpus_id).alias("inside"),
        )
        .first()
    )
    if counts["outside"]:
        raise ValueError(f"Category is used by another corpus ({counts['outside']} records).")
    return counts["inside"]


def _audit(
    records: DataFrame, corpus_id: str, action: str, source, target, affected: int, note: str, moment: datetime | None
) -> DataFrame:
    kind = action.split("_")[0]
    row = (
        f"category_audit_{kind}_{uuid.uuid4().hex}",
        corpus_id,
        action,
        source[0],
        source[1],
        target[0],
        target[1],
        affected,
        note.strip(),
        (moment or datetime.now(timezone.utc)).replace(tzinfo=None),
        1,
    )
    return records.sparkSession.createDataFrame([row], AUDIT_SCHEMA)


def rename_category(
    records: DataFrame,
    categories: DataFrame,
    corpus_id: str,
    category_id: str,
    *,
    new_name: str,
    new_description: str = "",
    note: str = "",
    changed_at: datetime | None = None,
) -> Governed:
    name = new_name.strip()
    if not name:
        raise ValueError("Give the category a name.")
    category = _category(categories, category_id, "Category")
    clash = (F.lower("name") == F.lower(F.lit(name))) & (F.col("id") != category_id)
    if categories.where(clash).head(1):
        raise ValueError(f"Another category is called {name}.")
    affected = _guarded_usage(records, corpus_id, category_id)
    chosen = F.col("id") == category_id
    renamed = categories.withColumns(
        {
            "name": F.when(chosen, F.lit(name)).otherwise(F.col("name")),
            "description": F.when(chosen, F.lit(new_description.strip())).otherwise(F.col("description")),
            "updated_at": F.when(chosen, _time(changed_at)).otherwise(F.col("updated_at")),
        }
    )
    entry = _audit(
        records, corpus_id, "rename", (category_id, category["name"]), (category_id, name), affected, note, changed_at
    )
    return Governed(records, renamed, entry)


def _move(
    records: DataFrame, corpus_id: str, source_id: str, target: Column, changed_at: datetime | None
) -> DataFrame:
    chosen = (F.col("corpus_id") == corpus_id) & F.coalesce(
        F.col("primary_category_id") == source_id, F.lit(False)
    )
    return records.withColumns(
        {
            "primary_category_id": F.when(chosen, target).otherwise(F.col("primary_category_id")),
            "updated_at": F.when(chosen, _time(changed_at)).otherwise(F.col("updated_at")),
        }
    )


def merge_categories(
    records: DataFrame,
    categories: DataFrame,
    corpus_id: str,
    source_category_id: str,
    target_category_id: str,
    *,
    note: str = "",
    changed_at: datetime | None = None,
) -> Governed:
    """Move the records of one category to another and drop the first."""
    if source_category_id == target_category_id:
        raise ValueError("A category cannot be merged into itself.")
    source = _category(categories, source_category_id, "Source category")
    target = _category(categories, target_category_id, "Target category")
    affected = _guarded_usage(records, corpus_id, source_category_id)
    moved = _move(records, corpus_id, source_category_id, F.lit(target_category_id), changed_at)
    entry = _audit(
        records,
        corpus_id,
        "merge",
        (source_category_id, source["name"]),
        (target_category_id, target["name"]),
        affected,
        note,
        changed_at,
    )
    return Governed(moved, categories.where(F.col("id") != source_category_id), entry)


def delete_category(
    records: DataFrame,
    categories: DataFrame,
    corpus_id: str,
    category_id: str,
    *,
    replacement_category_id: str | None = None,
    note: str = "",
    changed_at: datetime | None = None,
) -> Governed:
    """Drop a category; its records go to a replacement or become uncategorised."""
    if replacement_category_id == category_id:
        raise ValueError("A deleted category cannot replace itself.")
    category = _category(categories, category_id, "Category")
    target_name = None
    if replacement_category_id is not None:
        target_name = _category(categories, replacement_category_id, "Replacement category")["name"]
    affected = _guarded_usage(records, corpus_id, category_id)
    moved = _move(
        records, corpus_id, category_id, F.lit(replacement_category_id).cast("string"), changed_at
    )
    action = "delete_to_uncategorized" if replacement_category_id is None else "delete_to_category"
    entry = _audit(
        records,
        corpus_id,
        action,
        (category_id, category["name"]),
        (replacement_category_id, target_name),
        affected,
        note,
        changed_at,
    )
    return Governed(moved, categories.where(F.col("id") != category_id), entry)


def audit_log(audit: DataFrame, corpus_id: str, *, limit: int = AUDIT_LIMIT) -> DataFrame:
    """The newest entries of a corpus first."""
    own = audit.where(F.col("corpus_id") == corpus_id)
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
