"""Exact duplicates of texts by combining in three steps that no frequent text can skew.

1. Each task reduces its own rows to one per text.
2. Those winners meet in salted groups: a text's winners are dealt over ``SALTS``
   groups, so no group has more than a share of the tasks' winners.
3. At most ``SALTS`` winners of a text meet and give the row that stays.

Every step groups by the whole text beside its digest, so texts are compared in full;
should two texts ever share a digest, the job stops instead of merging them.

Defined cases: null texts equal the empty text; the smallest doc_id stays and null
counts as larger than any (a group without ids keeps null); rows that repeat a doc_id
and text are one document and share its fate; an empty table gives no rows; extra
columns of any name are ignored here and kept by :func:`drop_copies`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.names import unused
from fathom.plans.storage import materialise

SALTS = 16
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, " ")


def text_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row a distinct normalised text: digest, keep_id, group_size."""
    texts = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("body")).select(
        "doc_id", "body", F.unhex(F.sha2("body", 256)).alias("digest"), (F.spark_partition_id() % salts).alias("salt")
    )
    salted = texts.groupBy("salt", "digest", "body").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    combined = salted.groupBy("digest", "body").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    return combined.groupBy("digest").agg(
        F.min("keep_id").alias("keep_id"),
        F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("Two texts share a digest.")).cast("long"))
        .otherwise(F.sum("group_size"))
        .alias("group_size"),
    )


def mark_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row a row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = materialise(text_groups(docs, salts), "text-groups")
    rows = docs.select("doc_id", F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = materialise(text_groups(docs, salts), "text-groups")
    digest, keep = unused(docs, "digest"), unused(docs, "keep_id")
    kept = groups.select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    same = F.unhex(F.sha2(normalised(F.col("text")), 256)) == F.col(digest)
    return docs.join(kept, same & F.col("doc_id").eqNullSafe(F.col(keep)), "left_semi")
