"""Near duplicates by bottom-k sketches from one hash function.

1. Every text's shingle set gives its size, a digest of its shingles' words and the
   ``SKETCH`` smallest hash values. Equal sets are one node from here on.
2. Inverted lists of the retained values generate overlaps. A pair above the threshold
   shares at least a known number of retained values, so it shares one among each
   side's rarest values; only those lists are used. Common passages are frequent and
   drop out of the lists of all texts that also hold enough of their own.
3. Each list first links its members to its most typical member (a star, linear in the
   list). Lists whose members are then connected are done. Of the others, those of up to
   ``SMALL`` members compare the pairs that are still apart.
4. Members of longer lists are described by how their full sets differ from the set of
   the list's typical member. Two sets near each other differ from it alike, so they
   share an element among the rarest of those differences, at a place that the sizes
   bound; what the group has in common cancels out. Only such pairs are compared, which
   loses no pair and does not list the pairs of a group.
5. The union sketch of a pair estimates its similarity and drops pairs that cannot
   reach the threshold; the exact Jaccard of the full sets, shingles compared word by
   word, decides on all others.
6. Links become components by star contraction.

A pair of sets whose sketches are the sets is generated with certainty; for larger ones
the chance to miss a pair at the threshold is below ``MISS``: it would have to share
under :func:`least_shared` of the retained values.

Defined cases: null and blank texts have the empty set, link with nothing and are their
own component; rows without doc_id take the component of rows with an equal set and
null otherwise; rows that repeat a doc_id share its fate; an empty table gives no rows;
extra columns of any name are ignored here and kept by :func:`drop_near_copies`.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.components import components
from fathom.llm.names import unused
from fathom.llm.shingles import full_sets, shared, shingle_sets
from fathom.plans.storage import discard_since, mark, materialise

SKETCH = 48
MISS = 1e-8
SMALL = 16


def least_shared(percent: int, size: int = SKETCH) -> int:
    """Retained values of the union that a pair at the threshold shares but for ``MISS``."""
    share, below = percent / 100, 0.0
    for count in range(size + 1):
        below += comb(size, count) * share**count * (1 - share) ** (size - count)
        if below > MISS:
            return count
    return size


def sketches(docs: DataFrame, size: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, set_id and sketch of every row."""

    def rows(batches):
        for batch in batches:
            sizes, ids, kept = [], [], []
            for found in full_sets(batch.column(1).to_pylist()):
                sizes.append(len(found))
                ids.append(found.digest)
                kept.append(found.hashes[:size])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(kept, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_id", "sketch"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(rows, "doc_id long, n_shingles long, set_id binary, sketch array<long>")


def _fits(left: Column, right: Column, percent: int) -> Column:
    """Whether two set sizes can reach the threshold."""
    return 100 * F.least(left, right) >= percent * F.greatest(left, right)


def prefix_lists(nodes: DataFrame, percent: int, size: int) -> DataFrame:
    """value, node, n, weight: the retained values that can generate overlaps.

    ``weight`` counts how common the node's retained values are, so the most typical
    member of a group has the largest.
    """
    spread = nodes.select("node", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    frequent = spread.groupBy("value").agg(F.count(F.lit(1)).alias("frequency")).where("frequency > 1")
    common = spread.join(frequent, "value")
    # Sets up to this size have only partners whose sketches are whole, too.
    whole = F.col("n") * 100 <= size * percent
    needed = F.when(whole, F.ceil(F.col("n") * percent / 100)).otherwise(least_shared(percent, size))
    order = "partition by node order by frequency, value"
    ranked = common.select(
        "value",
        "node",
        "n",
        (F.col("kept") - needed + 1).alias("prefix"),
        F.expr(f"row_number() over ({order})").alias("place"),
        (F.col("kept") - F.expr("count(1) over (partition by node)")).alias("own"),
        F.expr("sum(frequency) over (partition by node)").alias("weight"),
    )
    return ranked.where(F.col("own") + F.col("place") <= F.col("prefix")).select("value", "node", "n", "weight")


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int, size: int) -> DataFrame:
    """Pairs whose union sketch can belong to a pair above the threshold."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    least = least_shared(percent, size)

    def keep(batches):
        for batch in batches:
            n_a, n_b = batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist()
            s_a, s_b = batch.column("sketch_a"), batch.column("sketch_b")
            flags = []
            for i in range(batch.num_rows):
                left, right = s_a[i].values.to_numpy(), s_b[i].values.to_numpy()
                if n_a[i] <= size and n_b[i] <= size:
                    both = shared(left, right)
                    flags.append(100 * both >= percent * (len(left) + len(right) - both))
                    continue
                union = np.union1d(left, right)[:size]
                both = np.intersect1d(left, right, assume_unique=True)
                flags.append(shared(both, union) >= least)
            yield batch.select(["a", "b"]).filter(pa.array(flags, pa.bool_()))

    return joined.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold: by hashes first, then word by word."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))

    def keep(batches):
        for batch in batches:
            flags = []
            sets_a = full_sets(batch.column("text_a").to_pylist())
            sets_b = full_sets(batch.column("text_b").to_pylist())
            for one, other in zip(sets_a, sets_b):
                needed = -(-percent * (len(one) + len(other)) // (100 + percent))
                flags.append(shared(one.hashes, other.hashes) >= needed and one.shared(other) >= needed)
            yield batch.select(["a", "b"]).filter(pa.array(flags, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(keep, "a long, b long")


def _differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """centre, node, n, size, value: the elements in which a node's set differs from its centre's."""
    left = texts.select(F.col("node").alias("centre"), F.col("text").alias("text_c"))
    right = texts.select("node", F.col("text").alias("text_n"))

    def rows(batches):
        for batch in batches:
            ids = zip(batch.column("centre").to_pylist(), batch.column("node").to_pylist())
            sets_c = shingle_sets(batch.column("text_c").to_pylist())
            sets_n = shingle_sets(batch.column("text_n").to_pylist())
            columns: list[list] = [[], [], [], [], []]
            for (centre, node), one, other in zip(ids, sets_c, sets_n):
                values = np.setxor1d(one, other, assume_unique=True)
                for column, cell in zip(columns, (centre, node, len(other), len(values))):
                    column.append(np.full(len(values), cell, dtype=np.int64))
                columns[4].append(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns],
                names=["centre", "node", "n", "size", "value"],
            )

    joined = pairs.join(left, "centre").join(right, "node").select("centre", "node", "text_c", "text_n")
    return joined.mapInArrow(rows, "centre long, node long, n long, size long, value long")


def _alike_differences(pairs: DataFrame, texts: DataFrame, component_of: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of one centre whose differences from it can be alike enough.

    Sets of sizes n and m reach the threshold only if they differ in at most
    ``apart`` = (1 - t) / (1 + t) * (n + m) elements. Differences of sizes d and e then
    share at least ``(d + e - apart) / 2``, which is 1 or more unless both nodes are linked
    to the centre, and both have a shared element among their first d (or e) less that
    number plus one, in any common order; here the rarest come first.
    """
    share = (100 - percent) / (100 + percent)
    differing = materialise(_differences(pairs, texts), "differences")
    frequent = differing.groupBy("centre", "value").agg(F.count(F.lit(1)).alias("frequency")).where("frequency > 1")
    order = "partition by centre, node order by frequency, value"
    widest = F.floor(share * (F.col("n") + F.col("n") * 100 / percent) + 1e-9) + 1
    placed = (
        differing.join(frequent, ["centre", "value"])
        .withColumn("rank", F.expr(f"row_number() over ({order})"))
        .withColumn("own", F.col("size") - F.expr("count(1) over (partition by centre, node)"))
        .withColumn("place", F.col("own") + F.col("rank"))
        .where(F.col("place") <= widest)
        .join(component_of, "node")
        .select("centre", "value", "node", "n", "size", "place", "component")
    )
    placed = materialise(placed, "placed-differences")
    one = placed.select("centre", "value", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "size", "place", "component")])
    two = placed.select("centre", "value", *[F.col(c).alias(f"{c}_b") for c in ("node", "n", "size", "place", "component")])
    apart = F.floor(share * (F.col("n_a") + F.col("n_b")) + 1e-9)
    common = F.ceil((F.col("size_a") + F.col("size_b") - apart) / 2)
    return (
        one.join(two, ["centre", "value"])
        .where(
            (F.col("node_a") < F.col("node_b"))
            & (F.col("component_a") != F.col("component_b"))
            & (F.col("place_a") <= F.col("size_a") - common + 1)
            & (F.col("place_b") <= F.col("size_b") - common + 1)
            & _fits(F.col("n_a"), F.col("n_b"), percent)
        )
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    )


def near_links(docs: DataFrame, signatures: DataFrame, percent: int, size: int = SKETCH, small: int = SMALL) -> DataFrame:
    """(node, component) of all linked sets but the least of each component.

    A node is the smallest doc_id with its set.
    """
    nodes = materialise(
        signatures.where(F.col("n_shingles") > 0)
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
        .where(F.col("node").isNotNull())
        .select("node", "n", "sketch"),
        "sets",
    )
    lists = materialise(prefix_lists(nodes, percent, size), "lists")
    known = lists.select("node").distinct()
    texts = materialise(
        docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(known, "node").dropDuplicates(["node"]), "texts"
    )
    centre = F.max_by(F.struct(F.col("node").alias("centre"), F.col("n").alias("centre_n")), F.struct("weight", "node"))
    centres = lists.groupBy("value").agg(centre.alias("c"), F.count(F.lit(1)).alias("members"))
    centres = materialise(centres.where("members > 1").select("value", "c.*", "members"), "centres")

    def stars(of: DataFrame, keep) -> DataFrame:
        pairs = lists.join(of, "value").where((F.col("node") != F.col("centre")) & keep)
        return pairs.select("centre", "node").distinct()

    ordered = [F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")]
    near = stars(centres, _fits(F.col("n"), F.col("centre_n"), percent)).select(*ordered).distinct()
    seen = materialise(_estimated(near, nodes, percent, size), "candidates")
    links = materialise(_verified(seen, texts, percent), "links")

    # Lists that the stars have not joined to one component.
    component_of = materialise(
        known.join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component")),
        "node-components",
    )
    members = lists.join(component_of, "node")
    ends = members.groupBy("value").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    open_lists = materialise(centres.join(ends.where("least <> most").select("value"), "value"), "open-lists")
    rest = members.join(open_lists.where(F.col("members") <= small).select("value"), "value")
    one = rest.select("value", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("of_a"))
    two = rest.select("value", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("of_b"))
    few = one.join(two, "value").where(
        (F.col("a") < F.col("b")) & (F.col("of_a") != F.col("of_b")) & _fits(F.col("n_a"), F.col("n_b"), percent)
    )
    many = _alike_differences(
        stars(open_lists.where(F.col("members") > small), F.lit(True)), texts, component_of, percent
    )
    pairs = few.select("a", "b").unionByName(many).distinct().join(seen, ["a", "b"], "left_anti")
    later = _verified(materialise(_estimated(pairs, nodes, percent, size), "candidates"), texts, percent)
    return components(materialise(links.unionByName(later), "links"))


def near_components(docs: DataFrame, percent: int = 80, size: int = SKETCH, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    place = mark()
    signatures = materialise(sketches(docs, size), "signatures")
    joined = near_links(docs, signatures, percent, size, small)
    sets = signatures.where(F.col("n_shingles") > 0).groupBy("set_id").agg(F.min("doc_id").alias("node"))
    labels = materialise(
        sets.join(joined, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id")), "set-labels"
    )
    discard_since(docs.sparkSession, place, signatures, labels)
    return (
        signatures.select("doc_id", "n_shingles", "set_id")
        .join(labels, "set_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_copies(docs: DataFrame, percent: int = 80, size: int = SKETCH) -> DataFrame:
    """The rows of ``docs`` that stay, one document a component, with all their columns."""
    place, name = mark(), unused(docs, "kept_id")
    kept = materialise(near_components(docs, percent, size).where("kept").select(F.col("doc_id").alias(name)).distinct(), "kept")
    discard_since(docs.sparkSession, place, kept)
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
