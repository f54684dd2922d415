"""Use all cores for small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Below this size per core a scan cannot offer every core a split of its own:
# it is the least a split weighs.
SPLIT_BYTES = 4 * 1024 * 1024


def spread_small(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input over all cores before work that is heavy per row.

    A file with one row group is one task however many cores wait. Inputs with
    enough splits, which is every large one, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if cores > 1 and size <= cores * SPLIT_BYTES else df
