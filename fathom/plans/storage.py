"""Intermediate results that must survive the loss of an executor."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


class _Written(threading.local):
    """Tables a thread has written and not deleted, in order: threads never delete each other's."""

    def __init__(self):
        self.paths: list[str] = []
        _of_threads.append(self.paths)

    def __len__(self) -> int:
        return len(self.paths)

    def __getitem__(self, at):
        return self.paths[at]


_of_threads: list[list[str]] = []
_written = _Written()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_folder(spark)}/fathom-{label}-{uuid.uuid4().hex}"
    _written.paths.append(path)
    return path


def mark() -> int:
    """A place in this thread's list of written tables, for :func:`discard_since`."""
    return len(_written.paths)


def discard_since(spark: SparkSession, place: int, *keep: DataFrame) -> None:
    """Delete the tables this thread wrote since ``place``, but those that ``keep`` was materialised to.

    For tables nothing reads any more: whatever is still lazy over them must be in ``keep``.
    """
    kept = {getattr(df, "_scratch", None) for df in keep}
    gone = [path for path in _written.paths[place:] if path not in kept]
    _written.paths[place:] = [path for path in _written.paths[place:] if path in kept]
    _delete(spark, gone)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Spark deletes them when the driver has collected the plans as garbage, which a large
    heap may put off while the disks of the executors fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete every intermediate table of this process; results not yet collected are lost."""
    for paths in _of_threads:
        gone, paths[:] = list(paths), []
        _delete(spark, gone)


# The JVM compiles no method of more bytes; it would interpret it row by row, some ten times slower.
COMPILED_BYTES = 8000
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_limiting = threading.Lock()
_limited: weakref.WeakKeyDictionary[SparkSession, list] = weakref.WeakKeyDictionary()


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside let Spark cut generated code of wide projections into methods the JVM compiles.

    Spark's own limit lets a method of many columns through that is never compiled. The
    session has its setting again when the last thread leaves.
    """
    with _limiting:
        users = _limited.setdefault(spark, [0, None])
        if users[0] == 0:
            users[1] = spark.conf.get(_METHOD_LIMIT)
            spark.conf.set(_METHOD_LIMIT, str(min(int(users[1]), COMPILED_BYTES)))
        users[0] += 1
    try:
        yield
    finally:
        with _limiting:
            users[0] -= 1
            if users[0] == 0:
                spark.conf.set(_METHOD_LIMIT, users[1])


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later passes read the written columns they need instead of repeating the
    plan, and a lost executor costs a re-read instead of a recomputation.
    """
    path = scratch_path(df.sparkSession, label)
    with compiled_methods(df.sparkSession):
        df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._scratch = path
    return stored


def materialise_measured(
    df: DataFrame, label: str, **measures: Column
) -> tuple[DataFrame, dict[str, int]]:
    """As :func:`materialise`, with aggregates taken while writing; ``rows`` is always there."""
    seen = Observation()
    wanted = {"rows": F.count(F.lit(1)), **measures}
    watched = df.observe(seen, *[value.alias(name) for name, value in wanted.items()])
    stored = materialise(watched, label)
    return stored, seen.get
