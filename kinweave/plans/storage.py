"""Tables written to the shared folder of the cluster, to cut lineage or to be reloaded.

The folder is ``spark.checkpoint.dir`` of the session. Lost executors do not lose such
a table, which is why it is used instead of executor-local storage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Tasks of ``small_tasks`` read so many bytes of a shuffle or a file, while there are at most so many.
_SMALL_TASK = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 8 << 20,
    "spark.sql.files.maxPartitionBytes": 16 << 20,
}
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_MOST_TASKS = 2_000

_local_dirs: dict[str, str] = {}
# Paths that this process has given out and nobody has deleted yet.
_live: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="kinweave-")
    return _local_dirs[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in shared storage; ``clear_scratch`` and ``scratch_scope`` delete it too."""
    path = f"{shared_dir(spark)}/kinweave/{label}-{uuid.uuid4().hex}"
    _live.add(path)
    return path


def checkpoint_write(df: DataFrame, path: str) -> None:
    """Save a DataFrame for a later reload; fails when the path exists."""
    df.write.parquet(path)


def checkpoint_read(spark: SparkSession, path: str) -> DataFrame:
    """Reload what ``checkpoint_write`` saved, with the schema stored beside the data."""
    return spark.read.parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Run ``df`` once into shared storage and return the stored table.

    Whoever stores a table discards it when nothing reads it any more. What a returned
    DataFrame still reads is deleted by ``scratch_scope`` or ``clear_scratch``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    checkpoint_write(df, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(conf).delete(target, True)
    _live.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables that ``materialize`` returned."""
    for df in tables:
        path = df.__dict__.get("_stored_at")
        if path in _live:
            _delete(df.sparkSession, path)


@contextmanager
def keeping_only(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete on leaving what was stored inside, but for the tables put into the list."""
    before, kept = set(_live), []
    try:
        yield kept
    finally:
        wanted = {df.__dict__.get("_stored_at") for df in kept}
        for path in _live - before - wanted:
            _delete(spark, path)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the queries run inside."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def dropping_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Every query run inside deletes its shuffle files when it ends, not when its plan is collected."""
    return _settings(spark, {_SHUFFLE_CLEANUP: "true"})


def small_tasks(spark: SparkSession) -> AbstractContextManager[None]:
    """Tasks of the queries run inside read so little that an aggregate that combines nothing stays small.

    Their number grows with the rows instead. Smaller settings of the session stay as they are.
    """
    def number(name: str) -> int:  # bytes of a size; Spark itself reads its units
        return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))

    first = spark.conf.get(_INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions")
    sizes = {name: str(min(number(name), size)) for name, size in _SMALL_TASK.items()}
    return _settings(spark, sizes | {_INITIAL: str(max(int(first), _MOST_TASKS))})


def clear_scratch(spark: SparkSession) -> int:
    """Delete every table stored so far; DataFrames that read one can no longer be run."""
    paths = list(_live)
    for path in paths:
        _delete(spark, path)
    return len(paths)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what was stored inside: use the results before that."""
    before = set(_live)
    try:
        yield
    finally:
        for path in _live - before:
            _delete(spark, path)
