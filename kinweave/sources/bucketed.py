"""Dictionaries stored in hash buckets of their key, so that lookups do not shuffle them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store ``df`` under ``path`` in ``buckets`` sorted files by ``key``, as ``table`` of the catalog.

    The rows are dealt out by the buckets' own hash first, so each bucket is one file.
    Fails when the table exists. A bucket should fit a task: choose their number by size.
    """
    (
        df.repartition(buckets, key)
        .write.format("parquet")
        .bucketBy(buckets, key)
        .sortBy(key)
        .option("path", path)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def open_bucketed(
    spark: SparkSession, table: str, path: str, schema: str, key: str, buckets: int
) -> DataFrame:
    """A stored dictionary in the catalog of another session; ``schema`` as DDL text."""
    location = path.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {table} ({schema}) USING parquet "
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return spark.table(table)


def bucketed_lookup(df: DataFrame, dictionary: DataFrame, key: str) -> DataFrame:
    """Left join with a bucketed dictionary that holds each key once.

    Only ``df`` is dealt out, to the dictionary's buckets, which are read where they lie. The
    hint keeps Spark from shuffling or broadcasting the dictionary instead.
    """
    return df.join(dictionary.hint("merge"), key, "left")
