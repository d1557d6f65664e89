"""Distinct counts that can be merged upwards, kept as bitmaps.

Counts of integers are exact. Counts of strings are those of their 32-bit hashes: strings that
collide count once, about one in 86,000 of a hundred thousand, and one in 86 of a hundred million.

A bitmap covers 32,768 consecutive integers, so a set of integers is a group of rows
``(keys, bucket, bitmap)``. Bitmaps of a lower level merge into those of a higher level;
adding up the counts of a lower level would count shared members twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.scalars import java_hash


def bitmap_build(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bitmaps of the integers in ``value`` per key; nulls are left out, other types fail.

    Repeats are dropped by a hash aggregate before any bitmap exists. A map-side bitmap
    aggregate would instead emit up to 4 KB for each single value of a sparse column, and
    a value that fills a third of the rows would fill one task. After that a bucket has
    at most 32,768 rows, so the shuffle on (keys, bucket) is even.
    """
    keys = list(keys)
    if not isinstance(df.schema[value].dataType, T.IntegralType):
        raise TypeError(f"{value} must hold whole numbers")
    distinct = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("bigint").alias("__v")
    ).distinct()
    return (
        distinct.withColumn("bucket", F.bitmap_bucket_number("__v"))
        .repartition(*keys, "bucket")
        .groupBy(*keys, "bucket")
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__v")).alias("bitmap"))
    )


def bitmap_build_strings(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Bitmaps of the 32-bit hashes of strings; colliding strings count once."""
    return bitmap_build(df.select(*keys, java_hash(value).alias("__hash")), keys, "__hash")


def bitmap_merge(bitmaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """OR the bitmaps into those of the coarser ``keys``."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def bitmap_cardinality(bitmaps: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Number of members per key; the buckets of a key are disjoint, so they add up."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).alias(name))
