"""Sets of integers in containers that fit their density.

As in ``bitmaps``, a bucket covers 32,768 consecutive integers. A bucket of fewer than
SPARSE_BELOW members is a sorted array of two-byte places, any other one a bitmap of 4 KB, so a
bucket takes at most two bytes a member, plus the few of its array, or 4 KB.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: 2,048 places of two bytes fill the 4 KB of a bitmap.
SPARSE_BELOW = 2_048


def _packed(places: DataFrame, keys: list[str]) -> DataFrame:
    """Containers from distinct rows (keys, bucket, __place), all of a bucket's in one task.

    Both kinds read the one exchange that brings the buckets together. A bucket has at most
    32,768 rows.
    """
    of_bucket = [*keys, "bucket"]
    counted = places.repartition(*of_bucket).withColumn(
        "n", F.count(F.lit(1)).over(Window.partitionBy(*of_bucket)).cast("int")
    )
    sparse = (
        counted.where(F.col("n") < SPARSE_BELOW)
        .groupBy(*of_bucket)
        .agg(F.array_sort(F.collect_list("__place")).alias("places"), F.first("n").alias("n"))
        .withColumn("bitmap", F.lit(None).cast("binary"))
    )
    dense = (
        counted.where(F.col("n") >= SPARSE_BELOW)
        .groupBy(*of_bucket)
        .agg(F.bitmap_construct_agg(F.col("__place").cast("bigint")).alias("bitmap"), F.first("n").alias("n"))
        .withColumn("places", F.lit(None).cast("array<smallint>"))
    )
    columns = [*of_bucket, "n", "places", "bitmap"]
    return sparse.select(*columns).unionByName(dense.select(*columns))


def container_build(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``(keys, bucket, n, places, bitmap)`` of the integers in ``value``; nulls are left out.

    Of ``places`` and ``bitmap`` one is null; ``n`` is the number of members.
    """
    keys = list(keys)
    if not isinstance(df.schema[value].dataType, T.IntegralType):
        raise TypeError(f"{value} must hold whole numbers")
    number = F.col(value).cast("bigint")
    places = df.where(F.col(value).isNotNull()).select(
        *keys,
        F.bitmap_bucket_number(number).alias("bucket"),
        F.bitmap_bit_position(number).cast("smallint").alias("__place"),
    )
    return _packed(places.distinct(), keys)


def container_merge(containers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """OR the containers into those of the coarser ``keys``, across both kinds.

    A bucket with a bitmap in it stays dense: the arrays beside it become bits of one more
    bitmap and all are combined by OR, map-side first. A bucket of arrays alone is put
    together from their distinct places and may become a bitmap. The input is read once per
    kind: give it a stored table.
    """
    keys = list(keys)
    of_bucket = [*keys, "bucket"]
    hot = containers.where(F.col("bitmap").isNotNull()).select(*of_bucket).distinct()
    same = F.lit(True)
    for name in of_bucket:
        same = same & F.col(f"a.{name}").eqNullSafe(F.col(f"h.{name}"))
    arrays = containers.where(F.col("bitmap").isNull()).alias("a")

    def places(how: str) -> DataFrame:
        return (
            arrays.join(hot.alias("h"), same, how)
            .select(*[F.col(f"a.{c}") for c in of_bucket], F.explode("a.places").alias("__place"))
            .distinct()
        )

    beside = (
        places("left_semi")
        .repartition(*of_bucket)
        .groupBy(*of_bucket)
        .agg(F.bitmap_construct_agg(F.col("__place").cast("bigint")).alias("bitmap"))
    )
    bitmaps = containers.where(F.col("bitmap").isNotNull()).select(*of_bucket, "bitmap")
    dense = (
        bitmaps.unionByName(beside)
        .groupBy(*of_bucket)
        .agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        .select(
            *of_bucket,
            F.bitmap_count("bitmap").cast("int").alias("n"),
            F.lit(None).cast("array<smallint>").alias("places"),
            "bitmap",
        )
    )
    return _packed(places("left_anti"), keys).unionByName(dense)


def container_cardinality(containers: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Number of members per key, without opening a container."""
    return containers.groupBy(*keys).agg(F.sum("n").alias(name))


def container_bytes(containers: DataFrame) -> DataFrame:
    """Bytes of the containers' members beside those of one bitmap per bucket."""
    stored = F.coalesce(F.octet_length("bitmap"), F.size("places") * F.lit(2))
    return containers.agg(
        F.coalesce(F.sum(stored), F.lit(0)).alias("stored_bytes"),
        (F.count(F.lit(1)) * F.lit(4096)).alias("plain_bytes"),
    )
