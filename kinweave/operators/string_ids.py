"""Dense numbers for strings, kept in a dictionary that grows, so that bitmaps of strings are exact.

A string gets a number once and keeps it. New strings are numbered in their sorted order behind
the numbers given out before, slice by slice and without a single sequence. Batches of new
strings are folders of one dictionary: a batch that was written stays as it is when its job runs
again, and one whose job died half way is written anew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.operators.bitmaps import bitmap_build
from kinweave.operators.windows import row_position
from kinweave.plans.joins import lookup_join
from kinweave.plans.slices import ROWS_PER_SLICE
from kinweave.plans.storage import discard, materialize

# The columns of a stored dictionary.
STRING_IDS_SCHEMA = T.StructType(
    [T.StructField("value", T.StringType()), T.StructField("string_id", T.LongType())]
)


def new_string_ids(
    known: DataFrame, values: DataFrame, value: str = "value", rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """``(value, string_id)`` of the strings that ``known`` has not; nulls get no number.

    Ids follow the largest one given out, in the order of the strings, so the same new
    strings always get the same ids. The result is stored.
    """
    strings = values.select(F.col(value).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    fresh = materialize(strings.join(known.select("value"), "value", "left_anti"), "new_strings")
    first = known.agg(F.coalesce(F.max("string_id") + F.lit(1), F.lit(0))).first()[0]
    numbered = row_position(fresh, ["value"], name="string_id", rows_per_slice=rows_per_slice)
    added = materialize(
        numbered.select("value", (F.col("string_id") + F.lit(first)).cast("bigint").alias("string_id")),
        "string_ids",
    )
    discard(fresh)
    return added


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def _batches(spark: SparkSession, path: str) -> list[str]:
    """Folders of the batches whose write was committed."""
    files, folder = _file_system(spark, path)
    if not files.exists(folder):
        return []
    names = [str(s.getPath().getName()) for s in files.listStatus(folder) if s.isDirectory()]
    return [n for n in sorted(names) if files.exists(_file_system(spark, f"{path}/{n}/_SUCCESS")[1])]


def read_string_ids(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary: all committed batches."""
    found = [f"{path}/{n}" for n in _batches(spark, path)]
    reader = spark.read.schema(STRING_IDS_SCHEMA)
    return reader.parquet(*found) if found else spark.createDataFrame([], STRING_IDS_SCHEMA)


def grow_string_ids(
    spark: SparkSession, path: str, batch: str, values: DataFrame, value: str = "value",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add a batch's new strings to the dictionary in ``path``; gives the whole dictionary.

    Batches of one dictionary are written one after another. A batch that is there already is
    left alone, whatever ``values`` holds now.
    """
    if f"batch={batch}" not in _batches(spark, path):
        added = new_string_ids(read_string_ids(spark, path), values, value, rows_per_slice)
        added.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        discard(added)
    return read_string_ids(spark, path)


def bitmap_build_exact(
    df: DataFrame, keys: Sequence[str], value: str, string_ids: DataFrame
) -> DataFrame:
    """Bitmaps of strings by their numbers in a dictionary that holds all of them.

    Repeats go before the lookup. A string without a number fails the job; nulls are left out.
    """
    keys = list(keys)
    pairs = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("string").alias("__value")).distinct()
    ids = string_ids.select(F.col("value").alias("__value"), F.col("string_id").alias("__id"))
    found = lookup_join(pairs, ids, ["__value"])
    missing = F.raise_error(F.concat(F.lit("a string has no number: "), F.col("__value"))).cast("bigint")
    numbered = found.withColumn("__id", F.when(F.col("__id").isNull(), missing).otherwise(F.col("__id")))
    return bitmap_build(numbered, keys, "__id")
