"""Filters, unions and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scalars import tokens


def explode_items(df: DataFrame, items: Column | str, name: str, *others: str) -> DataFrame:
    """A row per item of the arrays, beside the columns ``others``.

    Spark infers a filter on the size of an exploded array, which would make every array again
    below the explode. The arrays leave an explode of one item each, and no filter is pushed through it.
    """
    whole = df.select(*others, F.explode(F.array(items)).alias("__items"))
    return whole.select(*others, F.explode("__items").alias(name))


def word_count(lines: DataFrame, text: str = "value") -> DataFrame:
    """Count of every whitespace token; partial counts are made before the shuffle."""
    words = explode_items(lines, tokens(text), "word")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def sum_by_key(df: DataFrame, key: str, value: str, total: str = "total") -> DataFrame:
    """Total of ``value`` per key."""
    return df.groupBy(key).agg(F.sum(value).alias(total))


def typed_projection(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Select ``{output: (input, type)}``: pick, rename and cast in one projection."""
    return df.select(*[F.col(c).cast(t).alias(name) for name, (c, t) in columns.items()])


def conjunctive_filter(df: DataFrame, *conditions: str) -> DataFrame:
    """Rows that meet all conditions, which reach the scan as pushed filters."""
    for condition in conditions:
        df = df.where(condition)
    return df


def union_logs(*logs: DataFrame) -> DataFrame:
    """Union by column name that keeps duplicates."""
    first, *others = logs
    for other in others:
        first = first.unionByName(other)
    return first


