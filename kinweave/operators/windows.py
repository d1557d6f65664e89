"""Streaks, running totals, gaps and gap sessions over ordered rows.

All of them stay distributed when one key holds a large part of the rows; see
``kinweave.plans.slices``. Rows tied in an order come in a fixed but arbitrary order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.scalars import within_seconds
from kinweave.plans.slices import ROWS_PER_SLICE, SLICE, TIE, SlicedRows, slice_rows
from kinweave.plans.storage import materialize


def running_total(
    df: DataFrame,
    value: str,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "running_total",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Inclusive running sum row by row (tied rows do not share a sum).

    Without keys the sum runs over the whole table, which is cut into slices of its order.
    """
    sliced = slice_rows(df, order, keys, rows_per_slice)
    frame = sliced.window().rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.rows.withColumn(name, F.sum(value).over(frame))
    if not sliced.split:
        return local
    carried = sliced.with_carry(
        local,
        {"__sum": F.sum(value)},
        lambda column, earlier: F.sum(column).over(earlier),
    )
    zero = F.lit(0)
    total = F.when(
        F.col(name).isNotNull() | F.col("__sum").isNotNull(),
        F.coalesce(F.col(name), zero) + F.coalesce(F.col("__sum"), zero),
    )
    return carried.withColumn(name, total).drop(SLICE, TIE, "__sum")


def row_position(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "position",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """0-based row number along ``order``."""
    ones = df.withColumn("__one", F.lit(1).cast("bigint"))
    numbered = running_total(ones, "__one", order, keys, name, rows_per_slice)
    return numbered.withColumn(name, F.col(name) - 1).drop("__one")


def _with_previous(sliced: SlicedRows, columns: Sequence[str], name: str) -> DataFrame:
    """The sliced rows with a struct of the previous row's columns, null on the first row."""
    row = F.struct(*columns)
    local = sliced.rows.withColumn(name, F.lag(row).over(sliced.window()))
    if not sliced.split:
        return local
    carried = sliced.with_carry(
        local,
        {"__last": F.max_by(row, F.struct(*sliced.order))},
        lambda column, earlier: F.last(column, ignorenulls=True).over(earlier),
    )
    return carried.withColumn(name, F.coalesce(name, "__last")).drop("__last")


def previous_row(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "previous",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add a struct of the previous row's columns; null on the first row of a key."""
    sliced = slice_rows(df, order, keys, rows_per_slice)
    return _with_previous(sliced, columns, name).drop(SLICE, TIE)


def within_gap(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    order: Sequence[str],
    seconds: int = 600,
    name: str = "within_gap",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Flag the rows that start at most ``seconds`` after the previous row of the key ended."""
    rows = previous_row(df, [end], order, keys, "__previous", rows_per_slice)
    return rows.withColumn(name, _continues(start, end, seconds)).drop("__previous")


def _continues(start: str, end: str, seconds: int) -> Column:
    close = within_seconds(F.col(f"__previous.{end}"), F.col(start), seconds)
    return F.coalesce(close, F.lit(False))


def gap_sessions(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    order: Sequence[str],
    sums: Sequence[str] = (),
    seconds: int = 600,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Sessions of intervals: a new one begins when a row starts more than ``seconds`` after
    the previous row of the key ended.

    Gives the keys, ``session_no`` (from 1), ``session_start``, ``session_end`` (the latest
    end), ``n_rows`` and the sum of each column in ``sums``.
    """
    keys = list(keys)
    sliced = slice_rows(df, order, keys, rows_per_slice)
    rows = _with_previous(sliced, [end], "__previous")
    is_new = F.when(_continues(start, end, seconds), F.lit(0)).otherwise(F.lit(1))
    frame = sliced.window().rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("__new", is_new).withColumn(
        "session_no", F.sum("__new").over(frame)
    )
    # Same clustering as the window, so this aggregate needs no further shuffle.
    pieces = numbered.groupBy(*sliced.partition, "session_no").agg(
        F.min(start).alias("session_start"),
        F.max(end).alias("session_end"),
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(c).alias(c) for c in sums],
    )
    if not sliced.split:
        return pieces
    # A session that crosses a slice border comes in pieces; piece number 0 of a slice
    # continues the last session of the slice before.
    pieces = materialize(pieces, "session_pieces")
    carried = sliced.with_carry(
        pieces,
        {"__breaks": F.max("session_no")},
        lambda column, earlier: F.sum(column).over(earlier),
        source=pieces,
    )
    number = F.col("session_no") + F.coalesce(F.col("__breaks"), F.lit(0))
    return (
        carried.withColumn("session_no", number)
        .groupBy(*keys, "session_no")
        .agg(
            F.min("session_start").alias("session_start"),
            F.max("session_end").alias("session_end"),
            F.sum("n_rows").alias("n_rows"),
            *[F.sum(c).alias(c) for c in sums],
        )
    )


def day_streaks(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Runs of consecutive days per key: number of days, first day, last day.

    Repeats of a day are dropped first, with partial aggregation. What is left of even
    the hottest key is one row per calendar day, so its window partition stays small.
    """
    keys = list(keys)
    days = (
        df.where(F.col(day).isNotNull())
        .select(*keys, F.to_date(day).alias("__day"))
        .distinct()
    )
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("__day"))
    return (
        days.withColumn("__island", F.date_sub("__day", index))
        .groupBy(*keys, "__island")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.min("__day").alias("first_day"),
            F.max("__day").alias("last_day"),
        )
        .drop("__island")
    )
