"""Ordered results that go on from what was stored, without reading history again.

Streaks are kept as runs per block of days, which merge over blocks; totals and sessions are kept
as a carry of one row per key, which the next batch of rows starts from.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.windows import day_streaks, gap_sessions, running_total
from kinweave.plans.joins import lookup_join
from kinweave.plans.slices import ROWS_PER_SLICE
from kinweave.plans.storage import materialize

# Streaks


def merge_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of days ``(keys, days, first_day, last_day)`` joined where they touch or overlap.

    ``runs`` is the union of any runs of the same keys. Merging is associative and merging
    a run twice changes nothing, so blocks may be merged in any grouping and delivered
    again. A key has as many rows as it has runs, however many rows are behind them.
    """
    keys = list(keys)
    in_order = Window.partitionBy(*keys).orderBy("first_day", "last_day")
    reach = F.max("last_day").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("first_day") <= F.date_add(reach, 1), F.lit(0)).otherwise(F.lit(1))
    numbered = runs.select(*keys, "first_day", "last_day", opens.alias("__opens")).withColumn(
        "__run", F.sum("__opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = numbered.groupBy(*keys, "__run").agg(
        F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day")
    )
    return merged.select(*keys, _days().alias("days"), "first_day", "last_day")


def _days() -> Column:
    return (F.datediff("last_day", "first_day") + F.lit(1)).cast("bigint")


def streak_summary(runs: DataFrame, keys: Sequence[str], first: Column, last: Column) -> DataFrame:
    """One row per key on a block from day ``first`` to day ``last``: what a merge has to know.

    ``n_days`` (active days), ``prefix`` (days of the run that begins the block, 0 if none
    does), ``suffix`` (of the one that ends it), ``longest``, and the block itself. ``runs``
    are those of the block alone.
    """
    block = runs.where((F.col("last_day") >= first) & (F.col("first_day") <= last))
    return block.groupBy(*keys).agg(
        F.min(first).alias("block_first"),
        F.max(last).alias("block_last"),
        F.sum("days").alias("n_days"),
        F.max(F.when(F.col("first_day") == first, F.col("days")).otherwise(0)).alias("prefix"),
        F.max(F.when(F.col("last_day") == last, F.col("days")).otherwise(0)).alias("suffix"),
        F.max("days").alias("longest"),
    )


_SUMMARY = ("block_first", "block_last", "n_days", "prefix", "suffix", "longest")


def _joined(a: Column, b: Column) -> Column:
    """The summary of two blocks, the first one before the second one; associative.

    Days between the blocks count as days without activity.
    """
    touch = F.date_add(a["block_last"], 1) == b["block_first"]
    across = F.when(touch, a["suffix"] + b["prefix"]).otherwise(F.lit(0).cast("bigint"))

    def whole(s: Column) -> Column:
        return s["n_days"] == F.datediff(s["block_last"], s["block_first"]) + F.lit(1)

    return F.struct(
        a["block_first"].alias("block_first"),
        b["block_last"].alias("block_last"),
        (a["n_days"] + b["n_days"]).alias("n_days"),
        F.when(whole(a) & touch, across).otherwise(a["prefix"]).alias("prefix"),
        F.when(whole(b) & touch, across).otherwise(b["suffix"]).alias("suffix"),
        F.greatest(a["longest"], b["longest"], across).alias("longest"),
    )


def merge_summaries(summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summaries of blocks that do not overlap, as one per key; a key has one row per block."""
    ordered = summaries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_SUMMARY))).alias("__all"))
    folded = F.aggregate(F.slice("__all", F.lit(2), F.size("__all")), F.get("__all", F.lit(0)), _joined)
    return ordered.select(*keys, folded.alias("__s")).select(*keys, *[F.col(f"__s.{c}").alias(c) for c in _SUMMARY])


def block_runs(df: DataFrame, keys: Sequence[str], day: str, first: Column, last: Column) -> DataFrame:
    """Runs of the days from ``first`` to ``last`` alone: the rows of one block, read once."""
    date = F.to_date(day)
    return day_streaks(df.where((date >= first) & (date <= last)), keys, day)


# Totals and sessions


class Resumed(NamedTuple):
    """The result of a batch, and the carry that the next batch starts from; both are stored."""

    rows: DataFrame
    carry: DataFrame


def _by_key(df: DataFrame, carry: DataFrame | None, keys: list[str]) -> DataFrame:
    """The rows with their key's carried columns in the struct ``__carry``; null keys match."""
    if carry is None:
        return df.withColumn("__carry", F.lit(None).cast("struct<none:int>"))
    # A text of the key finds null keys too, which equality does not.
    name = F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("")
    state = carry.select(
        name.alias("__key"), F.struct(*[F.col(c) for c in carry.columns if c not in keys]).alias("__carry")
    )
    return lookup_join(df.withColumn("__key", name), state, ["__key"]).drop("__key")


def _checked(df: DataFrame, order: Sequence[str], late: Column) -> DataFrame:
    """The rows, the job failing where ``late`` is true: such rows belong before the carry."""
    row = F.concat_ws(", ", *[F.col(c).cast("string") for c in order])
    failed = F.raise_error(F.concat(F.lit("a late row, from before the carry: "), row)).cast("boolean")
    return df.where(F.when(late, failed).otherwise(F.lit(True)))


def resume_running_total(
    df: DataFrame, carry: DataFrame | None, value: str, order: Sequence[str], keys: Sequence[str] = (),
    name: str = "running_total", rows_per_slice: int = ROWS_PER_SLICE,
) -> Resumed:
    """``running_total`` of a batch, going on from the carry of the batches before.

    Start with None. Every row must come behind its key's last row in ``order``; an earlier or
    equal one fails the job. The carry has one row per key: ``total`` and the order of its
    last row. Only the batch and the carry are read.
    """
    keys, order = list(keys), list(order)
    started = _by_key(df, carry, keys)
    if carry is not None:
        late = F.coalesce(F.struct(*order) <= F.col("__carry.last"), F.lit(False))
        started = _checked(started, order, late)
        base = F.col("__carry.total")
    else:
        base = F.lit(None).cast("bigint")
    batch = materialize(started.withColumn("__base", base).drop("__carry"), "batch")
    totals = running_total(batch, value, order, keys, name, rows_per_slice)
    summed = F.when(
        F.col(name).isNotNull() | F.col("__base").isNotNull(),
        F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col("__base"), F.lit(0)),
    )
    rows = materialize(totals.withColumn(name, summed).drop("__base"), "running_total")
    fresh = batch.groupBy(*keys).agg(
        F.when(
            F.sum(value).isNotNull() | F.max("__base").isNotNull(),
            F.coalesce(F.sum(value), F.lit(0)) + F.coalesce(F.max("__base"), F.lit(0)),
        ).alias("total"),
        F.max(F.struct(*order)).alias("last"),
    )
    if not keys:
        fresh = fresh.where(F.col("last").isNotNull())
    return Resumed(rows, materialize(_updated(carry, fresh, keys), "carry"))


def _updated(carry: DataFrame | None, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The fresh carry, and the old one of keys that the batch does not have."""
    if carry is None:
        return fresh
    both = fresh.withColumn("__new", F.lit(1)).unionByName(carry.withColumn("__new", F.lit(0)))
    columns = [c for c in fresh.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), "__new").alias("__state"))
    return latest.where(F.col("__state").isNotNull()).select(*keys, *[F.col(f"__state.{c}").alias(c) for c in columns])


def resume_gap_sessions(
    df: DataFrame, carry: DataFrame | None, keys: Sequence[str], start: str, end: str,
    order: Sequence[str], sums: Sequence[str] = (), seconds: int = 600,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> Resumed:
    """``gap_sessions`` of a batch, the last session of every key going on if the gap allows.

    Gives the sessions that the batch has rows of, under the numbers of one run over all
    batches; one that began before comes again in its new extent and replaces its row. The
    carry has one row per key: its last session, the end of its last row and that row's
    order. Late rows fail as in ``resume_running_total``.
    """
    keys, order, sums = list(keys), list(order), list(sums)
    columns = ["session_no", "session_start", "session_end", "n_rows", *sums]
    started = df
    if carry is not None:
        late = F.coalesce(F.struct(*order) <= F.col("__carry.last"), F.lit(False))
        started = _checked(_by_key(df, carry, keys), order, late).drop("__carry")
    batch = materialize(started, "batch")
    sessions = materialize(gap_sessions(batch, keys, start, end, order, sums, seconds, rows_per_slice), "sessions")
    ends = batch.groupBy(*keys).agg(
        F.min_by(start, F.struct(*order)).alias("__first_start"),
        F.max_by(end, F.struct(*order)).alias("last_end"),
        F.max(F.struct(*order)).alias("last"),
    )
    if carry is not None:
        gap = F.make_dt_interval(secs=F.lit(seconds))
        goes_on = F.coalesce(F.col("__first_start") - F.col("__carry.last_end") <= gap, F.lit(False))
        bases = (
            _by_key(ends, carry, keys)
            .where(F.col("__carry").isNotNull())
            .select(
                *keys,
                F.col("__carry.session_no").alias("__before"),
                F.when(goes_on, F.col("__carry")).alias("__open"),
            )
        )
        opened = _by_key(sessions, materialize(bases, "bases"), keys)
        first = (F.col("session_no") == 1) & F.col("__carry.__open").isNotNull()
        merged = {
            "session_start": F.least("session_start", F.col("__carry.__open.session_start")),
            "session_end": F.greatest("session_end", F.col("__carry.__open.session_end")),
            **{c: F.coalesce(F.col(c) + F.col(f"__carry.__open.{c}"), c, F.col(f"__carry.__open.{c}")) for c in ["n_rows", *sums]},
        }
        shift = F.coalesce(F.col("__carry.__before"), F.lit(0)) - F.when(
            F.col("__carry.__open").isNotNull(), F.lit(1)
        ).otherwise(F.lit(0))
        sessions = materialize(
            opened.select(
                *keys,
                (F.col("session_no") + shift).alias("session_no"),
                *[F.when(first, e).otherwise(F.col(c)).alias(c) for c, e in merged.items()],
            ),
            "sessions",
        )
    last = sessions.groupBy(*keys).agg(F.max_by(F.struct(*columns), "session_no").alias("__s"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}"))
    fresh = last.alias("s").join(ends.alias("e"), same).select(
        *[F.col(f"s.{k}").alias(k) for k in keys],
        *[F.col(f"s.__s.{c}").alias(c) for c in columns],
        "e.last_end", "e.last",
    )
    return Resumed(sessions, materialize(_updated(carry, fresh, keys), "carry"))
