"""Bloom filters as rows of bits, to drop rows that an inner lookup would drop after its shuffle.

A key hashes to one row of 64 bits and to a few bits in it. The rows are an aggregate of the
dictionary, far smaller than the dictionary itself; broadcast, they keep most of the big side's
rows without a partner from being shuffled. A row with a partner is never dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.plans.joins import ROWS_PER_TASK, fits_broadcast, shuffled_lookup
from kinweave.plans.storage import materialize

BITS_PER_KEY = 16
BITS_SET = 4
MAX_ROWS = 4_000_000


def _hash(on: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in on], F.lit(101))


def _block(on: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in on], F.lit(202)), F.lit(blocks))


def _mask(on: Sequence[str]) -> Column:
    """The bits of a key: BITS_SET places of six bits each, out of a second hash."""
    mask = F.lit(0).cast("bigint")
    for i in range(BITS_SET):
        place = F.shiftrightunsigned(_hash(on), 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return mask


def bloom_rows(keys: DataFrame, on: Sequence[str], n_keys: int) -> tuple[DataFrame, int]:
    """The filter ``(__block, __bits)`` of the keys, and its number of blocks."""
    blocks = max(1, n_keys * BITS_PER_KEY // 64)
    known = F.lit(True)
    for k in on:
        known = known & F.col(k).isNotNull()
    bits = (
        keys.where(known)
        .select(_block(on, blocks).alias("__block"), _mask(on).alias("__mask"))
        .groupBy("__block")
        .agg(F.bit_or("__mask").alias("__bits"))
    )
    return bits, blocks


def bloom_prune(df: DataFrame, bits: DataFrame, blocks: int, on: Sequence[str]) -> DataFrame:
    """The rows whose key may be in the filter; no shuffle of ``df``."""
    hashed = df.withColumn("__block", _block(on, blocks)).withColumn("__mask", _mask(on))
    found = hashed.join(F.broadcast(bits), "__block")
    return found.where(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask")).drop(
        "__block", "__mask", "__bits"
    )


def pruned_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    max_rows: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner join of ``right``, which holds each key once.

    A small ``right`` is broadcast. Beyond that its filter is, as long as that measures small,
    and only what may match is shuffled; beyond that all rows are. Hot keys are spread as in
    ``shuffled_lookup``.
    """
    on = list(on)
    if fits_broadcast(right) if max_rows is None else fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), on)
    n_keys = right.count()
    likely = left
    if n_keys * BITS_PER_KEY // 64 <= MAX_ROWS:
        bits, blocks = bloom_rows(right, on, n_keys)
        likely = bloom_prune(left, materialize(bits, "bloom"), blocks, on)
    marked = right.withColumn("__found", F.lit(True))
    return shuffled_lookup(likely, marked, on, rows_per_task=rows_per_task).where("__found").drop("__found")
