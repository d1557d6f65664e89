"""Support pruning: identifiers that no frequent edge can have go before pairs are made.

An edge is seen at most as often as either of its ends, so an end that is rare rules the edge
out. Counts of identifiers are kept in a count-min sketch: a few rows of counters of fixed width.
A counter is at least the count of every identifier in it, so an identifier may stay by mistake
but never goes by mistake, and the exact counts of the pairs that are left decide.

A sketch of fixed width fills up when there are more identifiers than counters, and then prunes
nothing. Above that number identifiers are counted by their 64-bit hashes instead, in a shuffle of
numbers, and so are the pairs that are left; what is frequent goes into a broadcast filter. Its errors
are on the same side.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.scalars import wide_key
from kinweave.operators.graph import MAX_IDS_PER_ROW, _keys, _pairs, frequent_edges
from kinweave.plans.storage import dropping_shuffles, keeping_only, materialize

SKETCH_ROWS = 4
# Counters per row. What passes through the driver is one bit per counter.
SKETCH_WIDTH = 1 << 20
_BITS = 63

# The broadcast filter: words of 64 bits, eight to a row. It takes 8 bits per hash up to 67 million
# hashes (some 140 MB in memory); with more of them it stays as large and keeps more by mistake.
_WORDS_PER_ROW = 8
_BITS_PER_HASH = 8
_BITS_SET = 3
MAX_FILTER_ROWS = 1 << 20


class HeavyFilter(NamedTuple):
    """Rows ``(__row, __words)`` of a filter, and its number of words."""

    rows: DataFrame
    words: int


def _cell(key: Column, row: Column | int, width: int) -> Column:
    """The counter of a key in a row of the sketch."""
    row = F.lit(row) if isinstance(row, int) else row
    return F.pmod(F.xxhash64(key, row), F.lit(width)).cast("int")


def _weighted_keys(hashed: DataFrame) -> DataFrame:
    """Rows ``(w, k)``: how often pairs of one row with another given key can name key ``k``."""
    weight = F.size("__keys") - F.size(F.array_distinct("__keys")) + F.lit(1)
    return hashed.select(weight.alias("w"), F.explode("__keys").alias("k"))


def frequent_cells(
    hashed: DataFrame, more_than: int, rows: int = SKETCH_ROWS, width: int = SKETCH_WIDTH
) -> list[Column]:
    """Per sketch row, its counters above ``more_than`` as bits of a constant array.

    Each key counts as often as pairs of one row with another given key can name it: once,
    or more often where keys of the row repeat.
    """
    keys = _weighted_keys(hashed)
    cells = F.array(*[F.struct(F.lit(r).alias("r"), _cell(F.col("k"), r, width).alias("c")) for r in range(rows)])
    heavy = (
        keys.select("w", F.inline(cells))
        .groupBy("r", "c")
        .agg(F.sum("w").alias("n"))
        .where(F.col("n") > more_than)
        .select("r", (F.col("c") / _BITS).cast("int").alias("at"), F.pmod("c", F.lit(_BITS)).alias("bit"))
        .groupBy("r", "at")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))).alias("bits"))
    )
    words = [[0] * (width // _BITS + 1) for _ in range(rows)]
    for r, at, bits in heavy.collect():  # at most rows * width / 63 numbers
        words[r][at] = bits
    return [
        F.from_json(F.lit(str(w)), "array<bigint>")  # a constant of the plan, folded once
        for w in words
    ]


def keep_frequent(hashed: DataFrame, sketch: list[Column], width: int = SKETCH_WIDTH) -> DataFrame:
    """The arrays without the keys of which one counter is too low."""

    def may_pass(key: Column) -> Column:
        passes = F.lit(True)
        for r, words in enumerate(sketch):
            cell = _cell(key, r, width)
            word = F.get(words, (cell / _BITS).cast("int"))
            shifted = F.call_function("shiftright", word, F.pmod(cell, F.lit(_BITS)))
            passes = passes & (shifted.bitwiseAND(F.lit(1)) == 1)
        return passes

    return hashed.select(F.explode(F.array(F.filter("__keys", may_pass))).alias("__keys"))


def _word(hash_: Column, words: int) -> Column:
    return F.pmod(hash_, F.lit(words).cast("bigint"))


def _word_bits(hash_: Column) -> Column:
    """The bits of a hash in its word."""
    places, bits = F.xxhash64(hash_, F.lit(101)), F.lit(0).cast("bigint")
    for i in range(_BITS_SET):
        place = F.shiftrightunsigned(places, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return bits


def heavy_filter(hashes: DataFrame, more_than: int, max_rows: int = MAX_FILTER_ROWS) -> HeavyFilter:
    """Filter of the hashes ``h`` whose weights ``w`` add up to more than ``more_than``; stored.

    Hashes are counted exactly, whatever their number, so a heavy one is never missing.
    """
    sums = hashes.groupBy("h").agg(F.sum("w").alias("n"))
    heavy = materialize(sums.where(F.col("n") > more_than).select("h"), "heavy")
    words = min(max(1, heavy.count() * _BITS_PER_HASH // 64), max_rows * _WORDS_PER_ROW)
    at = _word(F.col("h"), words)
    placed = heavy.select(
        F.floor(at / _WORDS_PER_ROW).alias("__row"), F.pmod(at, F.lit(_WORDS_PER_ROW)).alias("i"), _word_bits(F.col("h")).alias("b")
    )
    none = F.lit(0).cast("bigint")
    row = [F.coalesce(F.bit_or(F.when(F.col("i") == i, F.col("b"))), none) for i in range(_WORDS_PER_ROW)]
    return HeavyFilter(materialize(placed.groupBy("__row").agg(F.array(*row).alias("__words")), "filter"), words)


def keep_heavy(df: DataFrame, hash_: Column, heavy: HeavyFilter) -> DataFrame:
    """The rows whose hash may be heavy; no shuffle of ``df``."""
    hashed = df.withColumn("__h", hash_)
    at = _word(F.col("__h"), heavy.words)
    found = hashed.withColumn("__row", F.floor(at / _WORDS_PER_ROW)).join(F.broadcast(heavy.rows), "__row")
    bits = _word_bits(F.col("__h"))
    word = F.get("__words", F.pmod(at, F.lit(_WORDS_PER_ROW)).cast("int"))
    return found.where(word.bitwiseAND(bits) == bits).select(df.columns)


def _heavy_pairs(hashed: DataFrame, longest: int, more_than: int) -> DataFrame:
    """The pairs of ``hashed`` that may be frequent, out of the identifiers that may be."""
    keys = heavy_filter(_weighted_keys(hashed).select(F.xxhash64("k").alias("h"), "w"), more_than)
    firsts = hashed.where(F.size("__keys") <= MAX_IDS_PER_ROW).select(F.posexplode("__keys").alias("__i", "src"), "__keys")
    later = F.slice("__keys", F.col("__i") + F.lit(2), F.size("__keys"))
    pairs = keep_heavy(firsts, F.xxhash64("src"), keys).select("src", F.explode(later).alias("dst"))
    pairs = keep_heavy(pairs, F.xxhash64("dst"), keys)
    if longest > MAX_IDS_PER_ROW:  # such rows are put together again, since what is left of one is bounded
        long = hashed.where(F.size("__keys") > MAX_IDS_PER_ROW).select(F.monotonically_increasing_id().alias("__n"), "__keys")
        items = keep_heavy(long.select("__n", F.posexplode("__keys").alias("__i", "k")), F.xxhash64("k"), keys)
        left = items.groupBy("__n").agg(F.sort_array(F.collect_list(F.struct("__i", "k"))).alias("__left"))
        pairs = pairs.unionByName(_pairs(left.select(F.col("__left.k").alias("__keys")), with_self=False))
    pair = F.xxhash64("src", "dst")
    return keep_heavy(pairs, pair, heavy_filter(pairs.select(pair.alias("h"), F.lit(1).alias("w")), more_than))


def frequent_pairs(
    df: DataFrame,
    ids: str = "ids",
    key: Callable[[Column], Column] = wide_key,
    more_than: int = 2,
    rows: int = SKETCH_ROWS,
    width: int = SKETCH_WIDTH,
) -> DataFrame:
    """The rows of ``frequent_edges(pair_edges(df))``, with rare identifiers pruned first.

    The keys are stored for the call. Up to ``width`` identifiers one pass over them fills the
    sketch and a second one makes pairs of what is left. Beyond that identifiers and then pairs are
    counted by their hashes, and only pairs that may be frequent are shuffled as such. A row may hold
    more than MAX_IDS_PER_ROW identifiers as long as no more than that are left. The result is
    stored. It pays where most identifiers are rare.
    """
    with keeping_only(df.sparkSession) as kept, dropping_shuffles(df.sparkSession):
        hashed = materialize(_keys(df, ids, key), "keys")
        size = F.size("__keys")
        n_ids, longest = hashed.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
        if n_ids <= width:
            sketch = frequent_cells(hashed, more_than, rows, width)
            pairs = _pairs(keep_frequent(hashed, sketch, width), with_self=False)
        else:
            pairs = _heavy_pairs(hashed, longest, more_than)
        kept.append(materialize(frequent_edges(pairs, more_than), "edges"))
    return kept[0]
