"""Mixing sources to target weights by Poisson replication.

Every document gets a uniform number from a hash of the seed and its id, the inverse of the
Poisson distribution turns it into a number of copies whose mean is the source's repetition
rate, and the copies are shuffled globally. Draws depend on the row alone, so a task that runs
again makes the same copies, and no source is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.plans.joins import fits_broadcast

SEED = 20
# A Poisson draw of a mean up to this is inverted in one go; larger means are split evenly
# into draws of their own, whose sum has the same distribution, so exp(-mean) stays exact.
MAX_MEAN = 16.0
# P(X > 96) for a mean of 16 is below 1e-43, far below the 2 ** -52 steps of the uniform.
MAX_DRAW = 96
_SALTS = 64


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def inverse_poisson(u: Column, mean: Column) -> Column:
    """The smallest k whose Poisson probability of at most k exceeds ``u``; mean at most 16."""
    start = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("below"), F.lit(0).alias("count")
    )

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(
            p.alias("p"),
            (state["below"] + p).alias("below"),
            (state["count"] + F.when(u >= state["below"], 1).otherwise(0)).alias("count"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_DRAW)), start, step, lambda s: s["count"])


def copies(seed: Column, key: Column, mean: Column) -> Column:
    """Hash-seeded Poisson number of copies; null or negative means give none."""
    parts = F.greatest(F.ceil(mean / F.lit(MAX_MEAN)), F.lit(1)).cast("int")
    draws = F.transform(
        F.sequence(F.lit(1), parts),
        lambda i: inverse_poisson(uniform(seed, key, i), mean / parts),
    )
    total = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    return F.when(mean > 0, total).otherwise(F.lit(0))


def repetition_rates(docs: DataFrame, weights: DataFrame, source: str, total: float | None) -> DataFrame:
    """``(source, rate)``: target rows of a source over the rows it has.

    Weights need not sum to one; negative and null ones count as 0, and several rows of one
    source add up. ``total`` is the wanted number of rows, by default as many as come in.
    """
    have = docs.groupBy(source).agg(F.count(F.lit(1)).alias("__n"))
    share = F.greatest(F.coalesce(F.col("weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    want = weights.select(F.col(source).alias("__s"), share.alias("__w")).groupBy("__s").agg(
        F.sum("__w").alias("__w")
    )
    known = have.join(want, F.col(source).eqNullSafe(F.col("__s"))).select(source, "__n", "__w")
    sums = known.agg(F.sum("__w").alias("__all_w"), F.sum("__n").alias("__all_n"))
    goal = F.col("__all_n").cast("double") if total is None else F.lit(float(total))
    # One row, so the join repeats a constant.
    return known.join(F.broadcast(sums)).select(
        source, (goal * F.col("__w") / F.col("__all_w") / F.col("__n")).alias("rate")
    )


def with_rates(docs: DataFrame, rates: DataFrame, source: str) -> DataFrame:
    """Add ``__rate``; a source without a rate gets 0.

    Few sources are broadcast, after a look at their size. Otherwise both sides are
    shuffled on the source and a salt, so that a hot source is spread over many tasks.
    """
    named = rates.select(F.col(source).alias("__s"), F.col("rate").alias("__rate"))
    same = F.col(source).eqNullSafe(F.col("__s"))
    if fits_broadcast(named):
        joined = docs.join(F.broadcast(named), same, "left")
    else:
        salted = named.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        draw = F.pmod(F.xxhash64(*docs.columns), F.lit(_SALTS)).cast("int")
        joined = (
            docs.withColumn("__draw", draw)
            .join(salted, same & (F.col("__draw") == F.col("__salt")), "left")
            .drop("__draw", "__salt")
        )
    return joined.drop("__s").withColumn("__rate", F.coalesce("__rate", F.lit(0.0)))


def mix(
    docs: DataFrame,
    weights: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    seed: int = SEED,
    total: float | None = None,
    shuffle: bool = True,
) -> DataFrame:
    """Copies of the rows so that the sources come in the ratio of ``weights``.

    Adds ``copy`` (1, 2, ...) and ``order_key``, a number in [0, 1) from a hash of seed, key
    and copy: the rows come back dealt out and sorted by hash, and sorting by it gives one
    global order. Columns of these names in ``docs`` are replaced. A source that no
    weight names gets no copies. Rows that share a key share their draw. A null source may
    have a weight of its own. Without rows the result is empty.
    """
    rates = repetition_rates(docs, weights, source, total)
    drawn = with_rates(docs.drop("copy", "order_key"), rates, source).withColumn(
        "__copies", copies(F.lit(seed), F.col(key), F.col("__rate"))
    )
    out = drawn.where("__copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))
    )
    out = out.drop("__copies", "__rate").withColumn(
        "order_key", uniform(F.lit(seed), F.lit("order"), F.col(key), F.col("copy"))
    )
    if not shuffle:
        return out
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.repartition(partitions, "order_key").sortWithinPartitions("order_key", key)


def root_weights(docs: DataFrame, source: str = "source") -> DataFrame:
    """Weights that soften the imbalance of sources: the square root of their rows."""
    return docs.groupBy(source).agg(F.sqrt(F.count(F.lit(1)).cast("double")).alias("weight"))
