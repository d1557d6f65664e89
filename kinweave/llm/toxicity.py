"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A bounded sample of the labelled documents is dealt into shards. Each shard runs FTRL with
per-coordinate rates and L1, the shards' weights are averaged, and what L1 left is small
enough to broadcast. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kinweave.llm.text import gram_hashes, hashes, mixed, plain_words

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
# The fit reads about SHARDS * DOCS_PER_SHARD labelled documents, however many there are.
SHARDS = 4
DOCS_PER_SHARD = 7000
# Rows that the ids of the sample may have on average; beyond that the fit fails openly.
MAX_ROWS_PER_ID = 4
# A broadcast model holds at most so many weights of 16 bytes; one of more fails.
MAX_WEIGHTS = 200_000
BIAS = 0
# A feature of fewer sample documents of a shard takes no part in the fit.
MIN_DOCS = 6
_BUCKET_BITS = 24


@dataclass(frozen=True)
class Ftrl:
    """Rates and penalties of McMahan et al. 2013, and the passes over a shard."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.1
    epochs: int = 8


def features(text: str | None) -> np.ndarray:
    """Distinct hashes of words, neighbouring pairs, and pairs that skip one or two words.

    The first four bytes of a word count as a word of their own, for its inflected forms.
    """
    words = plain_words(text)
    h = hashes(words)
    parts = [gram_hashes(h, 1), gram_hashes(h, 2), hashes([w[:4] for w in words], 9)]
    for skip in (2, 3):
        if len(h) > skip:
            pair = mixed(h[:-skip] + np.uint64(skip)) * np.uint64(0x9E3779B97F4A7C15)
            parts.append(mixed(pair + h[skip:]))
    return np.unique(np.concatenate(parts))


def fit_shard(texts: list[str | None], labels: np.ndarray, opt: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over one shard: the hashes with a weight, and the weights.

    Positives weigh as much as negatives in sum, at most threefold each.
    """
    # A first pass counts documents per bucket of hashes, an upper bound for each feature, so
    # that the second keeps only what can reach MIN_DOCS and memory stays small.
    shift = np.uint64(64 - _BUCKET_BITS)
    crowd = np.zeros(1 << _BUCKET_BITS, np.uint16 if len(texts) < 1 << 16 else np.uint32)
    for t in texts:
        crowd[features(t) >> shift] += 1
    bags = []
    for t in texts:
        bag = features(t)
        bags.append(bag[crowd[bag >> shift] >= MIN_DOCS])
    del crowd
    seen, counts = np.unique(np.concatenate(bags), return_counts=True)
    seen = np.concatenate([np.array([BIAS], np.uint64), seen[counts >= MIN_DOCS]])
    seen = np.unique(seen)
    rows = []
    for k, bag in enumerate(bags):
        at = np.minimum(np.searchsorted(seen, bag), len(seen) - 1)
        kept = at[seen[at] == bag]
        rows.append(np.unique(np.append(kept, np.searchsorted(seen, np.uint64(BIAS)))))
        bags[k] = None
    positives = max(1, int(labels.sum()))
    boost = min(3.0, max(1.0, (len(labels) - positives) / positives))
    z, n = np.zeros(len(seen)), np.zeros(len(seen))
    bias = int(np.searchsorted(seen, np.uint64(BIAS)))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        l1 = np.where(at == bias, 0.0, opt.l1)
        raw = -(zi - np.sign(zi) * l1) / ((opt.beta + np.sqrt(n[at])) / opt.alpha + opt.l2)
        return np.where(np.abs(zi) <= l1, 0.0, raw)

    for _ in range(opt.epochs):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - y) * (boost if y else 1.0)
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / opt.alpha
            z[at] += g - rate * w
            n[at] += g * g
    w = weights(np.arange(len(seen)))
    kept = w != 0
    return seen[kept], w[kept]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    shards: int = SHARDS,
    docs_per_shard: int = DOCS_PER_SHARD,
    opt: Ftrl = Ftrl(),
) -> tuple[np.ndarray, np.ndarray]:
    """The averaged weights ``(sorted hashes, weights)``, fitted outside the held-out fold.

    ``labels`` has doc_id and toxic. Rows without id or label are left out; of several
    labels of one document the largest counts. Without labels the model is empty. A model of
    more than MAX_WEIGHTS weights fails; none is cut.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("__toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("__toxic").isNotNull() & (fold != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max("__toxic").alias("__toxic"))
    )
    total = known.count()
    if total == 0:
        return np.empty(0, np.uint64), np.empty(0)
    share = min(1.0, shards * docs_per_shard / total)
    shards = max(1, min(shards, -(-total // docs_per_shard)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(1_000_000))
    # About shards * docs_per_shard rows of two numbers, so their size is bounded.
    chosen = known.where(draw < F.lit(int(share * 1_000_000) or 1))
    most = MAX_ROWS_PER_ID * shards * docs_per_shard
    if docs.select("doc_id").join(F.broadcast(chosen), "doc_id").count() > most:
        raise ValueError(f"the sampled ids have more than {most} rows; take a smaller sample")
    shard = F.pmod(F.xxhash64("doc_id", F.lit(43)), F.lit(shards)).cast("int")
    sample = (
        docs.select("doc_id", F.col("text").cast("string").alias("__text"))
        .join(F.broadcast(chosen), "doc_id")
        .select(shard.alias("shard"), "doc_id", "__text", "__toxic")
    )

    def fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "__text"])
        pdf = pdf.sample(frac=1.0, random_state=7)
        at, w = fit_shard(list(pdf["__text"]), pdf["__toxic"].to_numpy(float), opt)
        return pd.DataFrame({"at": at.view(np.int64), "w": w / shards})

    model = (
        sample.groupBy("shard")
        .applyInPandas(fit_group, "at bigint, w double")
        .groupBy("at")
        .agg(F.sum("w").alias("w"))
        .orderBy(F.abs("w").desc(), "at")
        .limit(MAX_WEIGHTS + 1)
        .toPandas()
    )
    if len(model) > MAX_WEIGHTS:
        raise ValueError(
            f"more than {MAX_WEIGHTS} weights differ from zero; raise l1 or take fewer shards"
        )
    at = model["at"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(at)
    return at[order], model["w"].to_numpy(float)[order]


def score_text(text: str | None, at: np.ndarray, w: np.ndarray) -> float:
    """Probability of a toxic text under the weights; 0 where the model is empty."""
    if len(at) == 0:
        return 0.0
    bag = np.append(features(text), np.uint64(BIAS))
    found = np.minimum(np.searchsorted(at, bag), len(at) - 1)
    total = w[found[at[found] == bag]].sum()
    return float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))


def with_scores(docs: DataFrame, labels: DataFrame, column: str = "score", **options) -> DataFrame:
    """The rows as they are, with their toxicity score in ``column``; no shuffle."""
    at, w = fit(docs, labels, **options)
    model = docs.sparkSession.sparkContext.broadcast((at, w))
    # A void column has no Arrow form that comes back; as text it stays null.
    kept = docs.drop(column).select(
        *[F.col(f.name).cast("string") if f.dataType.simpleString() == "void" else f.name
          for f in docs.drop(column).schema.fields]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = model.value
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            scores = pa.array([score_text(t.as_py(), at, w) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, scores], [*batch.schema.names, column]
            )

    return kept.mapInArrow(score, StructType([*kept.schema.fields, StructField(column, DoubleType())]))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options
) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (score >= threshold).

    Null and empty texts are scored by the bias alone. Repeated rows are scored one by
    one; a null id is in no fold, so held_out is false. Without labels all scores are 0.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    return with_scores(docs.select("doc_id", "text"), labels, **options).select(
        "doc_id",
        F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
