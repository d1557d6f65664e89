"""Importance resampling: documents drawn so that their n-grams look like those of a target.

Every n-gram is hashed by CRC-32 into a bucket. One scan of a text, its words set apart by one
space, stores the running CRC at the end of each word; the CRC of any n-gram then follows from
the two prefixes at its ends, since the bytes before it only add a term that is the earlier
CRC shifted over the n-gram's length in GF(2). Bucket counts of the corpus and of the target
give each bucket a gain, a document's gains add up to its weight, and Gumbel noise from a hash
of its id turns the highest scores into a draw without replacement.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.text import plain_words
from kinweave.plans.slices import SLICE, TIE, slice_rows
from kinweave.plans.storage import materialize

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
MIN_WORDS = 20
# Lengths with a shift table of their own; longer n-grams are shifted in powers of two of it.
_LENGTHS = 256
# Characters of a text whose words are held at a time.
_PIECE = 1 << 22
# Rows that may be ordered in one task when the drawn documents are numbered.
_RANKED_PER_TASK = 20_000
# The draw's lowest score is first guessed by a quantile this far below it.
_MARGIN = 0.01


# Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


@cache
def _byte_table() -> np.ndarray:
    """What a CRC register becomes when each value of its lowest byte is shifted out."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, (x >> 1) ^ np.uint32(_POLYNOMIAL), x >> 1).astype(np.uint32)
    return x


@cache
def _shift_tables() -> np.ndarray:
    """[n, k, b]: byte b at place k of a CRC, shifted over n zero bytes."""
    tables = np.empty((_LENGTHS + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(_LENGTHS):
        tables[n + 1] = _byte_table()[tables[n] & 255] ^ (tables[n] >> 8)
    return tables


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map of CRCs, given by what it does to the values of their four bytes."""
    return (
        table[0][crc & 255]
        ^ table[1][(crc >> 8) & 255]
        ^ table[2][(crc >> 16) & 255]
        ^ table[3][crc >> 24]
    )


@cache
def _power(k: int) -> np.ndarray:
    """The map that shifts over _LENGTHS * 2 ** k bytes."""
    if k == 0:
        return _shift_tables()[_LENGTHS]
    half = _power(k - 1)
    return _apply(half, half)


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs shifted over so many zero bytes each, as linear maps over GF(2)."""
    tables, low = _shift_tables(), length % _LENGTHS
    out = tables[low, 0, crc & 255]
    out ^= tables[low, 1, (crc >> 8) & 255]
    out ^= tables[low, 2, (crc >> 16) & 255]
    out ^= tables[low, 3, crc >> 24]
    high, k = length // _LENGTHS, 0
    while high.any():
        odd = np.flatnonzero(high & 1)
        out[odd] = _apply(_power(k), out[odd])
        high, k = high >> 1, k + 1
    return out


def _after_space(crc: np.ndarray) -> np.ndarray:
    """The running CRCs once a space has followed."""
    register = ~crc
    return ~(_byte_table()[(register ^ np.uint32(32)) & 255] ^ (register >> 8))


def ngram_crcs(words: list[bytes], max_n: int = 1, fresh: int = 0) -> list[np.ndarray]:
    """CRC-32 of every run of 1 to ``max_n`` words joined by one space, by length of the run.

    Only runs that end at word ``fresh`` or later count. The words are scanned once; each run
    is derived from the running CRCs before its first and after its last word.
    """
    scan = accumulate(words, lambda c, word: crc32(word, crc32(b" ", c)), initial=0)
    ends = np.fromiter(scan, np.uint32, len(words) + 1)
    starts = _after_space(ends[:-1])
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    places = np.cumsum(sizes + 1)  # where words end in the text with its spaces
    found = []
    for n in range(1, max_n + 1):
        first = np.arange(max(fresh - n + 1, 0), len(words) - n + 1)
        if len(first) == 0:
            found.append(np.empty(0, np.uint32))
            continue
        last = first + n - 1
        length = places[last] - places[first] + sizes[first]
        found.append(ends[last + 1] ^ shifted(starts[first], length))
    return found


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in pieces of bounded size, cut where a word ends."""
    at = 0
    while text and at < len(text):
        end = at + _PIECE
        while end < len(text) and (text[end - 1].isascii() <= text[end - 1].isalnum()):
            end += 1  # inside a word, or between two: go on to the next ASCII separator
        yield plain_words(text[at:end])
        at = end


def text_buckets(text: str | None, max_n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per piece of a text: its number of words and the buckets of the runs that end in it."""
    tail: list[bytes] = []
    for words in _pieces(text):
        both = tail + words
        crcs = np.concatenate(ngram_crcs(both, max_n, len(tail)))
        yield len(words), (crcs % np.uint32(buckets)).astype(np.int64)
        tail = both[len(both) - max_n + 1 :] if max_n > 1 else []


def bucket_counts(df: DataFrame, text: str, max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket.

    Each task adds up its rows before the shuffle and the driver gets ``buckets`` numbers.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                for _, found in text_buckets(value.as_py(), max_n, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    texts = df.where(F.col(text).isNotNull()).select(F.col(text).cast("string"))
    summed = texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():
        counts[bucket] = n
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares of each bucket, rounded down."""
    buckets = len(corpus)
    s_all, t_all = float(corpus.sum() + buckets), float(target.sum() + buckets)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def gumbel(seed: int, doc_id: str) -> int:
    """1000 times a Gumbel draw from the hash of the seed and the id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_ADDED = {"__features": "bigint", "__words": "bigint", "__weight": "bigint", "__score": "bigint"}


def with_scores(
    docs: DataFrame, gains: np.ndarray, text: str = "text", doc_id: str = "doc_id",
    max_n: int = 1, seed: int = SEED,
) -> DataFrame:
    """The rows with ``__features``, ``__words``, ``__weight`` and ``__score``; no shuffle.

    The score of a row without an id is null, since nothing can be drawn for it.
    """
    buckets = len(gains)
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # `buckets` numbers
    # A void column has no Arrow form that comes back; as text it stays null.
    kept = docs.select(
        *[F.col(f"`{f.name}`").cast("string").alias(f.name) if f.dataType == T.NullType() else F.col(f"`{f.name}`")
          for f in docs.schema.fields],
        F.col(doc_id).cast("string").alias("__id"),
        F.col(text).cast("string").alias("__text"),
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            rows = []
            for key, value in zip(batch.column("__id"), batch.column("__text"), strict=True):
                features = words = weight = 0
                for n, found in text_buckets(value.as_py(), max_n, buckets):
                    words, features, weight = words + n, features + len(found), weight + int(gain[found].sum())
                noise = None if (name := key.as_py()) is None else gumbel(seed, name)
                rows.append((features, words, weight, None if noise is None else weight + noise))
            new = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 4
            columns = [*batch.columns[:-2], *new]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], *_ADDED])

    fields = [*kept.schema.fields[:-2], *[T.StructField(n, T.LongType()) for n in _ADDED]]
    return kept.mapInArrow(score, T.StructType(fields))


def _numbered(scored: DataFrame, doc_id: str, percent: int, min_words: int) -> DataFrame:
    """The stored rows with ``__rank``, null where not drawn; only likely rows are sorted."""
    fits = F.coalesce((F.col("__words") >= min_words) & F.col("__score").isNotNull(), F.lit(False))
    share = max(0.0, 1 - percent / 100 - _MARGIN)
    eligible = scored.where(fits)
    n, low = eligible.agg(F.count(F.lit(1)), F.percentile_approx("__score", share, 1000)).first()
    drawn = percent * n // 100
    none = F.lit(None).cast("bigint")
    if drawn == 0:
        return scored.withColumn("__rank", none)
    likely = fits & (F.col("__score") >= low)
    if scored.where(likely).count() < drawn:  # the quantile is an estimate: then all are sorted
        likely = fits
    top = scored.where(likely).withColumn("__order", -F.col("__score"))
    sliced = slice_rows(top, ["__order", doc_id], one_task_rows=_RANKED_PER_TASK)
    rows = sliced.rows.withColumn("__rank", F.row_number().over(sliced.window()).cast("bigint"))
    if sliced.split:
        rows = sliced.with_carry(
            rows, {"__before": F.count(F.lit(1))}, lambda c, earlier: F.sum(c).over(earlier)
        ).withColumn("__rank", F.col("__rank") + F.coalesce("__before", F.lit(0)))
    ranked = rows.drop(SLICE, TIE, "__before", "__order").withColumn(
        "__rank", F.when(F.col("__rank") <= drawn, F.col("__rank"))
    )
    return ranked.unionByName(scored.where(~likely).withColumn("__rank", none))


def _gains(docs: DataFrame, target: DataFrame, text: str, max_n: int, buckets: int) -> np.ndarray:
    return bucket_gains(
        bucket_counts(docs, text, max_n, buckets), bucket_counts(target, text, max_n, buckets)
    )


def importance_ranks(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id",
    max_n: int = 1, buckets: int = BUCKETS, seed: int = SEED,
    percent: int = PERCENT, min_words: int = MIN_WORDS,
) -> DataFrame:
    """Per document: its id, n_features, weight, score and rank in the draw (null if not drawn).

    ``target`` has a column of texts of the same name. Of the N documents with at least
    ``min_words`` words, percent * N // 100 are drawn by the highest scores, ties to the
    smaller id. Null and empty texts have no features and are never drawn. A row without an
    id has no score and is not counted in N. Rows that share an id are documents of their own;
    equal rows get successive ranks. Without targets the gains only favour rare buckets;
    without documents there are no rows. Other columns are not read.
    """
    gains = _gains(docs, target, text, max_n, buckets)
    scored = materialize(
        with_scores(docs.select(doc_id, text), gains, text, doc_id, max_n, seed).drop(text), "importance"
    )
    return _numbered(scored, doc_id, percent, min_words).select(
        doc_id,
        F.col("__features").alias("n_features"),
        F.col("__weight").alias("weight"),
        F.col("__score").alias("score"),
        F.col("__rank").alias("rank"),
    )


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id",
    max_n: int = 1, buckets: int = BUCKETS, seed: int = SEED,
    percent: int = PERCENT, min_words: int = MIN_WORDS,
) -> DataFrame:
    """The drawn documents with all their columns (see ``importance_ranks``).

    The draw's last score and id come as one row, so texts are not shuffled. Rows that equal
    the last drawn one in score and id come along.
    """
    gains = _gains(docs, target, text, max_n, buckets)
    scored = with_scores(docs, gains, text, doc_id, max_n, seed)
    numbers = materialize(scored.select(doc_id, *_ADDED), "importance")
    ranked = _numbered(numbers, doc_id, percent, min_words).where(F.col("__rank").isNotNull())
    last = ranked.agg(F.max_by(F.struct("__score", doc_id), "__rank").alias("last")).first()[0]
    if last is None:
        return docs.limit(0)
    kind = docs.schema[doc_id].dataType
    tied = (F.col("__score") == last[0]) & (F.col(doc_id) <= F.lit(last[1]).cast(kind))
    fits = F.col("__words") >= min_words
    return scored.where(fits & ((F.col("__score") > last[0]) | tied)).drop(*_ADDED)
