"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A window is ``width`` consecutive words of an item, or all words of a shorter item. To lie in a
document whole, it needs every one of its words there, so the prefix of the filter is a single
token: its rarest, by the words' counts over all documents. Documents meet windows on that token
alone; the token's place in the window gives the only place where the window can start, which
must lie inside the document; and the words there are compared one by one. All of it is
DataFrame expressions; documents are shuffled only as far as they have hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.plans.joins import fits_broadcast
from kinweave.plans.storage import materialize

WIDTH = 13
SHARE = 20  # contaminated from one hit word in so many words
# Every ASCII character but digits and letters.
_CUTS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_KEY = ["__a", "__b"]
# Parts into which the rows of each word are dealt where windows are too many to be broadcast.
_SALTS = 16


def plain_tokens(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null gives none.

    ``lower`` does only that to a text of ASCII characters, and quickly.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), _CUTS), "")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(item_id, window)``: the windows of every item, words joined by one space."""
    words = items.select("item_id", plain_tokens(F.col("text").cast("string")).alias("__w"))
    last = F.greatest(F.size("__w") - F.lit(width), F.lit(0))
    starts = F.when(F.size("__w") > 0, F.sequence(F.lit(0), last))
    return (
        words.select("item_id", "__w", F.explode(starts).alias("__i"))
        .select("item_id", F.concat_ws(" ", F.slice("__w", F.col("__i") + 1, width)).alias("window"))
        .distinct()
    )


def _small(df: DataFrame) -> DataFrame:
    """Broadcast when it measures small; otherwise left to a shuffled join."""
    return F.broadcast(df) if fits_broadcast(df) else df


def rarest_tokens(windows: DataFrame, documents: DataFrame) -> DataFrame:
    """``(token, window, place, n)``: each window under its rarest word, at its 1-based place.

    Rarity is the word's count over all documents, ties by the word. A window with a word
    that no document has cannot occur and is left out.
    """
    distinct = windows.select("window").distinct()
    placed = distinct.select(
        "window", F.posexplode(F.split("window", " ")).alias("__p", "token")
    )
    vocabulary = placed.select("token").distinct()
    counts = materialize(
        documents.select(F.explode("__words").alias("token"))
        .join(_small(vocabulary), "token")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("__n")),
        "token_counts",
    )
    ranked = placed.join(_small(counts), "token", "left")
    best = ranked.groupBy("window").agg(
        F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "token", "__p")).alias("m"),
        F.count(F.lit(1)).cast("int").alias("n"),
    )
    return best.where("m.n > 0").select(
        F.col("m.token").alias("token"), "window", (F.col("m.__p") + 1).alias("place"), "n"
    )


def find_windows(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows (key, doc_id, text_hash, n_words, start, n, window), one per occurrence of a window.

    Besides, each document has one row with start 0 and no window. ``documents`` has the
    key, doc_id, text_hash and ``__words``.
    """
    spark = documents.sparkSession
    nothing = spark.createDataFrame([("", None, 0, 0)], "token string, window string, place int, n int")
    prefix = rarest_tokens(windows, documents).unionByName(nothing)
    inside = F.col("window").isNull() | (
        (F.col("start") >= 1) & (F.col("start") + F.col("n") - 1 <= F.col("n_words"))
    )
    whole = F.col("window").isNull() | (
        F.concat_ws(" ", F.slice("__words", F.greatest("start", F.lit(1)), F.col("n")))
        == F.col("window")
    )
    found = [*_KEY, "doc_id", "text_hash", "n_words", "start", "n", "window"]
    # An empty token in front stands for the document itself and shifts places to start at 1.
    tokens = F.posexplode(F.concat(F.array(F.lit("")), "__words")).alias("__at", "token")
    sized = documents.withColumn("n_words", F.size("__words"))
    place = F.when(F.col("window").isNull(), F.lit(0)).otherwise(
        F.col("__at") - F.col("place") + 1
    )
    if fits_broadcast(prefix):
        return (
            sized.select(*_KEY, "doc_id", "text_hash", "n_words", "__words", tokens)
            .join(F.broadcast(prefix), "token")
            .withColumn("start", place)
            .where(inside)
            .where(whole)
            .select(*found)
        )
    # Only places travel in the shuffle on tokens; the words join them where some are left. The
    # documents' own rows need no token, and a word that is frequent all the same is salted.
    own = sized.select(
        *_KEY, "doc_id", "text_hash", "n_words", F.lit(0).alias("start"), F.lit(0).alias("n"),
        F.lit(None).cast("string").alias("window"),
    )
    salts = F.sequence(F.lit(0), F.lit(_SALTS - 1))
    salted = prefix.where("token <> ''").withColumn("__salt", F.explode(salts))
    words_at = F.posexplode("__words").alias("__at", "token")
    candidates = (
        sized.select(*_KEY, "doc_id", "text_hash", "n_words", words_at)
        .withColumn("__salt", F.pmod(F.xxhash64(*_KEY, "__at"), F.lit(_SALTS)).cast("int"))
        .join(salted, ["token", "__salt"])
        .withColumn("start", F.col("__at") - F.col("place") + 2)
        .where(inside)
        .select(*found)
    )
    words = documents.select(*_KEY, "__words").dropDuplicates(_KEY)
    return candidates.join(words, _KEY).where(whole).select(*found).unionByName(own.select(*found))


def decontaminate(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, share: int = SHARE
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, item_ids (array), contaminated, text_hash.

    A word inside any occurrence of a window is hit; contaminated is n_hit > 0 and
    share * n_hit >= n_words. Null texts have no words. Rows that share a doc_id are judged
    each on their own text, repeated rows come back as often. Items without words have no
    windows; an item without an id hits but is not listed.
    """
    text = F.col("text").cast("string")
    documents = docs.select(
        # 128 bits tell rows apart, null ids from others by the leading flag.
        F.xxhash64(F.col("doc_id").isNull(), "doc_id", text).alias("__a"),
        F.xxhash64(F.lit(7), text, F.col("doc_id").isNull(), "doc_id").alias("__b"),
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        plain_tokens(text).alias("__words"),
    )
    windows = materialize(item_windows(items, width), "item_windows")
    hits = materialize(find_windows(documents, windows), "window_hits")

    end = F.col("start") + F.col("n")
    before = Window.partitionBy(*_KEY).orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    counted = (
        hits.select(
            *_KEY,
            "doc_id",
            "text_hash",
            "n_words",
            F.col("window").isNull().cast("bigint").alias("__row"),
            F.greatest(end - F.greatest(F.col("start"), reached), F.lit(0)).alias("__new"),
        )
        .groupBy(*_KEY)
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("text_hash").alias("text_hash"),
            F.max("n_words").cast("bigint").alias("n_words"),
            F.sum("__row").alias("__rows"),
            F.sum("__new").cast("bigint").alias("n_hit"),
        )
    )
    listed = (
        hits.where(F.col("window").isNotNull())
        .select(*_KEY, "window")
        .distinct()
        .join(_small(windows), "window")
        .groupBy(*_KEY)
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    judged = counted.join(listed, _KEY, "left").withColumn(
        "item_ids", F.coalesce("item_ids", F.array().cast("array<string>"))
    )
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    return judged.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__rows"))).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        "item_ids",
        bad.alias("contaminated"),
        "text_hash",
    )
