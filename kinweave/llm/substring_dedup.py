"""Substring deduplication: windows of words that an earlier document has already.

Texts are cut into overlapping segments around minimizers: a window of WIDTH words belongs to
the segment of the smallest of its GRAM-word hashes, so equal windows end up under one anchor
wherever they stand. Anchors of a single document are dropped. One pass over the others stores
the place and a 128-bit hash of every segment; words are fetched again only for one place of each
different segment, and only under anchors that have several, since under an anchor with one
segment there is no other text to search. Segments are sharded by anchor, with the smallest
document that has them. Every shard builds a compressed FM-index over its segments, streams them
through it by backward search, and reports the stretches that match over the threshold together
with the first document that has them. All work is linear in the words; no shard has to see
another's windows.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.fm_index import FMIndex
from kinweave.llm.text import gram_hashes, hashes, mixed, words_of
from kinweave.operators.windows import row_position
from kinweave.plans.joins import lookup_join, shuffled_lookup
from kinweave.plans.storage import discard, materialize, scratch_path

WIDTH = 13
GRAM = 5
WORDS_PER_SHARD = 1_200_000
# Anchors with more different segments than this are counted window by window instead.
SEGMENTS_PER_ANCHOR = 40_000
_FLUSH_WORDS = 400_000
_PIECE = 1 << 23  # words of a text that are cut at a time, below the 24 bits of a place
_STEP = 16  # windows of a segment are fewer, so a place and their number make one integer


def segments(h: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors, first windows and numbers of windows of the segments of a text's word hashes."""
    found = []
    for begin in range(0, max(len(h) - width + 1, 0), _PIECE):
        part = h[begin : begin + _PIECE + width - 1]
        g = gram_hashes(part, gram)
        key = (g & ~np.uint64(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
        low, reach, wanted = key, 1, width - gram + 1
        while reach < wanted:  # the smallest of `wanted` neighbours, doubling the reach
            step = min(reach, wanted - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        counts = np.diff(np.append(first, len(place)))
        found.append((g[place[first]], first + begin, counts))
    if not found:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, row, salt, repeated) of the documents' anchors, combined before the shuffle.

    Of the documents at hand that share an anchor only one reports it, as repeated, and the
    others are told right here, by rows that a salt keeps apart from that anchor's.
    """
    held: list[tuple[int, np.ndarray]] = []
    words = 0

    def flush() -> pa.RecordBatch:
        anchors = np.concatenate([a for _, a in held])
        rows = np.repeat(np.array([r for r, _ in held], np.int64), [len(a) for _, a in held])
        _, first, at, counts = np.unique(
            anchors, return_index=True, return_inverse=True, return_counts=True
        )
        told = np.ones(len(anchors), bool)
        told[first] = False
        salt = np.where(told, rows | 1, 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchors.view(np.int64)), pa.array(rows), pa.array(salt), pa.array(counts[at] > 1)],
            ["anchor", "row", "salt", "repeated"],
        )

    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
            h = hashes(words_of(text.as_py()))
            anchors = np.unique(segments(h)[0])
            if len(anchors):
                held.append((row, anchors))
            words += len(h)
            if held and words > _FLUSH_WORDS:
                yield flush()
                held, words = [], 0
    if held:
        yield flush()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, anchor) of the repeated anchors in a partition that has all rows of its anchors."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not held:
        return
    anchors, rows, salts, told = (np.concatenate(c) for c in zip(*held, strict=True))
    held.clear()
    open_ = np.flatnonzero(salts == 0)
    order = open_[np.argsort(anchors[open_])]
    same = anchors[order[1:]] == anchors[order[:-1]]
    told[order[1:][same]] = told[order[:-1][same]] = True
    for at in range(0, len(told), 1 << 17):
        part = slice(at, at + (1 << 17))
        columns = [pa.array(c[part][told[part]]) for c in (rows, anchors)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "anchor"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts compressed, so that less of them is shuffled and stored."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [None if (t := x.as_py()) is None else pack.compress(t.encode()) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("row"), pa.array(packed, pa.binary())],
            ["doc", "row", "packed"],
        )


def _words(packed: bytes | None, unpack: zstandard.ZstdDecompressor) -> list[bytes]:
    return unpack.decompress(packed).split() if packed else []


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


# An odd multiplier and its inverse modulo 2 ** 64.
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def span_hashes(h: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of stretches of words, as two BIGINTs, from the hashes of the words.

    Polynomials modulo 2 ** 64 by prefix sums, so each stretch takes constant time.
    """
    up, down = _powers(_BASE, len(h) + 1), _powers(_INVERSE, len(h) + 1)
    out = []
    for words in (h, mixed(h ^ np.uint64(0x2545F4914F6CDD1D))):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)])
        span = (sums[first + size] - sums[first]) * down[first]
        out.append(mixed(span ^ size.astype(np.uint64)).view(np.int64))
    return out[0], out[1]


_PLACES = "x bigint, y bigint, doc bigint, row bigint, first int, n int, anchor bigint"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of documents under their repeated anchors: hash, place and anchor."""
    unpack = zstandard.ZstdDecompressor()
    names = ["x", "y", "doc", "row", "first", "n", "anchor"]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            columns: list[list[np.ndarray]] = [[] for _ in names]
            some = batch.slice(at, 512)
            for doc, row, packed, wanted in zip(*[c.to_pylist() for c in some.columns], strict=True):
                h = hashes(_words(packed, unpack))
                anchors, first, count = segments(h)
                kept = np.flatnonzero(np.isin(anchors.view(np.int64), np.array(wanted, np.int64)))
                first, count = first[kept], count[kept]
                x, y = span_hashes(h, first, count + WIDTH - 1)
                values = (
                    x, y, np.full(len(x), doc), np.full(len(x), row),
                    first.astype(np.int32), count.astype(np.int32), anchors[kept].view(np.int64),
                )
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the segments that a document stands for."""
    unpack = zstandard.ZstdDecompressor()
    names = ["x", "y", "anchor", "lowest", "highest", "content"]
    kinds = [*[pa.int64()] * 5, pa.binary()]
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            rows = []
            for packed, wanted in zip(*[c.to_pylist() for c in batch.slice(at, 512).columns], strict=True):
                words = _words(packed, unpack)
                for s in wanted:
                    content = b" ".join(words[s["first"] : s["first"] + s["n"] + WIDTH - 1])
                    rows.append((s["x"], s["y"], s["anchor"], s["lowest"], s["highest"], content))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """First documents of the windows of a shard's segments, where an earlier one has any."""
    ids: dict[bytes, int] = {}
    sequences = [
        np.fromiter((ids.setdefault(w, len(ids) + 1) for w in c.split()), np.int64) for c in pdf["content"]
    ]
    index = FMIndex(sequences, pdf["lowest"].to_numpy())
    text = np.concatenate(sequences)
    sizes = np.array([len(s) for s in sequences])
    windows = sizes - WIDTH + 1
    offset = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), windows)
    inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    firsts = pdf["lowest"].to_numpy()[owner]
    for at in range(0, len(owner), 1 << 18):
        part = slice(at, at + (1 << 18))
        ends = offset[owner[part]] + inside[part] + WIDTH
        length, low, high = index.matches(text, ends, WIDTH)
        full = length == WIDTH
        firsts[part][full] = index.least_values(low[full], high[full])
    begin = np.cumsum(windows) - windows
    least, latest = np.minimum.reduceat(firsts, begin), np.maximum.reduceat(firsts, begin)
    useful = least < pdf["highest"].to_numpy()
    cuts = [c for c, u in zip(np.split(firsts, begin[1:]), useful, strict=True) if u]
    return pd.DataFrame(
        {
            "x": pdf["x"].to_numpy()[useful],
            "y": pdf["y"].to_numpy()[useful],
            "least": least[useful],
            "latest": latest[useful],
            "firsts": pd.Series(cuts, dtype=object),
        }
    )


_FIRSTS = "x bigint, y bigint, least bigint, latest bigint, firsts array<bigint>"


def _searched(contents: DataFrame, crowded: DataFrame, words: int) -> DataFrame:
    """The smallest document with each window of a segment, by the shards' indexes."""
    spark = contents.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // WORDS_PER_SHARD))
    found = (
        lookup_join(contents, crowded.withColumn("__crowded", F.lit(True)), ["anchor"])
        .where("__crowded IS NULL")
        .withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_shard, _FIRSTS)
    )
    if crowded.isEmpty():
        return found
    # Windows under an anchor that very many segments share: one by one, by their own words.
    split = F.split(F.col("content").cast("string"), " ")
    windows = (
        lookup_join(contents, crowded.withColumn("__crowded", F.lit(True)), ["anchor"])
        .where("__crowded")
        .select("x", "y", "lowest", split.alias("w"))
        .select("x", "y", "lowest", "w", F.explode(F.sequence(F.lit(1), F.size("w") - WIDTH + 1)).alias("j"))
        .select("x", "y", "j", "lowest", F.concat_ws(" ", F.slice("w", F.col("j"), WIDTH)).alias("window"))
    )
    first = windows.groupBy("window").agg(F.min("lowest").alias("least"))
    single = (
        windows.join(first, "window")
        .groupBy("x", "y")
        .agg(F.array_sort(F.collect_list(F.struct("j", "least"))).alias("f"))
        .select("x", "y", F.col("f.least").alias("firsts"))
        .select("x", "y", F.array_min("firsts").alias("least"), F.array_max("firsts").alias("latest"), "firsts")
    )
    return found.unionByName(single)


def _first_documents(places: DataFrame, stored: DataFrame) -> DataFrame:
    """``(x, y, least, latest, firsts)``: the smallest documents with a segment's windows.

    ``firsts`` is null where one document is the first one of them all.
    """
    spark = places.sparkSession
    # Each first() takes the values of one and the same place.
    different = materialize(
        places.groupBy("x", "y").agg(
            F.min("doc").alias("lowest"),
            F.max("doc").alias("highest"),
            *[F.first(c).alias(c) for c in ("doc", "row", "first", "n", "anchor")],
        ),
        "segments",
    )
    _release(spark)
    counted = different.groupBy("anchor").agg(F.count(F.lit(1)).alias("segments"))
    several = materialize(counted.where("segments > 1"), "anchors_of_several")
    n, words = different.agg(F.count(F.lit(1)), F.sum(F.col("n") + WIDTH - 1)).first()
    searched = materialize(shuffled_lookup(different, several, ["anchor"], n), "segments")
    discard(different)
    alone = searched.where("segments IS NULL AND lowest < highest").select(
        "x", "y", F.col("lowest").alias("least"), F.col("lowest").alias("latest"),
        F.lit(None).cast("array<bigint>").alias("firsts"),
    )
    asked = (
        searched.where("segments IS NOT NULL")
        .repartition("row")
        .groupBy("row", "doc")
        .agg(F.collect_list(F.struct("x", "y", "anchor", "lowest", "highest", "first", "n")).alias("wanted"))
    )
    contents = _join_stored(stored, asked, "inner").select("packed", "wanted").mapInArrow(
        _contents, "x bigint, y bigint, anchor bigint, lowest bigint, highest bigint, content binary"
    )
    crowded = several.where(F.col("segments") > SEGMENTS_PER_ANCHOR).select("anchor")
    if not crowded.isEmpty():
        contents = materialize(contents, "contents")
    found = materialize(alone.unionByName(_searched(contents, crowded, words or 0)), "first_documents")
    discard(searched, several, contents)
    _release(spark)
    return found


def _release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps, which the driver's collector decides on."""
    gc.collect()
    spark._jvm.System.gc()


def _stored_by_row(df: DataFrame) -> DataFrame:
    """The documents in buckets by ``row``: later joins on it do not shuffle their texts."""
    spark = df.sparkSession
    path, name = scratch_path(spark, "documents"), f"kinweave_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, "row").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the plan knows their buckets
    table._stored_at = path
    return table


def _join_stored(stored: DataFrame, by_row: DataFrame, how: str) -> DataFrame:
    """Join on the row's hash, where the documents lie, and on the document beside it.

    Documents may share a hash. Their difference is no join key, so the buckets fit.
    """
    right = by_row.withColumnRenamed("doc", "__doc").withColumnRenamed("row", "__row").hint("merge")
    same = (F.col("row") == F.col("__row")) & (F.col("doc") - F.col("__doc") == 0)
    return stored.join(right, same, how).drop("__doc", "__row")


def _remove(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, last = [], [], []
            for packed, whole, single in zip(
                *[batch.column(n).to_pylist() for n in ("packed", "whole", "single")], strict=True
            ):
                words = _words(packed, unpack)
                kept = words
                if whole or single:
                    first, n = np.divmod(np.array([*(whole or []), *[s * _STEP + 1 for s in single or []]], np.int64), _STEP)
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + n + WIDTH - 1, -1)
                    gone = np.cumsum(change)[:-1] > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
                last.append(b" ".join(kept).decode() if keep_text else _digest(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(last, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text" if keep_text else "kept_sha256"],
            )

    return run


def repeated_windows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents in store, and per row the places that are to go.

    ``whole`` has the first of n windows that all go, as first * _STEP + n, and ``single`` the
    windows that go one by one.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64("doc_id", text).alias("row"), text.alias("text")
    )
    anchors = (
        rows.where("doc IS NOT NULL AND text IS NOT NULL")
        .select("row", "text")
        .mapInArrow(_anchors, "anchor bigint, row bigint, salt bigint, repeated boolean")
    )
    # At most one row per anchor and flush of a task meets here, whatever repeats.
    repeated = materialize(
        anchors.repartition("anchor", "salt").mapInArrow(_repeated, "row bigint, anchor bigint"),
        "repeated_anchors",
    )
    _release(spark)
    wanted = repeated.groupBy("row").agg(F.collect_list("anchor").alias("anchors"))
    packed = rows.select("doc", "row", "text").mapInArrow(_pack, "doc bigint, row bigint, packed binary")
    stored = _stored_by_row(
        packed.join(wanted, "row", "left").select(
            "doc", "row", "packed", F.when(F.col("doc").isNotNull(), F.col("anchors")).alias("anchors")
        )
    )
    discard(repeated)
    _release(spark)
    places = materialize(
        stored.where("anchors IS NOT NULL").select("doc", "row", "packed", "anchors").mapInArrow(_places, _PLACES),
        "places",
    )
    firsts = _first_documents(places, stored)
    # A segment that very many documents share is a hot key, which the lookup spreads.
    found = shuffled_lookup(places.drop("anchor"), firsts, ["x", "y"], places.count())
    all_go = F.col("doc") > F.col("latest")
    some = F.filter(
        F.transform("firsts", lambda f, j: F.when(f < F.col("doc"), F.col("first") + j)),
        lambda s: s.isNotNull(),
    )
    gone = (
        found.where(F.col("doc") > F.col("least"))
        .select(
            "row", "doc",
            F.when(all_go, F.col("first").cast("bigint") * _STEP + F.col("n")).alias("whole"),
            F.when(~all_go, some).alias("single"),
        )
        .repartition("row")
        .groupBy("row", "doc")
        .agg(F.collect_list("whole").alias("whole"), F.flatten(F.collect_list("single")).alias("single"))
    )
    return stored, gone


def substring_dedup(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and kept_sha256 (or kept_text).

    Every word in a window of WIDTH words that also starts in a document with a smaller
    doc_id is removed; kept words are joined by one space. Null texts have no words. Rows
    that share a doc_id take nothing from each other. A document without an id has no
    place in the order: it is left whole and takes nothing from others. Ids that are no whole
    numbers are ordered as they sort and come back as they are.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        ids = materialize(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "ids")
        numbered = materialize(row_position(ids, ["doc_id"], name="__number"), "ids")
        rows = lookup_join(docs.select("doc_id", "text"), numbered, ["doc_id"])
        cleaned = substring_dedup(rows.select(F.col("__number").alias("doc_id"), "text"), keep_text)
        named = numbered.select(F.col("__number").alias("__n"), F.col("doc_id").alias("__id"))
        back = lookup_join(cleaned.withColumnRenamed("doc_id", "__n"), named, ["__n"])
        return back.select(F.col("__id").alias("doc_id"), *cleaned.columns[1:])
    stored, gone = repeated_windows(docs)
    last = "kept_text" if keep_text else "kept_sha256"
    return (
        _join_stored(stored, gone, "left")
        .select("doc", "packed", "whole", "single")
        .mapInArrow(_remove(keep_text), f"doc_id bigint, n_words bigint, n_removed bigint, {last} string")
    )
