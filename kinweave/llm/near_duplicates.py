"""N-gram Jaccard join: MinHash bands propose pairs, full n-gram sets verify them.

1. Every text gives its set of five-word shingles, as 64-bit hashes, and from it band hashes.
   Texts with one and the same set form a class; only the class's first document goes on.
2. Classes meet on band hashes. In the place of pairs, a class takes a seat in a block beside
   its likely partners, and two blocks meet once if any band brings members of both together.
3. A meeting compares the bands of its members, verifies the candidates on their sets, and
   returns one row per member: how many documents it is linked with, and the root of its links
   inside the meeting. Roots make a spanning forest, so no output is quadratic.
4. Linked classes form groups by connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.text import gram_hashes, hashes, mixed, words_of
from kinweave.operators.graph import connected_components
from kinweave.operators.windows import row_position
from kinweave.plans.joins import fits_broadcast, lookup_join
from kinweave.plans.storage import keeping_only, materialize

WORDS = 5
THRESHOLD = 0.8
# The chance that a pair at the threshold shares a band at least.
TARGET_RECALL = 0.99999
ROWS = 4
SEATS = 256  # members of a block
# Shingles that a block holds on average, 8 bytes each, so long texts fill one sooner.
BLOCK_SHINGLES = 1_000_000
_SALTS = 16


def band_count(threshold: float = THRESHOLD, recall: float = TARGET_RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` hashes needed so that a pair at the threshold meets with ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; a shorter text is one shingle."""
    h = hashes(words_of(text))
    return np.unique(gram_hashes(h, min(n, len(h)))) if len(h) else h


class MinHash:
    """Band hashes of shingle sets: ``bands`` groups of ``rows`` minima."""

    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        count = bands * rows
        self.a = rng.integers(0, 2**32, count, np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, count, np.uint64).astype(np.uint32)

    def minima(self, sets: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        x = (sets >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 1024):
            part = self.a[:, None] * x[None, at : at + 1024]
            part += self.b[:, None]
            np.minimum(low, part.min(axis=1), out=low)
        return low

    def band_hashes(self, sets: np.ndarray) -> np.ndarray:
        low = self.minima(sets).astype(np.uint64).reshape(self.bands, self.rows)
        total = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + low[:, k])
        return total


def _rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, id, text_hash, text)``: a row without an id goes by the hash of its text."""
    text = F.col("text").cast("string")
    hashed = F.xxhash64(text)
    return docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("bigint"), hashed).alias("id"),
        hashed.alias("text_hash"),
        text.alias("text"),
    )


def _signatures(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """``(doc_id, id, text_hash, set_a, set_b, n_shingles, bands)``; no bands without words."""
    bands = band_count(threshold, recall)
    names = ["doc_id", "id", "text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, ROWS)
        for batch in batches:
            first, second, sizes, signed = [], [], [], []
            for t in batch.column("text"):
                s = shingles(t.as_py())
                sizes.append(len(s))
                first.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                other = mixed(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)
                second.append(int(other.view(np.int64)))
                signed.append(minhash.band_hashes(s).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(n) for n in names],
                    *[pa.array(v, pa.int64()) for v in (first, second, sizes)],
                    pa.array(signed, pa.list_(pa.int64())),
                ],
                [*names, "set_a", "set_b", "n_shingles", "bands"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _rows(docs).mapInArrow(
        run,
        f"doc_id {kind}, id bigint, text_hash bigint, set_a bigint, set_b bigint, "
        "n_shingles bigint, bands array<bigint>",
    )


def _class() -> Column:
    """All 128 bits of a set's hash as text."""
    return F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("set_a", "set_b")])


def _seated(members: DataFrame, seats: int) -> DataFrame:
    """``(class, block)`` of the classes that share a band: likely partners side by side.

    A class's anchor is the smallest class it shares a band with; the members of an anchor
    are dealt into as many blocks as they fill, by their number or by their shingles.
    """
    lowest = members.groupBy("band").agg(F.min("class").alias("low"), F.count(F.lit(1)).alias("n"))
    paired = lowest.where("n > 1").select("band", "low")
    anchored = materialize(
        members.join(paired, "band")
        .groupBy("class")
        .agg(F.min("low").alias("anchor"), F.first("n_shingles").alias("n_shingles")),
        "anchors",
    )
    full = F.greatest(F.count(F.lit(1)) / seats, F.sum("n_shingles") / BLOCK_SHINGLES)
    sizes = anchored.groupBy("anchor").agg(F.ceil(full).alias("blocks"))
    dealt = anchored.join(sizes.where("blocks > 1"), "anchor", "left")
    deal = F.pmod(F.xxhash64("class"), F.coalesce("blocks", F.lit(1)))
    return dealt.select("class", F.xxhash64("anchor", deal).alias("block"))


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(class, block, copies, bands, shingles)`` of the wanted classes, read from the texts."""
    kept = ["class", "block", "copies", "bands"]
    texts = _rows(docs).select("id", "text_hash", "text").join(wanted, ["id", "text_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], sets], [*kept, "shingles"]
            )

    found = texts.select(*kept, "text").mapInArrow(
        run, "class string, block bigint, copies bigint, bands array<bigint>, shingles binary"
    )
    return found.dropDuplicates(["class"])  # rows that are repeated whole


def _verify(pdf_sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the (i, j) rows have a Jaccard similarity of at least the threshold.

    Few pairs are intersected one by one; many through products of 0/1 matrices, a slice
    of the shingles at a time.
    """
    sizes = np.array([len(s) for s in pdf_sets])
    i, j = pairs[:, 0], pairs[:, 1]
    small, large = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
    keep = small >= threshold * large
    shared = np.zeros(len(pairs), np.int64)
    at = np.flatnonzero(keep)
    if len(at) <= 4 * len(pdf_sets):
        for k in at:
            both = np.concatenate([pdf_sets[i[k]], pdf_sets[j[k]]])
            both.sort()
            shared[k] = (both[1:] == both[:-1]).sum()
    else:
        owner = np.repeat(np.arange(len(pdf_sets)), sizes)
        _, column = np.unique(np.concatenate(pdf_sets), return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        total = np.zeros((len(pdf_sets), len(pdf_sets)), np.float32)
        width = 8192
        for low in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [low, low + width])
            hit = np.zeros((len(pdf_sets), width), np.float32)
            hit[owner[a:b], column[a:b] - low] = 1
            total += hit @ hit.T
        shared[at] = total[i[at], j[at]].astype(np.int64)
    union = sizes[i] + sizes[j] - shared
    # Counted in whole numbers: 1000 * shared >= 1000 * threshold * union.
    return keep & (1000 * shared >= round(1000 * threshold) * union)


def _roots(count: int, pairs: np.ndarray) -> np.ndarray:
    parent = list(range(count))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(count)])


def _meeting(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("class")
        within = pdf["low"].iloc[0] == pdf["high"].iloc[0]
        bands, block = np.stack(pdf["bands"].to_numpy()), pdf["block"].to_numpy()
        classes, copies = pdf["class"].to_numpy(), pdf["copies"].to_numpy()
        found = []
        for i in range(len(pdf) - 1):
            meets = (bands[i + 1 :] == bands[i]).any(axis=1)
            if not within:  # the members of one block meet in a meeting of their own
                meets &= block[i + 1 :] != block[i]
            j = np.flatnonzero(meets) + i + 1
            found.append(np.stack([np.full(len(j), i), j], axis=1))
        pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        if len(pairs):
            sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
            pairs = pairs[_verify(sets, pairs, threshold)]
        links, partners = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for a, b in ((0, 1), (1, 0)):
            np.add.at(links, pairs[:, a], copies[pairs[:, b]])
            np.add.at(partners, pairs[:, a], 1)
        root = classes[_roots(len(pdf), pairs)]
        out = pd.DataFrame({"class": classes, "links": links, "partners": partners, "root": root})
        return out[out["partners"] > 0]

    return run


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, seats: int = SEATS
) -> DataFrame:
    """Per document: doc_id, class_id, copy_id, n_links, n_shingles and text_hash.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least
    ``threshold``. class_id is the smallest doc_id that links lead to, copy_id the smallest
    with the same set of shingles, n_links the number of other documents linked with this
    one, copies included. A text without words (null, empty) is linked with none and is its
    own class. Repeated rows and rows that share a doc_id are documents of their own. A
    document without an id counts by the hash of its text where an id is asked for. Ids that
    are no whole numbers are ordered as they sort and come back as texts. The result is stored,
    and nothing else is left in storage.
    """
    return _classes(docs, threshold, recall, seats).drop("class_hash")


def _classes(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = TARGET_RECALL, seats: int = SEATS
) -> DataFrame:
    """``near_duplicates`` and ``class_hash``, which tells classes apart that share a class_id."""
    with keeping_only(docs.sparkSession) as kept:
        if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
            found = _find_duplicates(docs, threshold, recall, seats)
        else:
            found = _with_numbered_ids(docs, threshold, recall, seats)
        kept.append(materialize(found, "near_duplicates"))
    return kept[0]


def _with_numbered_ids(docs: DataFrame, threshold: float, recall: float, seats: int) -> DataFrame:
    """The search for ids that are no whole numbers, which stand in for them in their order."""
    ids = materialize(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "ids")
    numbered = materialize(row_position(ids, ["doc_id"], name="__number"), "ids")
    rows = lookup_join(docs.select("doc_id", "text"), numbered, ["doc_id"])
    found = _find_duplicates(rows.select(F.col("__number").alias("doc_id"), "text"), threshold, recall, seats)
    names = found
    for column in ("doc_id", "class_id", "copy_id"):
        named = numbered.select(F.col("__number").alias(column), F.col("doc_id").cast("string").alias("__name"))
        known = lookup_join(names, named, [column])
        # A document without an id goes by its text's hash, which no id stands for.
        other = F.lit(None).cast("string") if column == "doc_id" else F.col(column).cast("string")
        names = known.withColumn(column, F.coalesce("__name", other)).drop("__name")
    return names.select(*found.columns)


def _find_duplicates(docs: DataFrame, threshold: float, recall: float, seats: int) -> DataFrame:
    signed = materialize(_signatures(docs, threshold, recall), "signatures")
    # A class of copies shrinks to one row per task before the shuffle.
    classes = materialize(
        signed.where("n_shingles > 0")
        .groupBy("set_a", "set_b")
        .agg(
            F.min(F.struct("id", "text_hash")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
        )
        .select(_class().alias("class"), "set_a", "set_b", "first.*", "copies", "n_shingles", "bands"),
        "classes",
    )
    members = classes.select("class", "n_shingles", F.explode("bands").alias("band"))
    seated = materialize(_seated(members, seats), "seats")
    wanted = seated.join(
        classes.select("class", "id", "text_hash", "copies", "bands"), "class"
    )
    sets = materialize(_shingle_sets(docs, wanted), "shingle_sets")

    placed = sets.select("block", F.explode("bands").alias("band")).distinct()
    other = placed.select("band", F.col("block").alias("high"))
    across = (
        placed.select("band", F.col("block").alias("low"))
        .join(other, "band")
        .where("low < high")
        .select("low", "high")
        .distinct()
    )
    own = seated.select(F.col("block").alias("low"), F.col("block").alias("high")).distinct()
    meetings = across.union(own)
    attended = meetings.withColumn(
        "block", F.explode(F.array_distinct(F.array("low", "high")))
    ).join(sets, "block")
    linked = materialize(
        attended.groupBy("low", "high").applyInPandas(
            _meeting(threshold), "class string, links bigint, partners bigint, root string"
        ),
        "links",
    )
    edges = linked.where("class <> root").select(
        F.col("class").alias("src"), F.col("root").alias("dst")
    )
    groups = materialize(connected_components(edges).withColumnRenamed("id", "class"), "groups")
    named = (
        groups.join(classes.select("class", "id"), "class")
        .groupBy("component")
        .agg(F.min("id").alias("class_id"))
    )
    totals = linked.groupBy("class").agg(F.sum("links").alias("links"))
    grouped = groups.join(named, "component").join(totals, "class")
    # Classes of one unlinked document need no row here: they are what they are.
    settled = (
        classes.select("class", "set_a", "set_b", "id", "copies")
        .join(grouped, "class", "left")
        .where("copies > 1 OR class_id IS NOT NULL")
        .select(
            "set_a",
            "set_b",
            F.col("id").alias("copy_id"),
            F.coalesce("class_id", "id").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "class").alias("class_hash"),
        )
    )
    # A large class of copies is spread over the salts.
    salted = settled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int").alias("salt")
    return (
        signed.select("doc_id", "id", "text_hash", "set_a", "set_b", "n_shingles", salt)
        .join(salted, ["set_a", "set_b", "salt"], "left")
        .select(
            "doc_id",
            F.coalesce("class_id", "id").alias("class_id"),
            F.coalesce("copy_id", "id").alias("copy_id"),
            F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
            "n_shingles",
            "text_hash",
            "class_hash",
        )
    )


def drop_rows(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose (doc_id, text_hash) is not among the rejected ones."""
    gone = rejected.select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")
    ).distinct()
    gone = materialize(gone, "rejected")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.xxhash64(
        F.col("text").cast("string")
    ).eqNullSafe(F.col("__hash"))
    return docs.join(F.broadcast(gone) if fits_broadcast(gone) else gone, same, "left_anti")


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """The documents without near duplicates: of every class one row with the smallest doc_id stays.

    Texts without words have no duplicates. Of the class's rows that share the smallest id,
    the one whose text has the smallest hash stays, once.
    """
    found = _classes(docs, **options)
    linked = found.where("n_links > 0")
    kind = found.schema["class_id"].dataType
    first = F.coalesce(F.col("doc_id").cast(kind), F.col("text_hash").cast(kind)) == F.col("class_id")
    # Different texts may share the class's id: of them the one with the smallest hash stays.
    firsts = materialize(linked.where(first).select("doc_id", "class_hash", "text_hash").distinct(), "firsts")
    smallest = firsts.groupBy("class_hash").agg(F.min("text_hash").alias("__smallest"))
    others = firsts.join(smallest, "class_hash").where(F.col("text_hash") != F.col("__smallest"))
    rejected = linked.where(~first).select("doc_id", "text_hash").unionByName(others.select("doc_id", "text_hash"))
    kept = drop_rows(docs, rejected)
    repeated = materialize(
        linked.where(first).groupBy("doc_id", "text_hash").count().where("count > 1"), "repeated_rows"
    )
    if repeated.isEmpty():
        return kept
    single = drop_rows(kept, repeated)
    hashed = kept.withColumn("__hash", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__text"))
    others = hashed.join(
        repeated.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")), same, "left_semi"
    )
    return single.unionByName(others.dropDuplicates(["doc_id", "__hash"]).drop("__hash"))
