"""Vector code compression: product quantisation by a trie over the parts of vectors.

Vectors of whole numbers are cut into equal parts, and each part position has a codebook.
The distinct parts of a task, sorted, are the leaves of a lexicographic trie whose levels are
dimensions. Going through it depth first, the distances from a prefix to all entries of the
codebook are accumulated once and shared by every part that starts with it; a leaf takes the
nearest entry and adds its part, times the number of vectors that have it, to that entry's sum.

Vectors are never shuffled: a task gives back one sum per entry, so a round moves entries times
tasks rows, whatever is repeated in the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.plans.joins import lookup_join
from kinweave.plans.storage import materialize

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
# Larger whole numbers would take squared distances beyond 64 bits.
LARGEST = 1 << 26
# Vectors whose parts make up one trie, and leaves of small subtrees that are finished together.
_VECTORS_PER_TRIE = 1 << 15
_LEAVES = 512


def _distances(leaves: np.ndarray, entries: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared distances of sorted leaves to all entries, shared along common prefixes.

    ``above`` holds the distances that the leaves' common node has accumulated; the dimensions
    are those below it. Every level holds one row per node.
    """
    n, dims = leaves.shape
    differs = np.empty((n, dims), bool)
    differs[0] = True
    # A leaf opens a node at every level from the first dimension it does not share on.
    np.logical_or.accumulate(leaves[1:] != leaves[:-1], axis=1, out=differs[1:])
    node = np.zeros(n, np.int64)  # of the level above, for each leaf
    above = above[None, :]
    for d in range(dims):
        opened = np.flatnonzero(differs[:, d])
        step = leaves[opened, d][:, None] - entries[:, d][None, :]
        step *= step
        step += above if len(above) == len(opened) else above[node[opened]]
        above, node = step, np.cumsum(differs[:, d]) - 1
    return above if len(above) == n else above[node]


def _subtrees(leaves: np.ndarray, depth: int) -> list[tuple[int, int, bool]]:
    """The children of a node in order, as (begin, end, alone): neighbours of together at most
    _LEAVES leaves make one run, and a child of more stands alone."""
    first = np.concatenate([[0], np.flatnonzero(leaves[1:, depth] != leaves[:-1, depth]) + 1])
    runs: list[tuple[int, int, bool]] = []
    for begin, end in zip(first.tolist(), [*first[1:].tolist(), len(leaves)], strict=True):
        alone = end - begin > _LEAVES
        if runs and not alone and not runs[-1][2] and end - runs[-1][0] <= _LEAVES:
            runs[-1] = (runs[-1][0], end, False)
        else:
            runs.append((begin, end, alone))
    return runs


def nearest(leaves: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each leaf (the lower one of equals) and its squared distance.

    ``leaves`` are distinct and in lexicographic order. The trie is gone through depth first:
    a node adds its dimension's term to the distances that its parent accumulated, and runs
    of small subtrees are finished together from their parent's. All numbers are whole, so
    distances are exact.
    """
    bound = max(int(np.abs(leaves).max(initial=0)), int(np.abs(entries).max(initial=0)))
    small = 4 * bound * bound * leaves.shape[1] < 1 << 31
    kind = np.int32 if small else np.int64
    leaves, entries = leaves.astype(kind), entries.astype(kind)
    best, error = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
    todo = [(0, len(leaves), 0, np.zeros(len(entries), kind))] if len(leaves) else []
    while todo:
        begin, end, depth, above = todo.pop()
        if end - begin <= _LEAVES:
            far = _distances(leaves[begin:end, depth:], entries[:, depth:], above)
            chosen = far.argmin(axis=1)
            best[begin:end], error[begin:end] = chosen, far[np.arange(len(far)), chosen]
            continue
        for a, b, alone in reversed(_subtrees(leaves[begin:end], depth)):
            if alone:
                term = leaves[begin + a, depth] - entries[:, depth]
                todo.append((begin + a, begin + b, depth + 1, above + term * term))
            else:
                todo.append((begin + a, begin + b, depth, above))
    return best, error


def sorted_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, the place of each row in them, and their counts."""
    if len(parts) == 0:
        return parts, np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    fresh = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], place, np.bincount(place)


def _quantised(vector: str, scale: int) -> Column:
    """The vector in whole numbers; null where it or a component is null or not finite."""
    doubles = F.col(vector).cast("array<double>")
    # A comparison with null is null and infinity fails the second test, as does NaN.
    finite = F.forall(doubles, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    size = F.lit(float(LARGEST))
    too_large = F.exists(doubles, lambda x: F.abs(x * F.lit(float(scale))) >= size)
    whole = F.transform(doubles, lambda x: F.floor(x * F.lit(float(scale))))
    failed = F.raise_error(F.lit("a component is too large for exact distances")).cast("array<bigint>")
    return F.when(doubles.isNotNull() & finite, F.when(too_large, failed).otherwise(whole))


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrow lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined into blocks of a bounded number of vectors."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held and sum(b.num_rows for b in held) + batch.num_rows > _VECTORS_PER_TRIE:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _round(whole: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: entries become the floored means of their parts."""
    parts, entries, dims = books.shape
    shared = whole.sparkSession.sparkContext.broadcast(books)
    schema = "part int, entry int, n bigint, sums array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, dims), np.int64)
        for block in _blocks(batches):
            vectors = _matrix(block.column("__whole"))
            for p in range(parts):
                leaves, _, weight = sorted_parts(vectors[:, p * dims : (p + 1) * dims])
                best, _ = nearest(leaves, books[p])
                np.add.at(counts[p], best, weight)
                np.add.at(sums[p], best, leaves * weight[:, None])
        part, entry = np.nonzero(counts)
        columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry]]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    totals = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims)]
    summed = (
        whole.select("__whole").mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals)
    )
    after = books.copy()
    for part, entry, n, *total in summed.collect():  # parts * entries rows at most
        after[part, entry] = np.array(total, np.int64) // n
    return after


def _first_books(whole: DataFrame, vec_id: str, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks of the vectors with the smallest ids, one row per position and entry."""
    usable = whole.where((F.size("__whole") > 0) & (F.size("__whole") % parts == 0))
    chosen = usable.orderBy(F.col(vec_id).asc_nulls_last(), "__whole").select("__whole").limit(entries).collect()
    chosen = [r[0] for r in chosen if len(r[0]) == len(chosen[0][0])]
    if not chosen:
        return None
    cube = np.array(chosen, np.int64).reshape(len(chosen), parts, -1)
    return np.ascontiguousarray(cube.transpose(1, 0, 2))


def train_codebooks(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> np.ndarray | None:
    """Codebooks ``[part, entry, dimension]`` after so many rounds; None without vectors.

    They start as the parts of the ``entries`` smallest ids (fewer if there are fewer
    vectors; of equal ids the smaller vector first, null ids last). An entry without parts
    stays as it is. See ``encode`` for the vectors that are left out.
    """
    whole = vectors.select(vec_id, _quantised(vector, scale).alias("__whole")).where("__whole IS NOT NULL")
    books = _first_books(whole, vec_id, parts, entries)
    if books is None:
        return None
    kept = whole.where(F.size("__whole") == books.shape[0] * books.shape[2])
    return reduce(lambda b, _: _round(kept, b), range(rounds), books)


def encode(
    vectors: DataFrame, books: np.ndarray | None, vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """The rows with ``code`` (two hex digits per part) and ``error`` in place of the vector.

    Left out are rows whose vector is null, empty, holds a null or a component that is not
    finite, or has another length than that of the smallest id. A component of LARGEST or
    more in whole numbers fails the job. Other columns stay but for ``code`` and ``error``,
    which are replaced. No shuffle.
    """
    others = [f.name for f in vectors.schema.fields if f.name not in (vector, "code", "error")]
    # A void column has no Arrow form that comes back; as text it stays null.
    kept = [
        F.col(f"`{n}`").cast("string").alias(n) if vectors.schema[n].dataType == T.NullType() else F.col(f"`{n}`")
        for n in others
    ]
    whole = vectors.select(*kept, _quantised(vector, scale).alias("__whole"))
    added = [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    schema = T.StructType([*[whole.schema[n] for n in others], *added])
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    parts, entries, dims = books.shape
    if entries > 256:
        raise ValueError("two hex digits have room for 256 entries")
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for block in _blocks(batches):
            rows = _matrix(block.column("__whole"))
            codes, errors = np.empty((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                leaves, place, _ = sorted_parts(rows[:, p * dims : (p + 1) * dims])
                best, error = nearest(leaves, books[p])
                codes[:, p] = best[place]
                errors += error[place]
            text = codes.tobytes().hex()
            code = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)])
            yield pa.RecordBatch.from_arrays(
                [*[block.column(n) for n in others], code, pa.array(errors)], [*others, "code", "error"]
            )

    return whole.where(F.size("__whole") == parts * dims).mapInArrow(run, schema)


def decode(codes: DataFrame, books: np.ndarray, code: str = "code", scale: int = SCALE) -> DataFrame:
    """The rows with ``vector``, the entries their code stands for, scaled back."""
    parts, entries, dims = books.shape
    # One constant per part position: entries * dims numbers, whatever the table's size.
    tables = [F.array(*[F.array(*[F.lit(v / scale) for v in e]) for e in book]) for book in books.tolist()]
    picked = [
        F.get(tables[p], F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")) for p in range(parts)
    ]
    return codes.withColumn("vector", F.concat(*picked))


def books_digest(books: np.ndarray | None) -> str:
    """sha256 of all numbers by part, entry and place, joined by commas."""
    text = "" if books is None else ",".join(map(str, books.ravel().tolist()))
    return hashlib.sha256(text.encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """Per kept vector: its id, code, error, label_error and codebooks_sha256.

    ``label_error`` is the error summed over the vectors of the same label, nulls together.
    Repeated rows are vectors of their own. An empty table gives no rows. See
    ``train_codebooks`` and ``encode`` for the rest.
    """
    named = vectors.select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("embedding")
    )
    books = train_codebooks(named, "embedding", "vec_id", parts, entries, rounds, scale)
    # A text that no label has stands for null, so that the lookup finds it.
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    coded = materialize(encode(named, books, scale=scale).withColumn("key", key).drop("label"), "vector_codes")
    sums = materialize(coded.groupBy("key").agg(F.sum("error").alias("label_error")), "label_errors")
    return lookup_join(coded, sums, ["key"]).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
