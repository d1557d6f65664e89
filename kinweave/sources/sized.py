"""Parquet files of an even size, whatever number of tasks made the rows."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.plans.joins import lookup_join
from kinweave.plans.storage import discard, materialize

TARGET_BYTES = 128 * 1024 * 1024
# Pieces that are packed are at most this part of a file.
_PIECES_PER_FILE = 4


@dataclass(frozen=True)
class Packing:
    """Bins, and per file the bins of its pieces: a piece is an even share of the file's rows."""

    bins: int
    of_file: dict[str, list[int]]


def pack(sizes: dict[str, int], target_bytes: int) -> Packing:
    """Files cut into pieces of a fourth of the target at most, packed into bins of its size.

    The largest piece goes first and into the emptiest bin, so bins differ by one piece at
    most. With a total of over two thirds of the target, that leaves every bin between 0.4
    and 1.75 times the target.
    """
    total = sum(sizes.values())
    bins = max(1, round(total / target_bytes))
    most = max(1, target_bytes // _PIECES_PER_FILE)
    counts = {f: max(1, -(-s // most)) for f, s in sizes.items()}
    pieces = sorted(((s / counts[f], f) for f, s in sizes.items() for _ in range(counts[f])), reverse=True)
    heap = [(0.0, b) for b in range(bins)]
    of_file: dict[str, list[int]] = {f: [] for f in sizes}
    for size, file in pieces:
        load, b = heapq.heappop(heap)
        of_file[file].append(b)
        heapq.heappush(heap, (load + size, b))
    return Packing(bins, of_file)


def file_sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the data files in a folder, by name."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {str(s.getPath().getName()): int(s.getLen()) for s in files.listStatus(hadoop) if s.isFile()}
    return {n: size for n, size in found.items() if not n.startswith(("_", "."))}


def compact_files(
    spark: SparkSession, source: str, path: str, target_bytes: int = TARGET_BYTES,
    mode: str = "errorifexists",
) -> None:
    """Write the Parquet files of ``source`` anew under ``path``, each of about the target size.

    Rows go straight to the task of their bin, and every bin is one file. Less data than the
    target makes one file. An empty source makes one file without rows.
    """
    sizes = file_sizes(spark, source)
    packing = pack(sizes, target_bytes)
    rows = spark.read.parquet(source)
    where = spark.createDataFrame(list(packing.of_file.items()), "__file string, __bins array<int>")
    placed = lookup_join(rows.withColumn("__file", F.col("_metadata.file_name")), where, ["__file"])
    # Rows of a file are numbered within its split, so its pieces get even shares.
    turn = F.pmod(F.monotonically_increasing_id(), F.size("__bins")).cast("int")
    bin_ = F.coalesce(F.get("__bins", turn), F.lit(0))
    dealt = placed.withColumn("__bin", bin_).repartitionById(packing.bins, F.col("__bin"))
    dealt.drop("__file", "__bins", "__bin").write.mode(mode).parquet(path)


def write_sized(
    df: DataFrame, path: str, target_bytes: int = TARGET_BYTES, mode: str = "errorifexists"
) -> None:
    """Write Parquet files of about the target size, as measured once the rows are compressed.

    The rows are written once by the tasks that made them, which shows their true size, and
    then packed. A file may be smaller or larger by a factor of two.
    """
    stored = materialize(df, "unsized")
    compact_files(df.sparkSession, stored._stored_at, path, target_bytes, mode)
    discard(stored)
