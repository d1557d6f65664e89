"""Log files taken in once each.

A file stream keeps in its checkpoint which files it has seen, and the file sink keeps in its
own log which batches it has written. A run handles all files that are new and then stops, so it
fits a nightly job. A run that died is repeated with the same files under the same batch number;
what a dead attempt wrote is not in the sink's log, so readers never see it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.identity import extract_ids

# The partitions of the sink.
EVENT, CORRUPT = "event", "corrupt"
FILES_PER_BATCH = 10_000


def take_in_logs(
    spark: SparkSession, source: str, target: str, checkpoint: str,
    files_per_batch: int = FILES_PER_BATCH,
) -> int:
    """Parse the log files under ``source`` that no earlier run has taken in; gives their rows.

    Each line is parsed once: events go to ``target`` with their identifiers, lines that are no
    JSON beside them with their text. Files must arrive whole (written elsewhere and
    renamed), and keep their name. ``checkpoint`` belongs to this source and target alone.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(source)
        .select("value", F.col("_metadata.file_name").alias("file"))
    )
    kind = F.when(F.col("corrupt").isNull(), EVENT).otherwise(CORRUPT)
    rows = extract_ids(lines).select(
        "file", "ids", F.when(F.col("corrupt").isNotNull(), F.col("value")).alias("line"), kind.alias("kind")
    )
    query = (
        rows.writeStream.format("parquet")
        .partitionBy("kind")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def _taken_in(spark: SparkSession, target: str, kind: str) -> DataFrame:
    schema = "file string, ids array<string>, line string, kind string"
    return spark.read.schema(schema).parquet(target).where(F.col("kind") == kind)


def read_intake(spark: SparkSession, target: str) -> DataFrame:
    """``(file, ids)`` of every event taken in so far."""
    return _taken_in(spark, target, EVENT).select("file", "ids")


def read_corrupt_lines(spark: SparkSession, target: str) -> DataFrame:
    """``(file, line)`` of the lines that could not be parsed."""
    return _taken_in(spark, target, CORRUPT).select("file", "line")
