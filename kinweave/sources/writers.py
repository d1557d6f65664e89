"""Sinks. A write fails when its target exists, unless the caller names another mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_parquet(
    df: DataFrame, path: str, mode: str = "errorifexists", single_file: bool = False
) -> None:
    """Write Parquet. ``single_file`` puts all the writing into one task: small results only."""
    (df.coalesce(1) if single_file else df).write.mode(mode).parquet(path)


def write_text(
    df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    """Write one text line per row, columns joined by commas; a null is the text ``null``."""
    columns = columns or df.columns
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]
    df.select(F.concat_ws(",", *cells).alias("value")).write.mode(mode).text(path)
