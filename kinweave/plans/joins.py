"""Left joins against a table that is unique on the join key.

Three physical ways, chosen by measured size:

* the table is small: broadcast it, and the big side is not shuffled at all;
* otherwise shuffle both sides on the key;
* keys that fill more than a task on the big side are spread over salts, and their few
  dictionary rows are repeated for each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.plans.storage import discard, materialize

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_TASK = 4_000_000
MAX_HOT_KEYS = 50_000
_SAMPLES_PER_TASK = 100


def _width(field: T.StructField):
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + F.lit(8)
    if isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0)) + F.lit(8)
    return F.lit(8)


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """Measure the table; true when it has few rows and few bytes."""
    width = sum((_width(f) for f in df.schema.fields), F.lit(0)).cast("bigint")
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    max_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Left join of ``right``, which holds each key once."""
    if fits_broadcast(right, max_rows):
        return left.join(F.broadcast(right), list(on), "left")
    return shuffled_lookup(left, right, on, rows_per_task=rows_per_task)


def shuffled_lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_rows: int | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The lookup for a table of any size; hot keys of ``left`` never meet in one task.

    A sample of the keys finds the hot ones. Their rows get a salt from the hash of the
    whole row and their dictionary rows are repeated for every salt, so one pass and one
    shuffle of ``left`` serve all keys. The sample decides only how far a key is spread:
    a key it misjudges is joined all the same.
    """
    on = list(on)
    if left_rows is not None and left_rows <= rows_per_task:
        return left.join(right, on, "left")

    fraction = min(1.0, _SAMPLES_PER_TASK / rows_per_task)
    names = {k: f"__hot_{k}" for k in on}
    # Beyond the limit a key is no longer spread, which bounds what is broadcast in rows.
    hot = materialize(
        left.select(*on)
        .sample(fraction, seed=23)
        .groupBy(*on)
        .count()
        .where(F.col("count") > rows_per_task * fraction / 2)
        .orderBy(F.desc("count"))
        .limit(MAX_HOT_KEYS)
        .select(
            *[F.col(k).alias(n) for k, n in names.items()],
            F.ceil(F.col("count") / F.lit(rows_per_task * fraction / 2)).cast("int").alias("__salts"),
        ),
        "hot_keys",
    )
    # Long keys could still make the broadcast large; the adaptive join is left with them.
    if hot.isEmpty() or not fits_broadcast(hot, MAX_HOT_KEYS):
        discard(hot)
        return left.join(right, on, "left")
    is_hot = F.lit(True)
    for k, n in names.items():
        is_hot = is_hot & F.col(k).eqNullSafe(F.col(n))
    hashable = [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]
    spread = left.join(F.broadcast(hot), is_hot, "left").withColumn(
        "__salt", F.coalesce(F.pmod(F.xxhash64(*hashable), F.col("__salts")).cast("int"), F.lit(0))
    )
    repeated = right.join(F.broadcast(hot), is_hot, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    )
    gone = [*names.values(), "__salts"]
    return spread.drop(*gone).join(repeated.drop(*gone), [*on, "__salt"], "left").drop("__salt")
