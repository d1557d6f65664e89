"""Lookups of a value in a dictionary: by key, by interval, by sorted position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.scalars import comma_fields, count_at_most
from kinweave.operators.windows import row_position
from kinweave.plans.joins import BROADCAST_ROWS, fits_broadcast, lookup_join
from kinweave.plans.slices import ROWS_PER_SLICE, constant_arrays, slice_rows

# A BETWEEN join compares every row with every interval; measured, it loses to the binary
# search well before 1,000 intervals.
BETWEEN_ROWS = 100
# A dictionary up to this size travels to every task of a binary search.
SEARCH_ROWS = 50_000
SEARCH_BYTES = 8 * 1024 * 1024
_OVERLAP = "intervals are not disjoint"


def last_per_key(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """One row per key: the value that comes last in ``order``.

    A row without an order comes before all others; of tied rows the largest value wins.
    """
    return df.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias(value))


def keyed_lookup(
    big: DataFrame,
    small: DataFrame,
    key: str,
    value: str,
    order: str | None = None,
    miss: str | None = "null",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Append to every row of ``big`` the value of its key; a miss gives ``miss``.

    A text as ``miss`` makes the value a text too. With ``order`` the last of several rows with one key wins; without it the keys of
    ``small`` must be unique, which is checked. ``small`` is broadcast when it measures
    small enough.
    """
    if order is None:
        small = small.select(key, value)
        keyed = small.where(F.col(key).isNotNull())  # a null key never matches
        twice = keyed.groupBy(key).count().where("count > 1").first()
        if twice is not None:
            raise ValueError(f"key {twice[0]!r} occurs {twice[1]} times; give an order column")
    else:
        small = last_per_key(small.where(F.col(key).isNotNull()), key, value, order)
    joined = lookup_join(big, small, [key], max_rows)
    if miss is None:
        return joined
    found = F.col(value).cast("string") if isinstance(miss, str) else F.col(value)
    return joined.withColumn(value, F.coalesce(found, F.lit(miss)))


def append_lookup_text(
    lines: DataFrame, side: DataFrame, strict: bool = True, text: str = "value"
) -> DataFrame:
    """Text lines with ``,name`` appended, looked up by the number in their first field.

    ``side`` has ``id``, ``name`` and ``line_order``. A first field that is not a number
    fails the job, or misses when ``strict`` is off.
    """
    first = F.get(comma_fields(text), F.lit(0))
    keyed = lines.withColumn("id", first.cast("int") if strict else first.try_cast("int"))
    named = keyed_lookup(keyed, side, "id", "name", "line_order")
    return named.select(F.concat_ws(",", text, "name").alias(text))


def position_lookup(values: DataFrame, dictionary: DataFrame, value: str) -> DataFrame:
    """0-based position of each value in the sorted distinct dictionary, -1 when missing."""
    listed = dictionary.select(value).where(F.col(value).isNotNull()).distinct()
    ranked = row_position(listed, [value])
    joined = lookup_join(values, ranked, [value])
    return joined.withColumn("position", F.coalesce("position", F.lit(-1).cast("bigint")))


def _common_type(values: DataFrame, dictionary: DataFrame, x: str, start: str, end: str) -> T.DataType:
    """The type in which BETWEEN compares a value with both ends."""
    kinds = [values.schema[x], dictionary.schema[start], dictionary.schema[end]]
    nulls = [F.lit(None).cast(k.dataType) for k in kinds]
    return values.sparkSession.range(0).select(F.coalesce(*nulls).alias("x")).schema["x"].dataType


def _bounded(
    dictionary: DataFrame, start: str, end: str, payload: Sequence[str], kind: T.DataType
) -> DataFrame:
    """The intervals that have both ends, of the common type; without them one holds nothing."""
    return dictionary.select(
        F.col(start).cast(kind).alias(start), F.col(end).cast(kind).alias(end), *payload
    ).where(F.col(start).isNotNull() & F.col(end).isNotNull())


def range_lookup(
    values: DataFrame,
    dictionary: DataFrame,
    x: str,
    start: str,
    end: str,
    payload: Sequence[str],
    max_rows: int = BETWEEN_ROWS,
) -> DataFrame:
    """Interval that holds ``x`` (both ends belong to it): its payload and 0-based position.

    No match gives position -1 and a null payload. Value and ends are compared in their
    common type, and intervals that overlap fail the job, whatever their number. A
    dictionary over ``max_rows`` goes through ``range_lookup_asof``.
    """
    kind = _common_type(values, dictionary, x, start, end)
    bounded = _bounded(dictionary, start, end, payload, kind)
    if bounded.count() > max_rows:
        return range_lookup_asof(values, dictionary, x, start, end, payload)
    # At most max_rows rows, so one window may order them all.
    ordered = Window.orderBy("__start", "__end")
    ranked = (
        bounded.select(F.col(start).alias("__start"), F.col(end).alias("__end"), *payload)
        .withColumn("__before", F.lag("__end").over(ordered))
        .withColumn("position", (F.row_number().over(ordered) - 1).cast("bigint"))
    )
    clash = F.col("__start") <= F.col("__before")
    checked = F.when(clash, F.raise_error(F.lit(_OVERLAP)).cast("bigint")).otherwise(F.col("position"))
    # Sorting evaluates the check for every interval before any is joined.
    ranked = ranked.select("__start", "__end", *payload, checked.alias("position")).orderBy("position")
    probe = F.col(x).cast(kind)
    inside = (probe >= F.col("__start")) & (probe <= F.col("__end"))
    joined = values.join(F.broadcast(ranked), inside, "left").drop("__start", "__end")
    return joined.withColumn("position", F.coalesce("position", F.lit(-1).cast("bigint")))


def range_lookup_asof(
    values: DataFrame,
    dictionary: DataFrame,
    x: str,
    start: str,
    end: str,
    payload: Sequence[str],
    max_rows: int = SEARCH_ROWS,
) -> DataFrame:
    """The same lookup for a dictionary of any size, which must be disjoint.

    The last interval that starts at or before ``x`` is the only one that can hold it.
    Up to ``max_rows`` intervals, every row finds it by binary search in the sorted
    starts, and the big side is not shuffled. A larger dictionary goes through
    ``range_lookup_merged``. Overlapping intervals fail the job.
    """
    kind = _common_type(values, dictionary, x, start, end)
    bounded = _bounded(dictionary, start, end, payload, kind)
    if not fits_broadcast(bounded, max_rows, SEARCH_BYTES):
        return range_lookup_merged(values, dictionary, x, start, end, payload)
    interval = F.struct(start, F.struct(F.col(end).alias("end"), *payload).alias("rest"))
    ordered = bounded.agg(F.array_sort(F.collect_list(interval)).alias("items"))
    others = F.greatest(F.size("items") - F.lit(1), F.lit(0))
    overlaps = F.exists(
        F.arrays_zip(
            F.slice("items", F.lit(2), others).alias("later"),
            F.slice("items", F.lit(1), others).alias("earlier"),
        ),
        lambda pair: pair["later"][start] <= pair["earlier"]["rest"]["end"],
    )
    starts = F.transform("items", lambda i: i[start])
    checked = F.when(overlaps, F.raise_error(F.lit(_OVERLAP))).otherwise(starts)
    [(points, number)] = constant_arrays(ordered.select(checked.alias("starts")), "starts")
    ranked = ordered.select(F.posexplode("items").alias("__position", "__item")).select(
        "__position",
        F.col("__item.rest.end").alias("__end"),
        *[F.col("__item.rest")[c].alias(f"__of_{c}") for c in payload],
    )
    probe = F.col(x).cast(kind)
    found = values.withColumn("__index", count_at_most(points, probe, number) - F.lit(1))
    same = F.col("__index").eqNullSafe(F.col("__position"))
    found = found.join(F.broadcast(ranked), same, "left")
    hit = probe <= F.col("__end")
    return found.select(
        *values.columns,
        *[F.when(hit, F.col(f"__of_{c}")).alias(c) for c in payload],
        F.when(hit, F.col("__index")).otherwise(F.lit(-1)).cast("bigint").alias("position"),
    )


def range_lookup_merged(
    values: DataFrame,
    dictionary: DataFrame,
    x: str,
    start: str,
    end: str,
    payload: Sequence[str],
    rows_per_slice: int = ROWS_PER_SLICE,
    one_task_rows: int | None = None,
) -> DataFrame:
    """The same lookup when neither side is small: values and starts in one sorted sequence.

    The sequence is cut into slices of its order. Each row takes the last start of its
    slice, or the last one of the earlier slices. Equal values are told apart by the hash
    of their row and equal rows by a row number, so a value that fills a third of the rows
    is cut into several slices too. A task that runs again may number rows differently,
    but then only rows that are equal in every column change places.
    """
    kind = _common_type(values, dictionary, x, start, end)
    starts = _bounded(dictionary, start, end, payload, kind).select(
        F.col(start).alias("__x"),
        F.lit(0).alias("__kind"),
        F.lit(0).cast("bigint").alias("__hash"),
        F.lit(0).cast("bigint").alias("__tie"),
        F.struct(F.col(start).alias("start"), F.col(end).alias("end"), *payload).alias("__interval"),
    )
    hashable = [f.name for f in values.schema if "map<" not in f.dataType.simpleString()]
    probes = values.select(
        F.col(x).cast(kind).alias("__x"),
        F.lit(1).alias("__kind"),
        F.xxhash64(*hashable).alias("__hash"),
        F.monotonically_increasing_id().alias("__tie"),
        F.struct(*values.columns).alias("__row"),
    )
    sequence = starts.unionByName(probes, allowMissingColumns=True)
    sliced = slice_rows(
        sequence,
        ["__x", "__kind", "__hash", "__tie"],
        rows_per_slice=rows_per_slice,
        one_task_rows=one_task_rows,
    )
    is_start = F.col("__kind") == 0
    started = F.when(is_start, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    upto = sliced.window().rowsBetween(Window.unboundedPreceding, 0)
    before = sliced.window().rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        sliced.rows.withColumn("__earlier", F.last("__interval", ignorenulls=True).over(before))
        .withColumn("__count", F.sum(started).over(upto))
    )
    if sliced.split:
        rows = sliced.with_carry(
            rows,
            {
                "__last": F.max_by("__interval", F.when(is_start, F.col("__x"))),
                "__starts": F.sum(started),
            },
            lambda column, earlier: F.last(column, ignorenulls=True).over(earlier)
            if column == "__last"
            else F.sum(column).over(earlier),
        )
        rows = rows.withColumn("__earlier", F.coalesce("__earlier", "__last")).withColumn(
            "__count", F.col("__count") + F.coalesce(F.col("__starts"), F.lit(0))
        )
    clash = is_start & (F.col("__x") <= F.col("__earlier.end"))
    wanted = F.when(clash, F.raise_error(F.lit(_OVERLAP)).cast("boolean"))
    hit = F.col("__x") <= F.col("__earlier.end")
    return rows.where(wanted.otherwise(~is_start)).select(
        "__row.*",
        *[F.when(hit, F.col(f"__earlier.{c}")).alias(c) for c in payload],
        F.when(hit, F.col("__count") - F.lit(1)).otherwise(F.lit(-1)).alias("position"),
    )
