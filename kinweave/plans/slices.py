"""Ordered slices: windows that stay distributed when one key holds much of the data.

A window partitioned by a key puts the whole key into one task. Here the rows of every
hot key are cut into contiguous slices of its order, each slice is a window partition of
its own, and what crosses a slice border travels in a small carry table with one row per
slice of a hot key.

Cut points come from a random sample, as in Spark's own range partitioner. The sample
decides only where the borders lie, so it changes the balance and never the result: every
row belongs to exactly one slice. The cut points become a constant of the plan, so all
scans of the rows agree on the borders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions.scalars import count_at_most

ROWS_PER_SLICE = 1_000_000
SAMPLES_PER_SLICE = 20
MAX_SLICES = 50_000
# At most so many rows may be ordered in one task where there is no key at all: a slice.
ONE_TASK_ROWS = ROWS_PER_SLICE
# Cut points pass through the driver; of long ones fewer are kept, so slices grow instead.
MAX_CUT_BYTES = 8 * 1024 * 1024

SLICE, TIE = "__slice", "__tie"
_POINT = "__point"
_MICROS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def constant_arrays(one_row: DataFrame, *names: str) -> list[tuple[Column, int]]:
    """Arrays in the only row of a DataFrame as constants, each with its length.

    The caller bounds the arrays: they pass through the driver into the plan. A constant
    is shared by all rows of a task; as a column each row would copy it.
    """
    cells = [c for n in names for c in (F.to_json(n, _MICROS), F.size(n))]
    found = one_row.select(*cells).first()
    kinds = [one_row.schema[n].dataType for n in names]
    return [
        (F.from_json(F.lit(found[2 * i]), kind, _MICROS), found[2 * i + 1])
        for i, kind in enumerate(kinds)
    ]


@dataclass(frozen=True)
class SlicedRows:
    """Rows with their slice number; a key that was left whole has just one."""

    rows: DataFrame
    keys: list[str]
    order: list[str]
    split: bool
    cuts: Column | None = None

    @property
    def partition(self) -> list[str]:
        return [*self.keys, SLICE] if self.split else self.keys

    def window(self) -> WindowSpec:
        """Window over one slice, in order."""
        return Window.partitionBy(*self.partition).orderBy(*self.order)

    def _of_cut_key(self) -> Column:
        """True for rows whose key has a cut point: the one before or after their slice."""
        if not self.keys:
            return F.lit(True)

        def has_my_key(cut: Column) -> Column:
            same = cut.isNotNull()
            for k in self.keys:
                same = same & cut[k].eqNullSafe(F.col(k))
            return same

        before = F.get(self.cuts, F.col(SLICE) - F.lit(1))
        return has_my_key(before) | has_my_key(F.get(self.cuts, F.col(SLICE)))

    def with_carry(
        self,
        local: DataFrame,
        partial: dict[str, Column],
        combine: Callable[[str, WindowSpec], Column],
        source: DataFrame | None = None,
    ) -> DataFrame:
        """Add to ``local`` what the earlier slices of the same key amount to.

        ``partial`` aggregates one slice (map-side first, so a hot slice shrinks before
        the shuffle) and ``combine`` folds the partials of the earlier slices. The carry
        has one row per slice of a cut key, at most twice ``MAX_SLICES``, which bounds
        the broadcast. Null where nothing comes before.
        """
        if not self.split:
            raise ValueError("rows were not split, so there is nothing to carry")
        source = self.rows if source is None else source
        earlier = (
            Window.partitionBy(*self.keys)
            .orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        summary = (
            source.where(self._of_cut_key())
            .groupBy(*self.keys, SLICE)
            .agg(*[agg.alias(name) for name, agg in partial.items()])
        )
        names = {k: f"__carry_{i}" for i, k in enumerate([*self.keys, SLICE])}
        carry = summary.select(
            *[F.col(k).alias(n) for k, n in names.items()],
            *[combine(name, earlier).alias(name) for name in partial],
        )
        match = _all_equal(names)
        # Rows are bounded, so without values of any length the bytes are as well.
        fixed = all(_fixed_width(f.dataType) for f in carry.schema)
        carry = F.broadcast(carry) if fixed else carry
        return local.join(carry, match, "left").drop(*names.values())


def _fixed_width(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_fixed_width(f.dataType) for f in kind)
    return not isinstance(kind, T.StringType | T.BinaryType | T.ArrayType | T.MapType)


def _all_equal(names: dict[str, str]) -> Column:
    """Null-safe equality of columns and their renamed twins."""
    condition = F.lit(True)
    for left, right in names.items():
        condition = condition & F.col(left).eqNullSafe(F.col(right))
    return condition


def slice_rows(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
    one_task_rows: int | None = None,
) -> SlicedRows:
    """Cut hot keys into slices along ``order`` (ascending, nulls first).

    Tied rows that would fill more than a slice are told apart by the hash of the whole row;
    only rows equal in every column then share a slice. Without keys all rows form one
    sequence, which is then cut into at least one slice per shuffle partition. ``df`` is
    read more than once and must give the same rows each time.
    """
    keys = list(keys)
    order = [c for c in order if c not in keys]
    one_task_rows = ONE_TASK_ROWS if one_task_rows is None else one_task_rows
    total = df.count()
    if keys and total <= rows_per_slice or not keys and total <= one_task_rows:
        return SlicedRows(df, keys, order, split=False)
    if not keys:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows_per_slice = min(rows_per_slice, -(-total // partitions))
    rows_per_slice = max(rows_per_slice, -(-total // MAX_SLICES))

    fraction = min(1.0, SAMPLES_PER_SLICE / rows_per_slice)
    step = max(1, round(rows_per_slice * fraction))
    cuts, number, tied = _cut_points(df, keys, order, fraction, step)
    if tied:
        hashable = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
        df = df.withColumn(TIE, F.xxhash64(*hashable))
        order = [*order, TIE]
        cuts, number, _ = _cut_points(df, keys, order, fraction, step)
    if number == 0:
        return SlicedRows(df, keys, order, split=False)
    rows = df.withColumn(SLICE, count_at_most(cuts, _point(keys, order), number))
    return SlicedRows(rows, keys, order, split=True, cuts=cuts)


def _point(keys: list[str], order: list[str]) -> Column:
    """A lone column is compared as it is, which is quicker; its nulls fall into slice 0."""
    return F.struct(*keys, *order) if keys or len(order) > 1 else F.col(order[0])


def _cut_points(
    df: DataFrame, keys: list[str], order: list[str], fraction: float, step: int
) -> tuple[Column, int, bool]:
    """The sorted cut points, their number, and whether one point was to be cut at twice.

    The sample has about SAMPLES_PER_SLICE * MAX_SLICES rows at most; every step-th of a
    key is a cut point, so a key without much data has none.
    """
    sample = df.select(*keys, _point(keys, order).alias(_POINT)).sample(fraction, seed=17)
    in_key = Window.partitionBy(*keys).orderBy(_POINT)
    chosen = (
        sample.withColumn("__n", F.row_number().over(in_key))
        .where(F.col("__n") % step == 0)
        .agg(F.array_sort(F.collect_set(_POINT)).alias("all"), F.count(F.lit(1)).alias("n"))
    )
    # As many marks as cut points were lost because they fell together.
    lost = F.array_repeat(F.lit(1), (F.col("n") - F.size("all")).cast("int"))
    every = F.greatest(F.ceil(F.octet_length(F.to_json("all")) / F.lit(MAX_CUT_BYTES)), F.lit(1))
    kept = F.filter("all", lambda c, i: i % every == 0)
    [(cuts, number), (_, ties)] = constant_arrays(
        chosen.select(kept.alias("cuts"), lost.alias("lost")), "cuts", "lost"
    )
    return cuts, number, ties > 0
