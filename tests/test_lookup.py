import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kinweave import operators as op
from kinweave.plans.joins import fits_broadcast, lookup_join, shuffled_lookup


# Fixed values in the tests below: the intervals (10-100, 110-200, 220-350) and the sorted list
# (1, 2, 3, 4, 5, 6, 8, 19, 20, 32) are those whose results have to match.


def _bands(spark, triples):
    return spark.createDataFrame(triples, "start_ip bigint, end_ip bigint, f1 string")


WAYS = {
    "between": op.range_lookup,
    "search": op.range_lookup_asof,
    "merged": op.range_lookup_merged,
}
ARGS = ("x", "start_ip", "end_ip", ["f1"])


@pytest.mark.parametrize("way", WAYS)
def test_interval_ends_holes_and_outside(spark, way):
    bands = _bands(
        spark,
        [(10, 100, "a"), (110, 200, "b"), (220, 350, "c"), (None, 999, "x"), (500, None, "y")],
    )
    values = spark.createDataFrame(
        [(x,) for x in (9, 10, 100, 105, 110, 220, 350, 400, None)], "x bigint"
    )
    got = WAYS[way](values, bands, *ARGS)
    assert {r.x: (r.f1, r.position) for r in got.collect()} == {
        9: (None, -1), 10: ("a", 0), 100: ("a", 0), 105: (None, -1), 110: ("b", 1),
        220: ("c", 2), 350: ("c", 2), 400: (None, -1), None: (None, -1),
    }


@pytest.mark.parametrize("rows_per_slice", [30, 1_000_000])
def test_all_ways_agree_when_one_value_is_a_third(spark, rows_per_slice):
    draw = random.Random(5)
    edges = sorted(draw.sample(range(5000), 400))
    bands = _bands(spark, [(a, b, f"{a}") for a, b in zip(edges[::2], edges[1::2])])
    values = [(i, 777 if i % 3 == 0 else draw.randrange(-10, 5010)) for i in range(2000)]
    values = spark.createDataFrame(values, "id int, x bigint")
    want = rows(op.range_lookup(values, bands, *ARGS))
    assert rows(op.range_lookup_asof(values, bands, *ARGS)) == want
    merged = op.range_lookup_merged(
        values, bands, *ARGS, rows_per_slice=rows_per_slice, one_task_rows=0
    )
    assert rows(merged) == want
    # Beyond the bound of each way the next one takes over.
    assert rows(op.range_lookup(values, bands, *ARGS, max_rows=10)) == want
    assert rows(op.range_lookup_asof(values, bands, *ARGS, max_rows=10)) == want


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize("more", [0, 98, 99])
def test_overlapping_intervals_fail_at_every_size(spark, way, more):
    # 100 intervals still go the BETWEEN way, 101 do not.
    apart = [(1000 + 10 * i, 1005 + 10 * i, "c") for i in range(more)]
    bands = _bands(spark, [(10, 100, "a"), (100, 200, "b"), *apart])
    values = spark.createDataFrame([(150,)], "x bigint")
    with pytest.raises(Exception, match="not disjoint"):
        WAYS[way](values, bands, *ARGS).collect()


@pytest.mark.parametrize("way", WAYS)
@pytest.mark.parametrize(
    "x_type,bound_type,bounds,hits",
    [
        ("double", "bigint", [("0", "100"), ("110", "200")],
         {"-0.5": -1, "0": 0, "100": 0, "100.5": -1, "110": 1, "200": 1, "200.7": -1, None: -1}),
        ("timestamp", "date", [("2020-01-01", "2020-01-02"), ("2020-02-01", "2020-02-03")],
         {"2020-01-02 00:00:00": 0, "2020-01-02 12:00:00": -1, "2020-02-02 12:00:00": 1, None: -1}),
        ("decimal(10,2)", "bigint", [("0", "100")], {"-0.01": -1, "99.99": 0, "100.01": -1, None: -1}),
        ("bigint", "decimal(10,2)", [("0.50", "2.50")], {"0": -1, "1": 0, "2": 0, "3": -1}),
        ("int", "double", [("0.5", "2.5")], {"0": -1, "1": 0, "2": 0, "3": -1}),
    ],
)
def test_comparison_is_that_of_between(spark, way, x_type, bound_type, bounds, hits):
    bands = spark.createDataFrame([(a, b, "f") for a, b in bounds], "a string, b string, f1 string")
    bands = bands.select(
        F.col("a").cast(bound_type).alias("start_ip"), F.col("b").cast(bound_type).alias("end_ip"), "f1"
    )
    values = spark.createDataFrame([(t,) for t in hits], "t string")
    values = values.withColumn("x", F.col("t").cast(x_type))
    got = WAYS[way](values, bands, *ARGS)
    assert {r.t: r.position for r in got.collect()} == hits
    assert [f.dataType for f in got.schema][:2] == [f.dataType for f in values.schema]


@pytest.mark.parametrize("way", WAYS)
def test_empty_dictionary(spark, way):
    values = spark.createDataFrame([(1,)], "x bigint")
    assert rows(WAYS[way](values, _bands(spark, []), *ARGS)) == [(1, None, -1)]


def test_position_lookup(spark):
    listed = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 6, 8, 19, 20, 32)], "v int")
    values = spark.createDataFrame([(32,), (1,), (7,), (None,)], "v int")
    assert rows(op.position_lookup(values, listed, "v"), "v", "position") == [
        (1, 0), (32, 9), (7, -1), (None, -1),
    ]


def test_keyed_lookup_last_line_wins_and_misses_are_text(spark):
    big = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "id int, s string")
    small = spark.createDataFrame(
        [(1, "old", 1), (1, "new", 2), (2, "two", 3)], "id int, name string, line int"
    )
    got = op.keyed_lookup(big, small, "id", "name", "line")
    assert rows(got, "id", "s", "name") == [
        (1, "x", "new"), (2, "y", "two"), (3, "z", "null"), (None, "n", "null"),
    ]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_keyed_lookup_without_order_wants_unique_keys(spark):
    big = spark.createDataFrame([(1,)], "id int")
    small = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert rows(op.keyed_lookup(big, small, "id", "name")) == [(1, "a")]
    with pytest.raises(ValueError, match="occurs 2 times"):
        op.keyed_lookup(big, small.union(small), "id", "name")


def test_keyed_lookup_of_numbers_null_orders_and_ties(spark):
    big = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "id int")
    small = spark.createDataFrame(
        [(1, 10, None), (2, 5, None), (2, 7, 1), (3, 8, 1), (3, 9, 1), (None, 1, 1), (None, 2, 2)],
        "id int, v int, line int",
    )
    got = op.keyed_lookup(big, small, "id", "v", "line")
    assert rows(got) == [(1, "10"), (2, "7"), (3, "9"), (4, "null"), (None, "null")]
    number = op.keyed_lookup(big, small, "id", "v", "line", miss=-1)
    assert rows(number) == [(1, 10), (2, 7), (3, 9), (4, -1), (None, -1)]
    unique = small.where("id IS NULL OR v IN (10, 7, 9)")
    assert rows(op.keyed_lookup(big, unique, "id", "v", miss=None))[:3] == [(1, 10), (2, 7), (3, 9)]


def test_size_check_measures_rows_and_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 10, "s string")
    assert fits_broadcast(df)
    assert not fits_broadcast(df, max_rows=9)
    assert not fits_broadcast(df, max_bytes=10_000)


def test_hot_keys_of_a_large_lookup_are_joined_like_all_others(spark):
    draw = random.Random(9)
    data = [(i, [7, None, draw.randrange(500)][i % 3]) for i in range(3000)]
    left = spark.createDataFrame(data, "id int, k int")
    right = spark.range(0, 400).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("w"))
    want = rows(left.join(right, "k", "left"), "id", "k", "w")
    split = shuffled_lookup(left, right, ["k"], rows_per_task=200)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    # One pass over each side: the hot keys come out of storage.
    assert "__salt" in plan and "Union" not in plan and plan.count("LogicalRDD") == 1
    assert rows(split, "id", "k", "w") == want
    assert rows(lookup_join(left, right, ["k"], max_rows=10), "id", "k", "w") == want
