import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kinweave import operators as op

VISITS = [
    (1, "north", "oslo", "old"), (1, "north", "oslo", "old"), (1, "north", "oslo", "new"),
    (2, "north", "oslo", "new"), (3, "north", "umea", "port"), (1, "north", "umea", "port"),
    (4, "south", "rome", "hill"), (5, "south", "rome", "hill"), (5, "south", "rome", "bank"),
    (6, "south", "bari", "quay"), (4, "south", "bari", "quay"), (4, "south", "bari", "quay"),
]


def test_rollup_through_three_levels(spark):
    df = spark.createDataFrame(VISITS, "guid int, region string, city string, district string")
    district = op.bitmap_build(df, ["region", "city", "district"], "guid")
    city = op.bitmap_merge(district, ["region", "city"])
    region = op.bitmap_merge(city, ["region"])
    assert dict(rows(op.bitmap_cardinality(district, ["district"]))) == {
        "old": 1, "new": 2, "port": 2, "hill": 2, "bank": 1, "quay": 2,
    }
    # Adding up the districts would count 1 in oslo and 5 in rome twice.
    assert dict(rows(op.bitmap_cardinality(city, ["city"]))) == {"oslo": 2, "umea": 2, "rome": 2, "bari": 2}
    assert dict(rows(op.bitmap_cardinality(region, ["region"]))) == {"north": 3, "south": 3}


def test_only_whole_numbers(spark):
    df = spark.createDataFrame([(1.2,), (1.7,)], "v double")
    with pytest.raises(TypeError, match="whole numbers"):
        op.bitmap_build(df, [], "v")


def test_union_of_two_sets(spark):
    sets = [("a", v) for v in (1, 2, 4, 5, 6)] + [("b", v) for v in (1, 2, 3, 7, 8, 9)]
    df = spark.createDataFrame(sets, "s string, v int")
    both = op.bitmap_merge(op.bitmap_build(df, ["s"], "v"), [])
    assert op.bitmap_cardinality(both, []).first()[0] == 9


def test_union_of_string_sets(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "s string, v string")
    both = op.bitmap_merge(op.bitmap_build_strings(df, ["s"], "v"), [])
    assert op.bitmap_cardinality(both, []).first()[0] == 3


def test_extremes_negatives_and_nulls(spark):
    values = [0, -1, 1, 2**31 - 1, -(2**31), 32768, 32767, -32768, None, 0]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v int")
    assert rows(op.bitmap_cardinality(op.bitmap_build(df, ["k"], "v"), ["k"])) == [("k", 8)]


def test_equals_count_distinct_when_one_value_is_a_third(spark):
    draw = random.Random(2)
    data = [(i % 4, 5 if i % 3 == 0 else draw.randrange(-100_000, 100_000)) for i in range(5000)]
    df = spark.createDataFrame(data, "k int, v int")
    want = rows(df.groupBy("k").agg(F.countDistinct("v")))
    bitmaps = op.bitmap_build(df, ["k"], "v")
    assert rows(op.bitmap_cardinality(bitmaps, ["k"])) == want
    total = op.bitmap_cardinality(op.bitmap_merge(bitmaps, []), []).first()[0]
    assert total == len({v for _, v in data})
