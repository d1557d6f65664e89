import bisect
import random
import struct

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinweave.functions import (
    comma_fields,
    compare_to_range,
    contains_literal,
    count_at_most,
    is_nonblank,
    java_hash,
    tokens,
    url_host,
    within_seconds,
)


def _strings(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")


def _apply(spark, values, expression):
    df = _strings(spark, values).select("i", expression.alias("r"))
    return [r.r for r in sorted(df.collect(), key=lambda r: r.i)]


def test_tokens_follow_java_split(spark):
    texts = ["hello  cat", " lead", "trail ", "", "   ", "a\tb\n", "\x0b\f", None, " "]
    assert _apply(spark, texts, tokens("s")) == [
        ["hello", "cat"], ["", "lead"], ["trail"], [""], [], ["a", "b"], [], None, [],
    ]


def test_comma_fields_drop_trailing_empties_only(spark):
    texts = ["a,b,,", ",,", ",a", "a,,b", "", "a", ",", ",,,"]
    assert _apply(spark, texts, comma_fields("s")) == [
        ["a", "b"], [], ["", "a"], ["a", "", "b"], [""], ["a"], [], [],
    ]


def _jvm_hash(text):
    h = 0
    data = text.encode("utf-16-be")
    for (unit,) in struct.iter_unpack(">H", data):
        h = (h * 31 + unit) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=30), min_size=40, max_size=60))
def test_java_hash_of_any_text(spark, texts):
    texts += ["", "1", "刘德华", "😀a", "zzzzzzzzzzzzzzz", "𠀀"]
    assert _apply(spark, texts, java_hash("s")) == [_jvm_hash(t) for t in texts]


def test_java_hash_of_null_is_null(spark):
    assert _apply(spark, [None], java_hash("s")) == [None]


def test_blank_is_unicode_aware(spark):
    values = ["a", "", "  ", "\t", "　", None, " x"]
    assert _apply(spark, values, is_nonblank("s")) == [True, False, False, False, False, False, True]


def test_url_host(spark):
    urls = [
        "http://baidu.com/abc/x", "https://www.a.org", "a.b.c:8080/x", "", "/x", "http://[x]/",
    ]
    assert _apply(spark, urls, url_host("s")) == [
        "baidu.com", "a.org", "a.b.c", "none", "none", "http",
    ]


def test_contains_literal_is_no_pattern(spark):
    df = spark.createDataFrame([(["", "b"],), (["   ", "b"],)], "a array<string>")
    got = df.select(contains_literal("a", ""), contains_literal("a", r"\s+")).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False)]


def test_compare_to_range_includes_both_ends(spark):
    df = spark.createDataFrame([(9,), (10,), (50,), (100,), (101,)], "x int")
    got = df.select(compare_to_range("x", F.lit(10), F.lit(100))).collect()
    assert [r[0] for r in got] == [-1, 0, 0, 0, 1]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_within_ten_minutes(spark, kind):
    day = "2020-02-18 "
    pairs = [("14:20:00", "14:25:01"), ("14:20:00", "14:30:00"), ("14:20:00", "14:30:01"), ("14:20:00", "09:00:00")]
    df = spark.createDataFrame([(day + a, day + b) for a, b in pairs], "a string, b string")
    got = df.select(within_seconds(F.col("a").cast(kind), F.col("b").cast(kind))).collect()
    assert [r[0] for r in got] == [True, True, False, True]


def test_count_at_most_is_bisect(spark):
    draw = random.Random(3)
    for n in (0, 1, 2, 7, 8, 100):
        points = sorted(draw.sample(range(1000), n))
        probes = list(range(-1, 1001, 7)) + points
        df = spark.createDataFrame([(p,) for p in probes], "x int")
        array = F.array(*[F.lit(p) for p in points]).cast("array<int>")
        got = [r[0] for r in df.select(count_at_most(array, F.col("x"), max(n, 1))).collect()]
        assert got == [bisect.bisect_right(points, p) for p in probes]
