"""Numbered strings and containers against plain distinct counts."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kinweave import operators as op
from kinweave.operators import string_ids


def _strings(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_colliding_strings_count_apart(spark, tmp_path):
    # Two pairs of strings with one 32-bit hash each.
    df = spark.createDataFrame([("a", "Aa"), ("a", "BB"), ("a", "AaAa"), ("a", "BBBB"), ("b", "Aa"), ("b", None)], "k string, s string")
    ids = op.grow_string_ids(spark, str(tmp_path / "ids"), "one", df, "s")
    assert dict(rows(op.bitmap_cardinality(op.bitmap_build_exact(df, ["k"], "s", ids), ["k"]))) == {"a": 4, "b": 1}
    hashed = op.bitmap_cardinality(op.bitmap_build_strings(df, ["k"], "s"), ["k"])
    assert dict(rows(hashed))["a"] == 2


def test_old_ids_survive_and_new_ones_are_dense(spark, tmp_path):
    path = str(tmp_path / "ids")
    random.seed(1)
    seen = {}
    for day in range(3):
        values = [random.choice("xyzäß") + str(random.randint(0, 150)) for _ in range(120)] + [None]
        grown = dict(rows(op.grow_string_ids(spark, path, f"d{day}", _strings(spark, values), rows_per_slice=9)))
        assert seen.items() <= grown.items()
        assert sorted(grown.values()) == list(range(len(grown)))
        assert {v for v in values if v is not None} | set(seen) == set(grown)
        fresh = sorted(set(grown) - set(seen), key=str.encode)
        assert [grown[v] for v in fresh] == list(range(len(seen), len(grown)))
        seen = grown


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "ids")
    op.grow_string_ids(spark, path, "d1", _strings(spark, ["b", "a"]))
    want = rows(op.grow_string_ids(spark, path, "d2", _strings(spark, ["c"])))
    assert rows(op.grow_string_ids(spark, path, "d1", _strings(spark, ["zz", "a"]))) == want
    assert op.new_string_ids(op.read_string_ids(spark, path), _strings(spark, ["a", "c"])).count() == 0


def test_a_batch_that_died_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "ids")
    op.grow_string_ids(spark, path, "d1", _strings(spark, ["a"]))
    op.grow_string_ids(spark, path, "d2", _strings(spark, ["half"]))
    (tmp_path / "ids" / "batch=d2" / "_SUCCESS").unlink()
    assert rows(op.read_string_ids(spark, path)) == [("a", 0)]
    assert rows(op.grow_string_ids(spark, path, "d2", _strings(spark, ["b", "c"]))) == [("a", 0), ("b", 1), ("c", 2)]


def test_numbers_come_from_slices(spark, monkeypatch):
    monkeypatch.setattr("kinweave.plans.slices.ONE_TASK_ROWS", 10)
    seen = []
    whole = string_ids.row_position
    monkeypatch.setattr(string_ids, "row_position", lambda *a, **k: seen.append(whole(*a, **k)) or seen[-1])
    values = [f"v{k:04}" for k in range(500)]
    none = spark.createDataFrame([], string_ids.STRING_IDS_SCHEMA)
    got = op.new_string_ids(none, _strings(spark, values), rows_per_slice=40)
    assert rows(got) == [(v, k) for k, v in enumerate(values)]
    assert "__slice" in seen[0]._jdf.queryExecution().analyzed().toString()


def test_a_string_without_number_fails(spark):
    none = spark.createDataFrame([], string_ids.STRING_IDS_SCHEMA)
    with pytest.raises(Exception, match="has no number"):
        op.bitmap_build_exact(_strings(spark, ["x"]), [], "value", none).collect()


def _members(seed):
    random.seed(seed)
    out = [("a", "p", v) for v in range(-50, 5000)] + [("a", "q", v) for v in range(4000, 7100)]
    out += [("a", "r", random.randrange(10**12)) for _ in range(300)]
    out += [("b", "p", v) for v in range(0, 4000, 2)] + [("b", "q", v) for v in range(1, 4000, 2)]
    out += [(None, "p", 7), (None, "q", 7), ("c", "p", None), ("c", "q", 2**40)]
    return out * 2


def test_containers_count_exactly_over_both_kinds(spark):
    data = _members(4)
    df = spark.createDataFrame(data, "k string, part string, v bigint")
    fine = op.container_build(df, ["k", "part"], "v")
    coarse = op.container_merge(fine, ["k"])

    def distinct(*names):
        return rows(df.where("v IS NOT NULL").groupBy(*names).agg(F.countDistinct("v").alias("n")))

    assert rows(op.container_cardinality(fine, ["k", "part"])) == distinct("k", "part")
    assert rows(op.container_cardinality(coarse, ["k"])) == distinct("k")
    assert rows(op.container_cardinality(op.container_merge(coarse, []), [])) == distinct()
    for c in [*fine.collect(), *coarse.collect()]:
        # Dense from 2,048 members on, sparse and sorted below.
        assert (c.bitmap is None) == (c.n < 2048) and (c.places is None) == (c.n >= 2048)
        assert c.places is None or (c.places == sorted(set(c.places)) and len(c.places) == c.n)
    # Two halves of 2,000 each are sparse by themselves and dense together; 0 is in a bucket before.
    assert {c.bitmap is None for c in fine.where("k = 'b'").collect()} == {True}
    assert [c.n for c in coarse.where("k = 'b' AND bitmap IS NOT NULL").collect()] == [3999]


def test_sparse_columns_take_two_bytes_a_member(spark):
    sparse = spark.range(2000).select((F.col("id") * 100_003).alias("v"))
    dense = spark.range(200_000).select(F.col("id").alias("v"))
    one = op.container_bytes(op.container_build(sparse, [], "v")).first()
    assert (one.stored_bytes, one.plain_bytes) == (2 * 2000, 2000 * 4096)
    many = op.container_bytes(op.container_build(dense, [], "v")).first()
    assert many.stored_bytes <= many.plain_bytes == 4096 * 8


def test_empty_containers(spark):
    df = spark.createDataFrame([(None, None)], "k string, v int")
    none = op.container_build(df, ["k"], "v")
    assert none.count() == 0 and op.container_merge(none, []).count() == 0
    assert op.container_bytes(none).first().stored_bytes == 0
    with pytest.raises(TypeError, match="whole numbers"):
        op.container_build(spark.createDataFrame([(1.5,)], "v double"), [], "v")
