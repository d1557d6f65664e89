"""Day-to-day identity mapping and support pruning against the operators they stand in for."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kinweave import operators as op
from kinweave import sources as src
from kinweave.functions import java_hash, wide_key
from kinweave.operators import incremental, pruning

DICTIONARY = "biaoshi_hashcode string, guid string"


def text(c):
    return c


def _day(spark, lists):
    return [spark.createDataFrame([(x,) for x in part], "ids array<string>") for part in (lists[::2], lists[1::2])]


def _lists(names, n, seed):
    random.seed(seed)
    pool = [random.sample(names, random.randint(1, 3)) for _ in range(n)]
    return [random.choice(pool) for _ in range(4 * n)]


@pytest.mark.parametrize("seed", range(2))
def test_three_days_equal_the_rolling_mapping(spark, seed):
    days = [_day(spark, _lists([f"v{k}" for k in range(10 * d, 10 * d + 40)], 25, 10 * seed + d)) for d in range(3)]
    base = whole = steps = op.id_mapping(days[0], key=text)
    deltas = []
    for day in days[1:]:
        whole = op.id_mapping_rolling(day, whole, key=text)
        delta = op.id_mapping_delta(day, steps, key=text)
        deltas.append(delta)
        before = {r.biaoshi_hashcode: r.guid for r in steps.collect()}
        steps = op.apply_delta(steps, delta)
        assert rows(steps) == rows(whole)
        assert not {r.biaoshi_hashcode for r in delta.added.collect()} & set(before)
        for r in delta.moved.collect():
            assert r.new_guid < r.guid and {r.guid, r.new_guid} <= set(before.values())
    assert deltas[0].moved.count() + deltas[1].moved.count() > 0
    assert rows(op.apply_delta(base, op.merge_deltas(deltas))) == rows(whole)


def test_rounds_read_touched_persons_only(spark, monkeypatch):
    old = [(f"p{k}-{j}", f"p{k}-0") for k in range(200) for j in range(5)]
    previous = spark.createDataFrame(old, DICTIONARY)
    today = _day(spark, [["p3-4", "p7-2"]] * 4 + [["p9-1", "new"]] * 4 + [["p11-1", "p11-2"]] * 4 + [["rare", "p5-1"]] * 2)
    seen = []
    whole = incremental.connected_components
    monkeypatch.setattr(incremental, "connected_components", lambda e: seen.append(rows(e)) or whole(e))
    got = dict(rows(op.id_mapping_incremental(today, previous, key=text)))
    assert [sorted({v for pair in edges for v in pair}) for edges in seen] == [["new", "p3-0", "p7-0", "p9-0"]]
    assert got == {**dict(old), **{f"p7-{j}": "p3-0" for j in range(5)}, "new": "p9-0", "rare": "rare"}


def test_the_dictionary_is_not_shuffled(spark):
    previous = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("biaoshi_hashcode"), F.lit("k0").alias("guid"))
    ids = spark.createDataFrame([("k1",), ("x",)], "id string")
    plan = incremental._known_ids(ids, previous)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_a_bucketed_dictionary_stays_in_its_buckets(spark, tmp_path, monkeypatch):
    previous = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("biaoshi_hashcode"), F.lit("k0").alias("guid"))
    stored = src.write_bucketed(previous, "kinweave_previous", str(tmp_path / "d"), "biaoshi_hashcode", 16)
    spark.sql("DROP TABLE kinweave_previous")
    monkeypatch.setattr(incremental, "fits_broadcast", lambda df: False)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        ids = spark.createDataFrame([("k1",), ("x",)], "id string")
        found = incremental._known_ids(ids, stored)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
        assert rows(found) == [("k1", "k0")]
    finally:
        spark.conf.set(threshold, before)


def test_empty_days_and_dictionaries(spark):
    none = spark.createDataFrame([], DICTIONARY)
    day = _day(spark, [["a", "b"]] * 3 + [["c"], []])
    assert rows(op.id_mapping_incremental(day, none, key=text)) == [("a", "a"), ("b", "a"), ("c", "c")]
    old = spark.createDataFrame([("a", "a"), ("b", "a")], DICTIONARY)
    assert rows(op.id_mapping_incremental(_day(spark, [[], []]), old, key=text)) == [("a", "a"), ("b", "a")]


@pytest.mark.parametrize("key", [java_hash, wide_key, text])
def test_a_line_is_parsed_once_whatever_the_key(spark, key):
    lines = spark.createDataFrame([('{"user": {"uid": "u"}}',)], "value string")
    ids = op.union_logs(*[op.extract_ids(lines).select("ids") for _ in range(3)])
    for edges in (op.pair_edges(ids, key=key), op.chain_edges(ids, fields="ids", key=key)):
        plan = edges._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") + plan.count("jsontostructs") == 3


def _rows_of_ids(seed=5, n=600):
    random.seed(seed)
    common = [f"c{k}" for k in range(8)]
    out = []
    for k in range(n):
        some = random.sample(common, random.randint(0, 3)) + [f"r{random.randint(0, 40 * n)}" for _ in range(3)]
        if k % 9 == 0:
            some += [some[0]] * 2 + [None, None]
        out.append(some)
    return out + [["x", "y", "y", "y"], []]


@pytest.mark.parametrize("width", [1, 50, 1 << 20])
def test_pruned_pairs_equal_all_pairs(spark, width):
    df = spark.createDataFrame([(x,) for x in _rows_of_ids()], "ids array<string>")
    want = rows(op.frequent_edges(op.pair_edges(df, key=text)))
    assert rows(op.frequent_pairs(df, key=text, width=width)) == want and len(want) > 20


def test_errors_of_the_sketch_are_one_sided(spark):
    """No end of a frequent edge is ever pruned, and a wide sketch prunes nearly all the rest."""
    data = _rows_of_ids()
    df = spark.createDataFrame([(x,) for x in data], "ids array<string>")
    hashed = pruning._keys(df, "ids", text)
    ends = {v for r in op.frequent_edges(op.pair_edges(df, key=text)).collect() for v in (r.src, r.dst)}
    for width in (50, 1 << 16):
        kept = pruning.keep_frequent(hashed, pruning.frequent_cells(hashed, 2, width=width), width)
        left = [r[0] for r in kept.collect()]
        assert sum(map(len, left)) <= sum(map(len, data)) and ends <= {v for x in left for v in x}
    pairs = lambda some: sum(len(x) * (len(x) - 1) // 2 for x in some)
    assert pairs(left) < pairs(data) / 2


def test_more_identifiers_than_counters_are_pruned_all_the_same(spark, monkeypatch):
    """A full sketch prunes nothing; counts by hash do, and pairs go by their own counts."""
    data = _rows_of_ids()
    df = spark.createDataFrame([(x,) for x in data], "ids array<string>")
    counted, whole = [], pruning.frequent_edges
    monkeypatch.setattr(pruning, "frequent_edges", lambda p, n: counted.append(p.count()) or whole(p, n))
    got = rows(op.frequent_pairs(df, key=text, width=50))
    assert got == rows(whole(op.pair_edges(df, key=text)))
    frequent = sum(r[2] for r in got)
    assert frequent <= counted[0] < 1.2 * frequent < sum(len(x) * (len(x) - 1) // 2 for x in data) / 2


def test_a_filter_that_is_too_small_loses_no_hash(spark):
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h"), F.lit(3).alias("w"))
    heavy = pruning.heavy_filter(hashes, 2, max_rows=1)
    assert heavy.words == 8 and pruning.keep_heavy(hashes, F.col("h"), heavy).count() == 3000
    assert pruning.keep_heavy(hashes, F.col("h"), pruning.heavy_filter(hashes, 3)).count() == 0


def test_long_rows_count_by_what_is_left_of_them(spark):
    def pairs(rare, common):
        row = [f"r{k}" for k in range(rare)] + [f"c{k}" for k in range(common)]
        df = spark.createDataFrame([(row,)] + [(["c0", "c1"],)] * 3, "ids array<string>").repartition(2)
        others = spark.createDataFrame([([f"c{k}"],) for k in range(common)] * 2, "ids array<string>")
        return rows(op.frequent_pairs(df.unionByName(others), key=text, width=50))

    assert pairs(2100, 3) == [("c0", "c1", 4)]
    with pytest.raises(Exception, match="too many identifiers in one row: 2100"):
        pairs(0, 2100)


def test_shuffle_files_do_not_outlive_a_step(spark):
    from kinweave.plans import storage

    before = spark.conf.get(storage._SHUFFLE_CLEANUP, None)
    with storage.dropping_shuffles(spark):
        assert spark.conf.get(storage._SHUFFLE_CLEANUP) == "true"
    assert spark.conf.get(storage._SHUFFLE_CLEANUP, None) == before
