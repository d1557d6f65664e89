import hashlib
import math
import random
from unittest import mock

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kinweave.llm import vector_codes as op

TABLE = "vec_id bigint, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """Quantisation in plain Python, part by part and entry by entry."""
    kept = [
        (i, [math.floor(1024 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    d = len(first[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def assign(v, p):
        far = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        groups = [[[] for _ in books[p]] for p in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                groups[p][assign(v, p)[0]].append(cut(v, p))
        books = [
            [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else e for g, e in zip(groups[p], books[p], strict=True)]
            for p in range(parts)
        ]
    out = []
    for i, v, label in kept:
        found = [assign(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in found), sum(e for _, e in found), label))
    total = {}
    for _, _, e, label in out:
        total[label] = total.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], digest) for i, c, e, label in out), key=repr)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n=120, d=8, seed=1):
    random.seed(seed)
    single = [[float(np.float32(random.choice([random.gauss(0, 0.2), 0.125, -0.5]))) for _ in range(d)] for _ in range(n)]
    return [(n - i, random.choice(single), random.choice([None, 1, 2, 3])) for i in range(2 * n)]


@pytest.mark.parametrize("settings", [{}, {"entries": 9, "rounds": 2, "parts": 2}, {"rounds": 0}])
def test_equals_plain_quantisation(spark, settings):
    rows = vectors()
    df = spark.createDataFrame(rows, TABLE).repartition(5)
    assert collected(op.compress_vectors(df, **settings)) == plain(rows, **settings)


def test_small_tries_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(op, "_LEAVES", 3)
    monkeypatch.setattr(op, "_VECTORS_PER_TRIE", 11)
    rows = vectors(seed=4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert collected(op.compress_vectors(spark.createDataFrame(rows, TABLE), entries=20)) == plain(rows, entries=20)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


numbers = st.lists(st.lists(st.integers(-3, 3), min_size=5, max_size=5), min_size=1, max_size=40)


@given(numbers, numbers, st.sampled_from([1, 1 << 24]), st.sampled_from([1, 2, 5, 512]))
def test_trie_distances_are_exact(parts, entries, scale, block):
    with mock.patch.object(op, "_LEAVES", block):
        check_distances(parts, entries, scale)


def check_distances(parts, entries, scale):
    leaves, place, counts = op.sorted_parts(np.array(parts) * scale)
    assert [tuple(r) for r in leaves.tolist()] == sorted({tuple(scale * x for x in p) for p in parts})
    assert (leaves[place] == np.array(parts) * scale).all() and counts.sum() == len(parts)
    best, error = op.nearest(leaves, np.array(entries) * scale)
    for leaf, b, e in zip(leaves.tolist(), best.tolist(), error.tolist(), strict=True):
        far = [sum((x - scale * y) ** 2 for x, y in zip(leaf, entry, strict=True)) for entry in entries]
        assert e == min(far) and b == far.index(e)


def test_shared_prefixes_are_counted_once(monkeypatch):
    """Levels above the last hold one row per prefix, not one per leaf."""
    seen = []
    whole = np.flatnonzero
    monkeypatch.setattr(op.np, "flatnonzero", lambda x: seen.append(len(found := whole(x))) or found)
    leaves = np.array([[1, 2, k] for k in range(10)] + [[1, 3, k] for k in range(10)])
    op._distances(leaves, leaves[:4], np.zeros(4, np.int64))
    assert seen == [1, 2, 20]


def test_subtrees_are_entered_in_order():
    leaves = np.array([[0, 0], [0, 1], [1, 0], [2, 0], [2, 1], [2, 2], [2, 3], [3, 0]])
    with mock.patch.object(op, "_LEAVES", 3):
        assert op._subtrees(leaves, 0) == [(0, 3, False), (3, 7, True), (7, 8, False)]


def test_vectors_come_back(spark):
    rows = [(i, [float(i % 3), 0.5, -0.25, float(i % 3)] * 2, 1) for i in range(50)]
    df = spark.createDataFrame(rows, TABLE)
    books = op.train_codebooks(df)
    back = {r.vec_id: r.vector for r in op.decode(op.encode(df, books), books).collect()}
    assert back == {i: v for i, v, _ in rows}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(3, [0.1, -0.2, 0.3, 0.4], None), (2, [1.0, 0.0, 0.0, -1.0], None), (None, [0.5] * 4, 7), (3, [0.1, -0.2, 0.3, 0.4], 7)]
    bad = [(1, None, 1), (1, [0.1, None, 0.3, 0.4], 1), (1, [nan, 0.0, 0.0, 0.0], 1), (0, [0.0, -inf, 0.0, 0.0], 1)]
    good = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in good]
    odd = [(0, [], 1), (9, [0.5] * 8, 1), (9, [0.5] * 3, 1)]
    df = spark.createDataFrame(good + bad + odd, TABLE)
    assert collected(op.compress_vectors(df)) == plain(good)
    assert op.compress_vectors(df.limit(0)).count() == 0
    assert op.compress_vectors(spark.createDataFrame(bad, TABLE)).count() == 0
    wide = df.selectExpr("*", "'x' as code", "1.5 as error", "null as part", "'k' as key")
    assert op.encode(wide, op.train_codebooks(df)).columns == ["vec_id", "label", "part", "key", "code", "error"]
    assert collected(op.compress_vectors(wide)) == plain(good)
    with pytest.raises(Exception, match="too large"):
        op.compress_vectors(spark.createDataFrame([(1, [1e9] * 4, 1)], TABLE)).collect()
