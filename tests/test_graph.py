import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from kinweave import operators as op
from kinweave.operators import graph


def _union_find(edges, vertices):
    parent = {v: v for e in edges for v in e} | {v: v for v in vertices}

    def find(v):
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((v, find(v)) for v in parent)


def _components(spark, edges, vertices=(), **options):
    e = spark.createDataFrame(edges, "src bigint, dst bigint")
    v = spark.createDataFrame([(x,) for x in vertices], "id bigint")
    return sorted(tuple(r) for r in op.connected_components(e, v, **options).collect())


def test_pairs_keep_array_order(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["x"],), ([],), (None,)], "ids array<string>")
    got = op.pair_edges(df, key=F.ascii)
    a, b, c, d = (ord(x) for x in "abcd")
    assert [tuple(r) for r in got.collect()] == [(a, b), (a, c), (a, d), (b, c), (b, d), (c, d)]


def test_frequent_edges_respect_direction_and_threshold(spark):
    edges = [(1, 2)] * 3 + [(2, 1)] * 2 + [(5, 5)] * 4
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    assert rows(op.frequent_edges(df)) == [(1, 2, 3), (5, 5, 4)]


def test_one_pass_gives_the_same_vertices_and_edges(spark):
    draw = random.Random(4)
    data = [([draw.choice("abcdefgh") for _ in range(draw.randrange(5))],) for _ in range(300)]
    df = spark.createDataFrame(data, "ids array<string>")
    vertices, edges = op.vertices_and_edges(df)
    assert rows(vertices) == rows(op.id_vertices(df).select("id").distinct())
    assert rows(edges) == rows(op.frequent_edges(op.pair_edges(df)).drop("n"))


def test_chain_links_neighbours_after_dropping_blanks(spark):
    df = spark.createDataFrame([(["a", " ", "b", None, "c"],), (["x", ""],)], "fields array<string>")
    a, b, c = (ord(x) for x in "abc")
    assert rows(op.chain_edges(df, key=lambda s: F.ascii(s).cast("bigint"))) == [(a, b), (b, c)]


def test_components_of_small_shapes(spark):
    path = [(i, i + 1) for i in range(20)]
    star = [(100, i) for i in range(101, 120)]
    loops = [(500, 500), (-7, -3), (-3, -9), (-9, -7)]
    edges = path + star + loops
    assert _components(spark, edges, [900, 5]) == _union_find(edges, [900, 5])


def test_null_ends_drop_the_edge_and_keep_the_vertex(spark):
    assert _components(spark, [(None, 5), (7, None), (None, None), (1, 2)], [None, 9]) == [
        (1, 1), (2, 1), (5, 5), (7, 7), (9, 9),
    ]


def test_components_of_texts(spark):
    edges = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y"), (None, "z")], "src string, dst string")
    assert rows(op.connected_components(edges)) == [
        ("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z"),
    ]


def test_a_row_of_too_many_identifiers_fails(spark, monkeypatch):
    monkeypatch.setattr(graph, "MAX_IDS_PER_ROW", 3)
    df = spark.createDataFrame([(["a", "b", "c"],)], "ids array<string>")
    assert op.pair_edges(df).count() == 3
    with pytest.raises(Exception, match="too many identifiers"):
        op.pair_edges(df.select(F.concat("ids", "ids").alias("ids"))).collect()


def test_one_pass_gives_the_chain(spark):
    df = spark.createDataFrame(
        [(["a", " ", "b", None, "c"],), (["x", ""],), (["a"],), ([],)], "fields array<string>"
    )
    vertices, edges = op.chain_vertices_and_edges(df, key=lambda c: c)
    assert rows(vertices) == [("a",), ("c",), ("x",)] and rows(edges) == [("a", "b"), ("b", "c")]


def test_components_without_edges(spark):
    assert _components(spark, [], [3, 1]) == [(1, 1), (3, 3)]


@pytest.mark.parametrize("seed,n,m", [(1, 50, 30), (2, 400, 350), (3, 300, 1500)])
def test_components_of_random_graphs(spark, seed, n, m):
    draw = random.Random(seed)
    edges = [
        (draw.randrange(n) - n // 2, draw.randrange(n) * draw.choice([1, 2**40])) for _ in range(m)
    ]
    vertices = range(n + 10)
    assert _components(spark, edges, vertices) == _union_find(edges, vertices)


def test_hub_goes_the_hot_key_way(spark):
    draw = random.Random(8)
    hub = [(10_000, i) for i in range(300)] + [(i, -1) for i in range(0, 300, 2)]
    edges = hub + [(draw.randrange(2000, 3000), draw.randrange(2000, 3000)) for _ in range(400)]
    assert _components(spark, edges, rows_per_task=50) == _union_find(edges, [])
