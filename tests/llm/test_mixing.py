import math

import duckdb
import pytest
from pyspark.sql import functions as F

from kinweave.llm import mixing as op
from kinweave.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id bigint, source string, copy int, weight double"


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duck.execute(ORACLES["op10_poisson_mix"]).fetchall())
    df = QUERIES["op10_poisson_mix"](spark, sf)
    columns = [c[0] for c in duck.description]
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == want


@pytest.mark.parametrize("mean", [0.0, 0.03, 1.0, 7.5, 16.0])
def test_inverse_is_the_quantile(spark, mean):
    us = [0.0, 1e-9, 0.2, 0.5, 0.9, 0.999999, 1 - 2**-52]
    df = spark.createDataFrame([(u, mean) for u in us], "u double, m double")
    got = [r[0] for r in df.select(op.inverse_poisson(F.col("u"), F.col("m"))).collect()]
    for u, k in zip(us, got, strict=True):
        p = [math.exp(-mean) * mean**i / math.factorial(i) for i in range(k + 1)]
        assert u < math.fsum(p) + 1e-15 and (k == 0 or u >= math.fsum(p[:-1]) - 1e-15)


def test_sources_meet_their_weights(spark):
    rows = [(i, "hot" if i % 3 else ("rare" if i % 60 == 0 else "mid"), 0, 0.0) for i in range(30_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame([("hot", 1.0), ("rare", 1.0), ("mid", 2.0)], "source string, weight double")
    found = {r[0]: r[1] for r in op.mix(docs, weights).groupBy("source").count().collect()}
    for source, want in (("hot", 7500), ("rare", 7500), ("mid", 15_000)):
        n = sum(r[1] == source for r in rows)
        assert abs(found[source] - want) < 5 * math.sqrt(want * max(1, want / n))


def test_salted_join_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 7}", 0, 0.0) for i in range(500)], SCHEMA)
    weights = op.root_weights(docs)
    near = sorted(op.mix(docs, weights).collect())
    monkeypatch.setattr(op, "fits_broadcast", lambda df: False)
    assert sorted(op.mix(docs, weights).collect()) == near


def test_odd_rows(spark):
    rows = [(1, "a", 9, None), (1, "a", 9, None), (None, None, 9, 1.0), (3, "z", 9, 1.0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    weights = spark.createDataFrame(
        [("a", 40.0), ("a", 10.0), (None, 50.0), ("z", -1.0), ("none", 5.0)], "source string, weight double"
    )
    out = op.mix(docs, weights, total=400).collect()
    by = {(r.doc_id, r.copy): 0 for r in out}
    for r in out:
        by[(r.doc_id, r.copy)] += 1
    assert set(out[0].asDict()) == {"doc_id", "source", "copy", "weight", "order_key"}
    assert {k[0] for k in by} == {1, None}
    assert all(n == (2 if k[0] == 1 else 1) for k, n in by.items())
    assert abs(len(out) - 400) < 120
    assert op.mix(docs.limit(0), weights).count() == 0
    assert op.mix(docs, weights.limit(0)).count() == 0
