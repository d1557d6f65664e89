import hashlib
import math
import random
import re
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from kinweave.llm import importance as op

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id bigint, text string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def runs(text, max_n):
    w = words(text)
    return [" ".join(w[i : i + n]).encode() for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, max_n=1, buckets=10_000, seed=2024, percent=10, min_words=20):
    """The draw by whole n-grams and one sort."""

    def counts(texts):
        total = [0] * buckets
        for t in texts:
            for r in runs(t, max_n):
                total[crc32(r) % buckets] += 1
        return total

    s, t = counts(x for _, x in docs), counts(target)
    S, T = sum(s), sum(t)
    gain = [
        math.floor(1000 * math.log((b + 1) * (S + buckets) / ((a + 1) * (T + buckets))))
        for a, b in zip(s, t, strict=True)
    ]
    out, fit = [], []
    for doc_id, text in docs:
        found = runs(text, max_n)
        weight = sum(gain[crc32(r) % buckets] for r in found)
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([doc_id, len(found), weight, score, None])
        if score is not None and len(words(text)) >= min_words:
            fit.append(out[-1])
    fit.sort(key=lambda r: (-r[3], r[0]))
    for k, row in enumerate(fit[: percent * len(fit) // 100]):
        row[4] = k + 1
    return sorted((tuple(r) for r in out), key=repr)


def ranks(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@given(st.lists(st.binary(min_size=1, max_size=9).map(lambda b: b.replace(b" ", b"x")), max_size=12), st.integers(1, 4))
def test_run_crcs_equal_direct_ones(some, max_n):
    for n, found in enumerate(op.ngram_crcs(some, max_n), 1):
        assert found.tolist() == [crc32(b" ".join(some[i : i + n])) for i in range(len(some) - n + 1)]


def test_long_runs_shift_by_powers():
    some = [bytes([97 + i]) * size for i, size in enumerate([1, 255, 256, 257, 70_000, 3, 511])]
    for n, found in enumerate(op.ngram_crcs(some, 4), 1):
        assert found.tolist() == [crc32(b" ".join(some[i : i + n])) for i in range(len(some) - n + 1)]


@pytest.mark.parametrize("max_n", [1, 3])
def test_pieces_of_a_long_text(monkeypatch, max_n):
    random.seed(3)
    text = " ".join("".join(random.choices("abÉß9-", k=random.randint(1, 12))) for _ in range(400))
    whole = [b for _, found in op.text_buckets(text, max_n, 997) for b in found.tolist()]
    monkeypatch.setattr(op, "_PIECE", 23)
    pieces = list(op.text_buckets(text, max_n, 997))
    assert len(pieces) > 20 and sum(n for n, _ in pieces) == len(words(text))
    assert sorted(b for _, found in pieces for b in found.tolist()) == sorted(whole)
    assert sorted(whole) == sorted(crc32(r) % 997 for r in runs(text, max_n))


def corpus(n=300):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Éa", "ß", "B2"]
    return [(i, " ".join(random.choices(vocabulary, k=random.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("settings", [{}, {"max_n": 3, "buckets": 101, "percent": 35, "seed": 7}])
def test_draw_equals_plain_sort(spark, settings):
    docs, target = corpus(), [t for _, t in corpus(40)]
    got = op.importance_ranks(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame([(t,) for t in target], "text string"), **settings
    )
    assert ranks(got) == plain(docs, target, **settings)


def test_draw_over_slices(spark, monkeypatch):
    monkeypatch.setattr(op, "_RANKED_PER_TASK", 5)
    docs, target = corpus(400), ["w1 w2 w3"]
    df = spark.createDataFrame(docs, DOCS).repartition(7)
    got = op.importance_ranks(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=50)
    assert ranks(got) == plain(docs, target, percent=50)


def test_bad_quantile_still_gives_the_whole_draw(spark, monkeypatch):
    monkeypatch.setattr(op, "_MARGIN", -0.08)
    docs = corpus()
    got = op.importance_ranks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([("w1",)], "text string"))
    assert ranks(got) == plain(docs, ["w1"])


def test_drawn_rows_keep_their_columns(spark):
    docs = [(i, t, float(i), f"s{i}", None) for i, t in corpus()]
    schema = f"{DOCS}, weight double, score string, rank void"
    target = spark.createDataFrame([("w1 w2",)], "text string")
    df = spark.createDataFrame([r[:4] for r in docs], "doc_id bigint, text string, weight double, score string")
    df = df.selectExpr("*", "null as rank")
    assert df.schema.simpleString() == f"struct<{','.join(c.strip().replace(' ', ':') for c in schema.split(','))}>"
    want = {r[0] for r in plain([r[:2] for r in docs], ["w1 w2"]) if r[4]}
    got = op.resample(df, target)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} == {r for r in docs if r[0] in want}


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, " .,;\x00"), (None, long), (4, long), (4, long), (4, long + " y"), (5, "ÀÉ " * 20)]
    target = [None, "", "x1 x2"]
    some = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(t,) for t in target], "text string")
    assert ranks(op.importance_ranks(*some, percent=60)) == plain(docs, target, percent=60)
    assert ranks(op.importance_ranks(some[0], some[1].limit(0))) == plain(docs, [])
    assert op.importance_ranks(some[0].limit(0), some[1]).count() == 0
    assert op.resample(some[0].limit(0), some[1]).count() == 0
    texts = spark.createDataFrame([("a", long), ("b", long)], "doc_id string, text string")
    assert {r.doc_id for r in op.resample(texts, some[1], percent=100).collect()} == {"a", "b"}


def test_draw_leans_to_the_target(spark):
    random.seed(11)
    near, far = [f"n{i}" for i in range(50)], [f"f{i}" for i in range(50)]
    docs = [(i, " ".join(random.choices(near if i % 10 == 0 else far, k=40))) for i in range(1000)]
    target = spark.createDataFrame([(" ".join(near),)], "text string")
    drawn = {r.doc_id for r in op.resample(spark.createDataFrame(docs, DOCS), target).collect()}
    assert len(drawn) == 100 and sum(i % 10 == 0 for i in drawn) >= 95


def test_gains_are_floors():
    assert op.bucket_gains(np.array([3, 0]), np.array([0, 3])).tolist() == [
        math.floor(1000 * math.log(1 * 5 / (4 * 5))),
        math.floor(1000 * math.log(4 * 5 / (1 * 5))),
    ]
