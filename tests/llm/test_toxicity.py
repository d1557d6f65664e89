import math

import numpy as np
import pytest

from kinweave.llm import toxicity as op
from kinweave.llm.text import crc_remainder


def plain_ftrl(rows, labels, count, opt, boost):
    """Algorithm 1 of McMahan et al., one coordinate at a time; the bias (0) has no L1."""
    z, n = [0.0] * count, [0.0] * count

    def weight(i):
        l1 = 0.0 if i == 0 else opt.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((opt.beta + math.sqrt(n[i])) / opt.alpha + opt.l2)

    for _ in range(opt.epochs):
        for row, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in row}
            p = 1 / (1 + math.exp(-sum(w.values())))
            g = (p - y) * (boost if y else 1.0)
            for i in row:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / opt.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return [weight(i) for i in range(count)]


def test_fit_equals_plain_ftrl(monkeypatch):
    monkeypatch.setattr(op, "MIN_DOCS", 1)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(60)]
    labels = np.array([float("w3" in t.split()) for t in texts])
    opt = op.Ftrl(alpha=0.4, beta=1.0, l1=0.3, l2=0.2, epochs=3)
    at, w = op.fit_shard(texts, labels, opt)
    ids = {op.BIAS: 0}
    rows = []
    for t in texts:
        rows.append([0] + [ids.setdefault(int(f), len(ids)) for f in op.features(t)])
    boost = min(3.0, max(1.0, (60 - labels.sum()) / labels.sum()))
    want = plain_ftrl(rows, labels, len(ids), opt, boost)
    got = dict(zip(at.tolist(), w, strict=True))
    for f, i in ids.items():
        assert abs(got.get(f, 0.0) - want[i]) < 1e-9
    assert 0 < len(at) < len(ids)


def test_features_are_words_pairs_skips_and_stems():
    assert len(op.features("One two, THREE four")) == 4 + 4 + 3 + 2 + 1
    assert (op.features("a-B c") == op.features("A b C!")).all()
    assert len(op.features(None)) == len(op.features(" .,")) == 0


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = op.score_toxicity(docs, labels)
    assert scored.count() == docs.count()
    held = scored.where("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in held if r.toxic]
    clean = [r.predicted for r in held if not r.toxic]
    assert sum(toxic) > 0.5 * len(toxic) and sum(clean) <= 0.005 * len(clean)
    # A model from the held-out fold alone has no labels to learn from.
    fold = labels.where(crc_remainder("doc_id", 3) == 1)
    assert len(op.fit(docs, fold)[0]) == 0


def test_odd_rows(spark):
    data = [(1, "you idiot", 2.0), (1, "you idiot", 2.0), (2, None, 2.0), (None, "", 2.0)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(None, 1), (1, None), (3, 1)], "doc_id bigint, toxic int")
    rows = op.score_toxicity(docs, labels).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    none = op.score_toxicity(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert op.score_toxicity(docs.limit(0), labels).count() == 0


def test_too_many_weights_fail_openly(spark, monkeypatch):
    monkeypatch.setattr(op, "MIN_DOCS", 1)
    data = [(i, "kind words here" if i % 2 else "vile words there") for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id bigint, toxic int")
    at, _ = op.fit(docs, labels)
    assert len(at) > 3
    monkeypatch.setattr(op, "MAX_WEIGHTS", len(at))
    assert op.fit(docs, labels)[0].tolist() == at.tolist()
    monkeypatch.setattr(op, "MAX_WEIGHTS", len(at) - 1)
    with pytest.raises(ValueError, match="weights differ from zero"):
        op.fit(docs, labels)
