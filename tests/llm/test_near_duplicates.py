import random

import numpy as np
import pytest

from kinweave.llm import near_duplicates as op


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(data):
    """Links and groups of (id, text) rows by comparing all."""
    sets = [shingle_set(t) for _, t in data]
    n = len(data)
    links, group = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return links, group


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 150, 400]))
        for _ in range(rng.choice([1, 1, 2, 6, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += ["", None, "same short", "same short", "same  short\n"]
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


def test_ids_of_any_type(spark):
    data = corpus(1)[:60]
    docs = spark.createDataFrame([(f"k{i}", t) for i, t in data] + [(None, data[0][1])], "doc_id string, text string")
    links, group = plain([*data, (None, data[0][1])])
    first = {}
    for (i, _), g in zip(data, group, strict=False):
        first[g] = min(first.get(g, i), i)
    got = {r.doc_id: r for r in op.near_duplicates(docs).collect()}
    for (i, _), n, g in zip(data, links, group, strict=False):
        linked_to_null = g == group[-1] and n > 0
        assert got[f"k{i}"].n_links == n and (linked_to_null or got[f"k{i}"].class_id == f"k{first[g]}")
    kept = {r.doc_id for r in op.one_of_each_class(docs).collect()} - {None}
    assert {f"k{v}" for g, v in first.items() if g != group[-1]} <= kept


@pytest.mark.parametrize("seats, shingles", [(256, 10**6), (4, 10**6), (256, 500)])
def test_equals_all_pairs(spark, monkeypatch, seats, shingles):
    monkeypatch.setattr(op, "BLOCK_SHINGLES", shingles)
    data = corpus(1)
    docs = spark.createDataFrame([(i, t, 0) for i, t in data], "doc_id bigint, text string, class_id int")
    got = {r.doc_id: r for r in op.near_duplicates(docs, seats=seats).collect()}
    links, group = plain(data)
    assert len(got) == len(data)
    first = {}
    for (i, _), g in zip(data, group, strict=True):
        first[g] = min(first.get(g, i), i)
    for (i, t), n, g in zip(data, links, group, strict=True):
        assert (got[i].n_links, got[i].class_id) == (n, first[g]), t
        assert got[i].n_shingles == len(shingle_set(t))
    assert sum(n > 0 for n in links) > 50


def test_many_pairs_verify_as_few():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(40)]
    pairs = np.array([(i, j) for i in range(40) for j in range(i)])
    want = [
        len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j])) for i, j in pairs
    ]
    assert list(op._verify(sets, pairs, 0.5)) == want
    one_by_one = [op._verify(sets, pairs[k : k + 1], 0.5)[0] for k in range(len(pairs))]
    assert one_by_one == want and 0 < sum(want) < len(want)


def test_bands_meet_the_recall():
    bands = op.band_count()
    assert 1 - (1 - op.THRESHOLD**op.ROWS) ** bands >= op.TARGET_RECALL
    minhash = op.MinHash(bands, op.ROWS)
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(300):
        x = rng.integers(0, 2**63, 900).astype(np.uint64)
        a, b = minhash.band_hashes(x[:500]), minhash.band_hashes(x[56:556])  # similarity 0.798
        met += (a == b).any()
    assert met == 300


def test_odd_rows(spark):
    text = " ".join(f"t{i}" for i in range(30))
    data = [(1, text), (1, text), (1, "another one"), (None, text), (None, None), (2, ""), (3, "another one")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in op.near_duplicates(docs).collect())
    assert got == sorted(
        [("1", 26, 2), ("1", 26, 2), ("None", 26, 2), ("1", 1, 1), ("3", 1, 1), ("None", 0, 0), ("2", 0, 0)]
    )
    assert op.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_class_also_under_one_id(spark):
    words = [f"t{i}" for i in range(60)]
    near = [" ".join(words), " ".join(["other", *words[1:]]), " ".join([*words[:-1], "end"])]
    far = " ".join(f"z{i}" for i in range(60))
    data = [(1, near[0]), (1, near[1]), (1, near[1]), (2, near[2]), (1, far), (None, far + " more"), (3, ""), (3, "")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    rows = [(r.doc_id, r.text) for r in op.one_of_each_class(docs).collect()]
    assert sum(t in near for _, t in rows) == 1 and sum(t.startswith("z0") for _, t in rows) == 1
    assert rows.count((3, "")) == 2 and len(rows) == 4
