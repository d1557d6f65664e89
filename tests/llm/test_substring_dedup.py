import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import substring_dedup as op
from kinweave.llm.fm_index import FMIndex
from kinweave.llm.queries import ORACLES, QUERIES


def plain(data):
    first = {}
    for doc, text in data:
        w = (text or "").encode().split()
        for i in range(len(w) - 12):
            if doc is not None:
                k = tuple(w[i : i + 13])
                first[k] = min(first.get(k, doc), doc)
    out = []
    for doc, text in data:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - 12):
            if doc is not None and first[tuple(w[i : i + 13])] < doc:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone).decode()
        out.append((str(doc), len(w), len(gone), kept))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=25), min_size=1, max_size=8),
    st.integers(1, 13),
)
def test_backward_search_equals_scanning(sequences, width):
    values = np.arange(len(sequences))[::-1] * 7
    index = FMIndex([np.array(s) for s in sequences], values)
    for text in sequences:
        ends = np.arange(width, len(text) + 1)
        if len(ends) == 0:
            continue
        length, low, high = index.matches(np.array(text), ends, width)
        least = index.least_values(low, high)
        for e, n, lo, hi, v in zip(ends, length, low, high, least, strict=True):
            def found(k, e=e, text=text):
                return [
                    values[q]
                    for q, s in enumerate(sequences)
                    for i in range(len(s) - k + 1)
                    if s[i : i + k] == text[e - k : e]
                ]

            assert n == max([0, *(k for k in range(1, width + 1) if len(found(k)) > 1)])
            if n:
                assert hi - lo == len(found(n)) and v == min(found(n))


@pytest.mark.parametrize("n", [0, 12, 13, 14, 40, 500])
def test_segments_hold_every_window_once(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 8, n).astype(np.uint64) * np.uint64(0x1234567891)
    anchors, first, count = op.segments(h)
    covered = [i for f, c in zip(first, count, strict=True) for i in range(f, f + c)]
    assert covered == list(range(max(0, n - 12)))
    seen = {}
    for a, f, c in zip(anchors, first, count, strict=True):
        for i in range(f, f + c):
            assert seen.setdefault(h[i : i + 13].tobytes(), a) == a


def corpus():
    rng = random.Random(9)
    vocabulary = ["a", "b", "é", "the", "of"] + [f"w{i}" for i in range(60)]
    passages = [" ".join(rng.choices(vocabulary, k=k)) for k in (12, 13, 30, 80)]
    data = []
    for i in range(120):
        parts = [" ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30])))]
        if rng.random() < 0.6:
            parts += [rng.choice(passages), " ".join(rng.choices(vocabulary, k=5))]
        data.append((rng.choice([i, i, i, 5]), rng.choice([" ", "\n", "\t "]).join(parts)))
    data += [(None, passages[3]), (None, None), (500, None), (501, ""), (-3, passages[3]), data[7], data[7]]
    data += [(600, "x " * 3000), (601, "x " * 40), (602, "y z " * 200)]
    return data


@pytest.mark.parametrize("crowded", [False, True])
def test_equals_plain_search(spark, monkeypatch, crowded):
    if crowded:
        monkeypatch.setattr(op, "SEGMENTS_PER_ANCHOR", 1)
    data = corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in data], "doc_id bigint, text string, row int")
    rows = op.substring_dedup(docs, keep_text=True).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in rows)
    assert got == plain(data)
    assert sum(r[2] for r in got) > 1000
    assert op.substring_dedup(docs.limit(0)).count() == 0


def test_ids_of_any_type(spark):
    data = [(None if d is None else f"k{d:05}", t) for d, t in corpus() if d is None or d >= 0]
    docs = spark.createDataFrame(data, "doc_id string, text string")
    rows = op.substring_dedup(docs, keep_text=True).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in rows)
    assert got == plain(data)


def test_texts_are_not_shuffled_again(spark):
    docs = spark.createDataFrame([(1, "a " * 50), (2, "a " * 50)], "doc_id bigint, text string")
    plan = op.substring_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    # Only the places are dealt out to the documents' buckets.
    assert "Bucketed: true" in plan and "packed" not in "".join(
        line for line in plan.splitlines() if "Exchange" in line
    )
    assert plan.count("Exchange hashpartitioning(row") + plan.count("Exchange hashpartitioning(__row") == 1


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duck.execute(ORACLES["op4_substring_dedup"]).fetchall())
    df = QUERIES["op4_substring_dedup"](spark, sf)
    got = sorted(tuple(r) for r in df.select(*[c[0] for c in duck.description]).collect())
    assert got == want and sum(r[2] for r in got) > 0


def test_equal_stretches_have_equal_hashes():
    h = np.random.default_rng(6).integers(0, 3, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.repeat(np.arange(0, 380), 4)
    size = np.tile([13, 14, 17, 20], 380)
    seen = {}
    for x, y, i, n in zip(*op.span_hashes(h, first, size), first, size, strict=True):
        assert seen.setdefault((x, y), h[i : i + n].tobytes()) == h[i : i + n].tobytes()
    assert len(seen) == len({h[i : i + n].tobytes() for i, n in zip(first, size, strict=True)})
