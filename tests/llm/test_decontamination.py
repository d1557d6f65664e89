import random
import re

import duckdb
import pytest

from kinweave.llm import decontamination as op
from kinweave.llm.queries import ORACLES, QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def plain(text, items, width=13):
    w = words(text)
    hit, found = set(), set()
    for item_id, item in items:
        iw = words(item)
        n = min(width, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(str(item_id))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(params=["broadcast", "shuffled"])
def way(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(op, "fits_broadcast", lambda df: False)


def test_equals_plain_search(spark, way):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "É", "é", "d1", "the", "THE", "x"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n"]) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 3, 5, 13, 14, 20]))) for i in range(12)]
    items += [(11, items[3][1]), (12, None), (13, "the the the")]
    docs = [(i, text(rng.choice([0, 2, 10, 60])), i) for i in range(60)]
    docs += [(i, text(9) + items[i % 12][1] + text(4), i) for i in range(60, 100)]
    docs += [(5, "other text " + items[8][1], 1), docs[70], docs[70], (None, items[9][1], 1), (200, None, 1)]
    docs.append((201, "", 1))
    docs += [(300, text(20_000), 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, n_words int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for width in (13, 3):
        got = sorted(
            (str(r.doc_id), r.n_words, r.n_hit, r.item_ids, r.contaminated)
            for r in op.decontaminate(d, b, width).collect()
        )
        assert got == sorted((str(i), *plain(t, items, width)) for i, t, _ in docs)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "b")], "item_id bigint, text string")
    assert op.decontaminate(d.limit(0), b).count() == 0
    row = op.decontaminate(d, b.limit(0)).first()
    assert (row.n_words, row.n_hit, row.item_ids, row.contaminated) == (3, 0, [], False)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(duck.execute(ORACLES["op9_decontamination"]).fetchall())
    df = QUERIES["op9_decontamination"](spark, sf)
    got = sorted(tuple(r) for r in df.select(*[c[0] for c in duck.description]).collect())
    assert got == want and sum(r[-1] for r in got) > 0
