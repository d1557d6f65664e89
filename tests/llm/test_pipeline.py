"""The stages one by one against plain versions of what each has to decide."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from __spark_entry__ import queries
from kinweave.llm import toxicity
from tests.llm.test_decontamination import plain as plain_hits
from tests.llm.test_near_duplicates import shingle_set

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_order_and_names():
    assert [n for n, _ in cp.STAGES] == [
        "toxicity",
        "n-gram Jaccard join",
        "benchmark decontamination",
        "mixing sources to target weights",
        "token-ID / binary output",
    ]
    assert "pipeline" in queries()


def test_toxic_documents_go(spark, outputs):
    before, after = outputs[0], outputs[1]
    at, w = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = Counter(tuple(r) for r in before.collect() if toxicity.score_text(r.text, at, w) < 0.7)
    assert rows(after) == want and after.columns == before.columns


def test_one_of_each_group_stays(outputs):
    before, after = rows(outputs[1]), rows(outputs[2])
    assert not after - before
    kept = [(r[0], shingle_set(r[1])) for r in after]
    for r in before:
        s = shingle_set(r[1])
        close = [i for i, k in kept if k and len(s & k) >= 0.8 * len(s | k)]
        assert r in after or close
        assert r not in after or close in ([], [r[0]])


def test_contaminated_documents_go(spark, outputs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = Counter({r: n for r, n in rows(outputs[2]).items() if not plain_hits(r[1], items)[3]})
    assert rows(outputs[3]) == want and want != rows(outputs[2])


def test_mixing_copies_whole_rows(outputs):
    before, after = rows(outputs[3]), rows(outputs[4])
    assert set(after) <= set(before)
    assert 0.7 < sum(after.values()) / sum(before.values()) < 1.3


def test_tokens_of_what_was_mixed(outputs):
    full = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in outputs[4].collect():
        ids = np.array([*full.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    found = outputs[5].orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    assert [r.doc_id for r in found] == sorted(r.doc_id for r in found)
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]


def test_run_gives_the_stages_in_turn(spark, outputs):
    assert rows(cp.run(spark, SF).select(outputs[5].columns)) == rows(outputs[5])


def test_stages_stand_odd_rows(spark, tmp_path):
    data = [(1, None, "en", "a", None), (1, None, "en", "a", None), (None, "", None, None, 0)]
    data += [(2, "some words " * 30, "en", "b", 1), (2, "some words " * 30, "en", "b", 1), (2, "other", None, "b", 1)]
    for part in (data, []):
        docs = spark.createDataFrame(part, "doc_id bigint, text string, lang string, source string, n_chars bigint")
        got = [docs]
        for i, (_, stage) in enumerate(cp.STAGES):
            path = str(tmp_path / f"{len(part)}-{i}")
            stage(spark, got[-1], SF).write.parquet(path)
            got.append(spark.read.parquet(path))
        assert [d.columns for d in got[:5]] == [docs.columns] * 5
        if part:
            assert got[1].count() == 6
            assert Counter(r.doc_id for r in got[2].collect()) == {1: 2, None: 1, 2: 2}
        else:
            assert got[5].count() == 0
