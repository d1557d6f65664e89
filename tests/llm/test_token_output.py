import os
import zlib
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from kinweave.llm import token_output as op

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None,
    "",
    " \t\n",
    "plain words, it's 42!! don't",
    "ÄÖÜß él ñandú × ÷ ª º µ ²",
    "é combining ẛ̣ ΟΔΟΣ İstanbul",
    "a b c\x1cd\x85e",
    "x<|endoftext|>y <|startoftext|>",
    "日本語 العربية 🙂🙂 z\u0000q",
    "re" * 5000,
    "''s's 'T 'LL 1½ ①",
]


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(PATH)


def want_ids(full, text):
    return full.encode(text or "", add_special_tokens=False).ids


def test_words_encode_as_whole_texts(full):
    got = op.WordEncoder(PATH).encode([t or "" for t in ODD])
    for text, ids in zip(ODD, got, strict=True):
        assert list(ids) == want_ids(full, text), text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_encodes_as_a_whole(text):
    full = Tokenizer.from_file(PATH) if not hasattr(want_ids, "f") else want_ids.f
    want_ids.f = full
    assert list(op.word_encoder(PATH).encode([text])[0]) == want_ids(full, text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x17F), max_size=60))
def test_latin_text_encodes_as_a_whole(text):
    full = Tokenizer.from_file(PATH) if not hasattr(want_ids, "f") else want_ids.f
    want_ids.f = full
    assert list(op.word_encoder(PATH).encode([text])[0]) == want_ids(full, text)


class Listening:
    """A tokenizer that notes the pieces it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.seen += [piece for text in texts for piece in text.split()]
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_each_piece_is_encoded_once(full):
    encoder = op.WordEncoder(PATH)
    encoder.bare, encoder.full = Listening(encoder.bare), Listening(encoder.full)
    texts = ["Word word. WORD!! 'word',", "ÉTÉ été... 日本 日本", "word? Été! 7 77 日本"]
    for some in (texts[:2], texts, texts[2:]):
        for text, ids in zip(some, encoder.encode(some), strict=True):
            assert list(ids) == want_ids(full, text)
    assert "word" in encoder.bare.seen and encoder.full.seen == ["日本"]
    assert len(encoder.bare.seen) == len(set(encoder.bare.seen))


@pytest.mark.parametrize("most", [0, 60, 1 << 20])
def test_forgotten_pieces_change_nothing(full, monkeypatch, most):
    monkeypatch.setattr(op, "CACHED_BYTES", most)
    encoder = op.WordEncoder(PATH)
    texts = [t or "" for t in ODD]
    for some in ([], texts[:4], texts, texts[3:7], texts[::-1]):
        for text, ids in zip(some, encoder.encode(some), strict=True):
            assert list(ids) == want_ids(full, text)


def test_pieces_that_no_token_ends(full):
    encoder = op.WordEncoder(PATH)
    encoder.ends[:] = False
    for text, ids in zip(ODD[3:], encoder.encode(ODD[3:]), strict=True):
        assert list(ids) == want_ids(full, text)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_columns_with_an_offset_and_nulls(full, kind):
    column = pa.array([*ODD, None, "last one"], kind).slice(3)
    got = op.WordEncoder(PATH).encode_column(column)
    for text, ids in zip(column.to_pylist(), got, strict=True):
        assert list(ids) == want_ids(full, text)


def test_groups_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(op, "GROUP_BYTES", 1000)
    texts = ["x" * n for n in (10, 900, 30, 5000, 0, 1, 936, 937)] + [None] * 40
    rows = pa.record_batch([pa.array(range(48)), pa.array(texts, pa.string())], ["doc_id", "text"])
    for size in (1, 3, 48):
        batches = [rows.slice(i, size) for i in range(0, 48, size)]
        groups = list(op._groups(iter([rows.slice(0, 0), *batches])))
        assert [r for g in groups for r in g.to_pylist()] == rows.to_pylist()
        for g in groups:
            held = sum(len(t or "") + op.ROW_BYTES for t in g.column("text").to_pylist())
            assert g.num_rows == 1 or held <= 1000
        assert len(groups) < 12


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 4096, 4097, 20_000])
def test_chunk_round_trip(unit, n):
    ids = np.random.default_rng(n).integers(0, 2**32, n, np.uint64).astype(np.uint32)
    data = op.encode_chunk(ids, unit)
    assert (op.decode_chunk(data) == ids).all()
    with pytest.raises(ValueError):
        op.decode_chunk(data + b"x")


def test_planes_of_small_ids_shrink():
    ids = np.random.default_rng(1).integers(0, 1000, 100_000).astype(np.uint32)
    assert len(op.encode_chunk(ids, "bit")) < len(op.encode_chunk(ids, "byte")) < 2 * len(ids)


@pytest.mark.parametrize("unit", ["byte", "bit"])
def test_documents_come_back_in_order(spark, tmp_path, full, unit):
    data = [(7 - i if i % 3 else i, t, i) for i, t in enumerate(ODD)] + [(None, "no id", 1)] * 2
    docs = spark.createDataFrame(data, "doc_id bigint, text string, n_tokens int")
    op.write_token_ids(docs, str(tmp_path / "ids"), PATH, unit, partitions=4)
    back = [r.asDict() for r in op.read_token_ids(spark, str(tmp_path / "ids")).collect()]
    back.sort(key=lambda r: r["start"])
    keys = [-100 if r["doc_id"] is None else r["doc_id"] for r in back]
    assert keys == sorted(-100 if d[0] is None else d[0] for d in data)
    at, left = 0, sorted((str(d), [*want_ids(full, t), 2]) for d, t, _ in data)
    for r in back:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += r["n_tokens"]
    assert sorted((str(r["doc_id"]), r["ids"]) for r in back) == left
    digests = op.read_token_ids(spark, str(tmp_path / "ids"), digest=True).collect()
    want = {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in back}
    assert {(r["start"], r["ids_crc32"]) for r in digests} == want
    index = op.chunk_index(spark, str(tmp_path / "ids")).collect()
    assert sum(r["n_ids"] for r in index) == at and sum(r["n_docs"] for r in index) == len(data)


def resident_mb():
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGESIZE") >> 20


def test_a_worker_gives_back_what_a_task_took(monkeypatch):
    monkeypatch.setattr(op, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "bdfgklmnprst"])
    texts = [" ".join(rng.choice(vocabulary, (700, 3)).astype(object).sum(axis=1)) for _ in range(1000)]
    rows = pa.record_batch([pa.array(range(1000)), pa.array(texts)], ["doc_id", "text"])
    written = [b.to_pylist() for b in op._chunk_writer(PATH, "byte", 2, pa.int64())(iter([rows]))]
    assert [i for chunk in written for r in chunk for i in r["doc_ids"]] == list(range(1000))
    before = resident_mb()
    pa.default_memory_pool().release_unused()
    assert before - resident_mb() < 20


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    op.write_token_ids(docs, str(tmp_path / "none"), PATH)
    assert op.read_token_ids(spark, str(tmp_path / "none"), digest=True).count() == 0
