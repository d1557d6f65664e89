import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import quality_rules as op


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = (text or "").split("\n")
    duplicates = sum(
        bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines[:i] for i, line in enumerate(lines)
    )
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (len(words), sum(map(len, words)), symbols, duplicates, len(hit))


PIECES = ["a ", "b ", "é ", "a b c d e f g h ", "\n", "#x", " ", "\t", "|", "a a a a ", "\x1c"]


@settings(max_examples=400, deadline=None)
@given(st.none() | st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_measures_equal_plain_count(text):
    assert op.measures(text)[:5] == plain(text)


def test_estimate_finds_the_good_class():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.7
    blamed = rng.random((20_000, 5)) < np.where(truth, 0.001, 0.5)[:, None]
    votes = np.where(blamed, op.BAD, op.GOOD)
    votes[rng.random(votes.shape) < 0.3] = op.ABSTAIN
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = op.estimate(patterns, counts.astype(float))
    assert abs(model["prior"] - 0.7) < 0.02 and np.abs(model["rates"][0] - 0.5).max() < 0.05
    assert ((model["posterior"][at.ravel()] >= 0.5) == truth).mean() > 0.9


def judged_patterns(votes):
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = op.estimate(patterns, counts.astype(float))
    return model, model["posterior"][at.ravel()]


def test_rules_that_err_in_a_tenth_of_the_texts():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.7
    votes = np.where(rng.random((20_000, 5)) < 0.9, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = op.ABSTAIN
    model, posterior = judged_patterns(votes)
    assert abs(model["prior"] - 0.7) < 0.1
    assert ((posterior >= 0.5) == truth).mean() > 0.9


@pytest.mark.parametrize("share", [0.01, 0.03, 0.1, 0.33])
def test_a_rule_that_blames_clean_texts_is_outvoted(share):
    rng = np.random.default_rng(6)
    truth = rng.random(100_000) < 0.97
    blamed = rng.random((100_000, 6)) < np.where(truth, 0.001, 0.5)[:, None]
    hot = truth & (rng.random(100_000) < share)
    blamed[hot] = np.arange(6) == 2
    model, posterior = judged_patterns(np.where(blamed, op.BAD, op.GOOD))
    assert posterior[hot].min() >= 0.5 and abs(model["rates"][1][2] - share) < 0.01
    assert (posterior[~truth] < 0.5).mean() > 0.8


def test_a_third_blamed_by_a_rule_that_sees_no_other_junk():
    votes = np.array([[1] * 6, [1, 1, 0, 1, 1, 1], [1, 1, 1, 1, 0, 0], [0, 0, 1, 1, 1, 1]])
    for times in (1, 1_000):
        posterior = op.estimate(votes, np.array([640.0, 330, 20, 10]) * times)["posterior"]
        assert (posterior >= 0.5).tolist() == [True, True, False, False]


def test_a_hot_source_keeps_its_documents(spark):
    plain_text = " ".join(f"word{i} text" for i in range(60))
    code = " ".join(f"value{i} |" for i in range(60)).replace("|", "|&")
    junk = "wo*** " * 60
    data = [(i, f"{plain_text} {i}") for i in range(600)]
    data += [(i, f"{code} {i}") for i in range(1000, 1330)] + [(i, junk) for i in range(2000, 2040)]
    rows = op.judge_quality(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert all(r.v_symbols == op.BAD for r in rows if 1000 <= r.doc_id < 1330)
    assert {r.doc_id for r in rows if r.kept} == {*range(600), *range(1000, 1330)}


def test_rows(spark):
    clean = " ".join(f"word{i} text" for i in range(60)) + "."
    junk = " ".join(f"wo{i}***" for i in range(60))
    repeat = "one two three four five six seven eight " * 20
    data = [(i, clean + str(i), 1) for i in range(200)] + [(i, junk, 2) for i in range(300, 360)]
    data += [(400, repeat, 3), (401, None, 4), (402, "", 4), (402, "short text", 4), (None, clean, 1)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, kept int")
    rows = op.judge_quality(docs).collect()
    assert len(rows) == len(data)
    kept = {r.doc_id for r in rows if r.kept}
    assert kept == {None, *range(200)}
    assert {r.doc_id for r in rows if r.base_failed} == {400, 401, 402}
    assert op.judge_quality(docs.limit(0)).count() == 0


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    judged = op.judge_quality(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) > 0.98 * len(good) and sum(bad) < 0.1 * len(bad)


SHARES = [k / 100 for k in range(1, 41)]


@pytest.mark.parametrize("sees", [0.0, 0.1, 0.3, 0.5, 0.9])
def test_posterior_moves_smoothly_with_a_rules_share(sees):
    """Six rules, 3 % junk that two others see, and good texts that rule 2 alone blames."""

    def posterior(share):
        clean, lone = [1] * 6, [1, 1, 0, 1, 1, 1]
        seen, unseen = [0, 0, 0, 1, 1, 1], [0, 0, 1, 1, 1, 1]
        votes = np.array([clean, lone, seen, unseen])
        counts = np.array([0.97 - share, share, 0.03 * sees, 0.03 * (1 - sees)]) * 1e6
        model = op.estimate(votes, counts)
        assert model["posterior"][0] > 0.9 and (model["posterior"][2:] < 0.5).all()
        return model["posterior"][1]

    found = np.array([posterior(s) for s in SHARES])
    # Monotonic up to rounding, and no step of a hundredth of the documents changes much.
    assert (np.diff(found) > -0.02).all() and np.abs(np.diff(found)).max() < 0.25
    finer = [posterior(s) for s in np.linspace(0.2, 0.36, 81)]
    assert np.abs(np.diff(finer)).max() < 0.06
    assert found[-1] > 0.8


def test_posterior_does_not_depend_on_the_size_of_the_corpus():
    votes = np.array([[1] * 6, [1, 1, 0, 1, 1, 1], [1, 1, 1, 1, 0, 0], [0, 0, 1, 0, 1, -1]])
    shares = np.array([0.8, 0.12, 0.05, 0.03])
    small, large = (op.estimate(votes, shares * n)["posterior"] for n in (1e4, 1e9))
    assert np.abs(small - large).max() < 0.05
