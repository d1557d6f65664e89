"""Texts of millions of characters, word by word ordinary or not, in bounded time."""

import time

import numpy as np
import pytest

from kinweave.llm import (
    chat_format,
    importance,
    licenses,
    near_duplicates,
    pii,
    quality_rules,
    site_quality,
    substring_dedup,
    toxicity,
)
from kinweave.llm.text import hashes, words_of

TEXTS = {
    "words": " ".join(f"w{i % 5000}" for i in range(400_000)),
    "one word": "x" * 3_000_000,
    "one word again and again": "again " * 400_000,
    "lines": "same line\n" * 300_000,
    "symbols": "# $ % " * 400_000,
    "other scripts": "éß漢 " * 400_000,
}
INDEX = licenses.TemplateIndex(licenses.TEMPLATES)
MODEL = np.array([3, 5], np.uint64), np.array([0.1, -0.1])


def segments(text):
    h = hashes(words_of(text))
    anchors, first, count = substring_dedup.segments(h)
    substring_dedup.span_hashes(h, first, count + substring_dedup.WIDTH - 1)


@pytest.mark.parametrize("text", list(TEXTS))
@pytest.mark.parametrize("apply", [
    lambda t: toxicity.score_text(t, *MODEL),
    near_duplicates.shingles,
    quality_rules.measures,
    site_quality.features,
    segments,
    pii.find_spans,
    lambda t: licenses.scan_text(t, INDEX),
    lambda t: sum(n for n, _ in importance.text_buckets(t, 2, 10_000)),
    lambda t: chat_format.parse(chat_format.render("user", t)[0]),
], ids=["op1", "op2", "op3", "op5", "op4", "op6", "op7", "op11", "op12"])
def test_a_long_text_ends(apply, text):
    begin = time.process_time()
    apply(TEXTS[text])
    assert time.process_time() - begin < 30
