"""Quality rules: weak supervision instead of all-must-pass filters.

Every rule votes good or bad or abstains. The accuracies of the rules come from
expectation-maximisation over how often each pattern of votes occurs; a pattern's posterior
probability of quality then decides. There are at most 3 ** rules patterns whatever the
corpus, so the model is fitted on a small table of counts over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.text import words_of
from kinweave.plans.storage import materialize

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words
SYMBOLS = "#*$%&|<>"
KEEP_FROM = 0.5
KIND_SHARE = 0.28  # of the documents: as likely a kind of junk that one rule alone sees as not
KIND_SLOPE = 8  # how fast that belief falls with the share
SIGHT = 16  # how fast it falls with the junk of other rules that the rule sees
KIND_ERRORS = 0.05  # mistakes per document of such a kind
SIGHT_PRIOR = 0.25  # of the junk that others agree on, seen by a rule that nothing is known of
LEAST_KIND = 0.01  # of the documents: smaller kinds are believed in as one of this size
GOOD, BAD, ABSTAIN = 1, 0, -1


def repeated_words(words: list[bytes], n: int = WINDOW) -> int:
    """Words inside ``n``-word windows (n a power of two) found twice or more, first included.

    Windows are numbered by doubling: a window of 2k words is the pair of its halves'
    numbers. Equal numbers mean equal words, so nothing rests on hashes.
    """
    count = len(words) - n + 1
    if count < 2:
        return 0
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    width = 1
    while width < n:
        pairs = at[:-width] * np.int64(len(words)) + at[width:]
        distinct, at, times = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(distinct) == len(pairs):
            return 0
        width *= 2
    starts = np.flatnonzero(times[at] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + n, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_upper of a text."""
    if not text:
        return (0, 0, 0, 0, 0, 0)
    words = words_of(text)
    # Code points in words: all but the six ASCII white-space characters.
    blanks = sum(text.count(c) for c in " \t\n\r\v\f")
    symbols = sum(text.count(c) for c in SYMBOLS)
    duplicates, seen = 0, set()
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif line.strip(" \t\n\r\v\f"):
            seen.add(line)
    shouted = sum(w.isupper() for w in words)
    return (len(words), len(text) - blanks, symbols, duplicates, repeated_words(words), shouted)


FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper"]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every whole text, in one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measures(t.as_py()) for t in batch.column("text")]
            columns = zip(*rows, strict=True) if rows else [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]],
                ["doc_id", *FIELDS],
            )

    schema = ", ".join([f"doc_id {kind}", *[f"{f} bigint" for f in FIELDS]])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def base_failed() -> Column:
    """Too short, or over 30 percent of the words in repeated windows."""
    short = F.col("n_words") < MIN_WORDS
    return short | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def votes() -> dict[str, Column]:
    """The rules as columns over the measures: 1 good, 0 bad, -1 abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    mean = F.col("word_chars") / words
    symbols = F.col("n_symbols") / words
    lines = F.col("n_dup_lines")
    repeated = F.col("n_repeat_words") / words
    upper = F.col("n_upper") / words
    return {
        "v_length": _vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 50),
        "v_word_size": _vote((mean < 2.5) | (mean > 14), (mean >= 3) & (mean <= 11)),
        "v_symbols": _vote(symbols > 0.2, symbols < 0.05),
        "v_lines": _vote((lines >= 3) & (lines * 10 > words), lines == 0),
        "v_repeats": _vote(repeated > 0.3, repeated < 0.1),
        "v_upper": _vote(upper > 0.4, upper < 0.15),
    }


def agreement(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per rule, the share it blames of what other rules agree on: of their junk, and of the rest.

    Junk is what two other rules blame (30 documents blamed at the rate SIGHT_PRIOR are added,
    so a few coincidences say little); the rest is what two others clear and none blames.
    """
    bad, active = patterns == BAD, patterns != ABSTAIN
    others_bad = bad.sum(1)[:, None] - bad
    others_clear = (active & ~bad).sum(1)[:, None] - (active & ~bad)
    mass = counts[:, None] * active
    junk, clean = mass * (others_bad >= 2), mass * ((others_bad == 0) & (others_clear >= 2))
    on_junk = ((junk * bad).sum(0) + 30 * SIGHT_PRIOR) / (junk.sum(0) + 30)
    on_clean = (clean * bad).sum(0) / (clean.sum(0) + 1)
    return on_junk, on_clean


def kind_beliefs(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per rule, the belief that what it blames alone is a kind of junk, and not its mistakes.

    Votes cannot tell the two apart, so this is prior knowledge, smooth in both things that it
    depends on. A kind of junk is a small part of a corpus: the belief falls with the share that
    the rule blames alone. And a rule that sees the junk of others can be measured on it: the
    more of it the rule sees (beyond the quarter assumed without evidence), the smaller a
    kind of its own may be.
    """
    on_junk, on_clean = agreement(patterns, counts)
    likely = KIND_SHARE * np.exp(-SIGHT * np.maximum(on_junk - SIGHT_PRIOR, 0))
    return 1.0 / (1.0 + (on_clean / likely) ** KIND_SLOPE)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 2000) -> dict:
    """EM for the classes of documents and for each rule's rate of blame in them.

    ``patterns`` has a row of votes per pattern, ``counts`` how many documents show it. Rules
    are independent given the class and an abstention says nothing. The classes are good
    texts, junk that several rules see, and per rule a kind of junk that it sees alone.

    Every rate and the size of every kind has a prior of so many documents. What the rules
    blame of junk and how large kinds are starts from agreement() and kind_beliefs() with the
    weight of all documents; mistakes on good texts have that weight as far as a kind is
    believed in, and are free to be any share as far as not. So each is a mean of a smooth
    anchor and what EM finds, and the posteriors move smoothly with the counts.

    Returns prior (of good texts), rates (of good texts at 1, of junk at 0, by rule) and the
    posterior of each pattern.
    """
    bad, active = patterns == BAD, patterns != ABSTAIN
    n_rules, total = patterns.shape[1], counts.sum()
    on_junk, on_clean = agreement(patterns, counts)
    belief = kind_beliefs(patterns, counts)
    size = np.maximum(on_clean, LEAST_KIND)
    kinds = kind_anchor = belief * size
    good = good_anchor = belief * KIND_ERRORS * size + (1 - belief) * on_clean + 1e-4
    # With lower rates this class would look like good texts that no rule blames.
    junk = np.clip(np.maximum(on_junk, SIGHT_PRIOR), 1e-4, 1 - 1e-4)
    junk_anchor, weight = junk, total * belief + 0.005 * total + 1
    share = 0.05  # of junk that several rules see
    posterior = np.full(len(counts), 0.5)
    for _ in range(rounds):
        rates = np.vstack([good, junk, np.where(np.eye(n_rules, dtype=bool), 1 - 1e-4, good[None, :])])
        rest = max(1 - share - kinds.sum(), 1e-6)
        sizes = np.concatenate([[rest, share], kinds])
        logs = bad @ np.log(rates).T + (active & ~bad) @ np.log1p(-rates).T + np.log(sizes)
        # Without a blame there is no kind; a rule that abstains has none either.
        logs[:, 2:][~bad] = -np.inf
        logs -= logs.max(axis=1, keepdims=True)
        belongs = np.exp(logs)
        belongs /= belongs.sum(axis=1, keepdims=True)
        fresh = belongs[:, 0]
        done = np.abs(fresh - posterior).max(initial=0) < 1e-10
        posterior = fresh
        if done:
            break
        mass = belongs * counts[:, None]
        good = ((mass[:, 0] @ bad) + good_anchor * weight) / ((mass[:, 0] @ active) + weight)
        junk = ((mass[:, 1] @ bad) + junk_anchor * total + 1e-9) / ((mass[:, 1] @ active) + total + 1e-9)
        good, junk = (np.clip(r, 1e-9, 1 - 1e-9) for r in (good, junk))
        kinds = (mass[:, 2:].sum(axis=0) + kind_anchor * total) / (2 * total + 1e-9)
        share = float(np.clip((mass[:, 1].sum() + 1) / (total + 20), 1e-6, 0.9))
    return {"prior": float(posterior @ counts / max(total, 1)), "rates": np.stack([junk, good]), "posterior": posterior}


def judge_quality(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """Per document: the measures, base_failed, the votes, posterior and kept.

    kept is false where the base failed, else posterior >= ``keep_from``. A null text has
    no words and fails the base. Repeated rows are judged one by one and counted as often.
    """
    rules = votes()
    measured = measure(docs).select("*", base_failed().alias("base_failed"))
    voted = materialize(measured.select("*", *[v.alias(n) for n, v in rules.items()]), "votes")
    # At most 3 ** rules rows, so this passes through the driver at any scale.
    found = voted.groupBy(*rules).count().collect()
    patterns = np.array([[r[n] for n in rules] for r in found]).reshape(-1, len(rules))
    model = estimate(patterns, np.array([r["count"] for r in found], float))
    table = docs.sparkSession.createDataFrame(
        [(*map(int, p), float(q)) for p, q in zip(patterns, model["posterior"], strict=True)],
        ", ".join([*[f"{n} int" for n in rules], "posterior double"]),
    )
    kept = ~F.col("base_failed") & (F.col("posterior") >= keep_from)
    return voted.join(F.broadcast(table), list(rules), "left").select(
        "doc_id", *FIELDS, "base_failed", *rules, "posterior", kept.alias("kept")
    )
