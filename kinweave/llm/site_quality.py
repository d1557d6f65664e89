"""Quality by hierarchical empirical Bayes: a document's own evidence beside its site's record.

A classifier of the text gives every document a probability and, with the training rate taken
out, a log-likelihood ratio. Hosts and paths collect their documents' probabilities; a host's
mean is shrunk to the corpus mean and a path's to its host's, as strongly as the spread between
groups says. The path's mean without the document itself is the prior that its evidence meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.llm.quality_rules import measures
from kinweave.plans.joins import fits_broadcast
from kinweave.plans.storage import materialize

FOLDS, HELD_OUT = 3, 1
# The classifier reads about so many labelled documents, however many there are.
SAMPLE = 20_000
# Rows of different features that the ids of the sample may have on average.
MAX_ROWS_PER_ID = 10
KEEP_FROM = 0.5
MAX_STRENGTH = 1000.0
_SALTS = 64
_EDGES = {
    "n_words": (5, 10, 20, 50, 200, 1000),
    "word_size": (2.5, 4, 6, 9, 14),
    "symbols": (0.01, 0.05, 0.2, 0.5),
    "lines": (0.001, 0.01, 0.1),
    "repeats": (0.02, 0.1, 0.3, 0.6),
    "upper": (0.05, 0.15, 0.4, 0.8),
    "marks": (0.02, 0.1, 0.3, 0.6),
}
FEATURES = 1 + sum(len(e) for e in _EDGES.values())


def features(text: str | None) -> list[int]:
    """The bias and, for each measure of the text, which of its edges it reaches."""
    n, chars, symbols, lines, repeats, upper = measures(text)
    marks = sum(text.count(c) for c in "!?;:") if text else 0
    w = max(n, 1)
    values = (n, chars / w, symbols / w, lines / w, repeats / w, upper / w, marks / w)
    return [1] + [int(v >= e) for v, edges in zip(values, _EDGES.values(), strict=True) for e in edges]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the bias is not penalised."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def measure_features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and ``x``, the features of every whole text."""
    kept = docs.select(*keep, F.col("text").cast("string").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("__text")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(x, pa.list_(pa.int8()))], [*keep, "x"]
            )

    return kept.mapInArrow(run, f"{kinds}, x array<tinyint>")


def train(measured: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and the sample's share of good texts, from labels outside the held-out fold.

    Rows without id or label are left out, of several labels the smallest counts. Without
    labels the evidence is nil.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold != HELD_OUT))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
    )
    total = known.count()
    if total == 0:
        return np.zeros(FEATURES), 0.5
    draw = F.pmod(F.xxhash64("doc_id", F.lit(57)), F.lit(1_000_000))
    chosen = known.where(draw < max(1, int(min(1.0, sample / total) * 1_000_000)))
    # About ``sample`` rows of some thirty small numbers come to the driver: of rows that share an
    # id, those of different features. Far more of them fail; none are cut.
    found = measured.select("doc_id", "x").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "x"])
    rows = found.select("x", "y").limit(MAX_ROWS_PER_ID * sample + 1).toPandas()
    if len(rows) > MAX_ROWS_PER_ID * sample:
        raise ValueError("too many different rows share the sampled ids; take a smaller sample")
    if len(rows) == 0:
        return np.zeros(FEATURES), 0.5
    y = rows["y"].to_numpy(float)
    rate = float(np.clip(y.mean(), 0.01, 0.99))
    return fit_logistic(np.stack(rows["x"].to_numpy()).astype(float), y), rate


def strength(groups: DataFrame, mean: float) -> float:
    """How many documents the group's prior is worth, by the moments of the group means.

    The spread of the means between groups, beyond what groups of their size show by chance,
    is what a prior has to cover; the less of it, the more a group is shrunk.
    """
    p = F.col("good") / F.col("n")
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * (p - F.lit(mean)) ** 2).alias("between"),
        F.sum(F.col("squares") - F.col("n") * p * p).alias("within"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not row["n"] or row["k"] < 2:
        return MAX_STRENGTH
    noise = max(row["within"], 0.0) / max(row["n"] - row["k"], 1)
    size = row["n"] - row["nn"] / row["n"]
    spread = (row["between"] - (row["k"] - 1) * noise) / size if size > 0 else 0.0
    if spread <= 0:
        return MAX_STRENGTH
    return float(np.clip(mean * (1 - mean) / spread - 1, 1.0, MAX_STRENGTH))


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def _spread_join(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Left lookup by null-safe keys: a broadcast when small, else salted against hot keys."""
    renamed = small.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in small.columns if c not in keys]
    )
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    gone = [f"__k{i}" for i in range(len(keys))]
    if fits_broadcast(renamed):
        return big.join(F.broadcast(renamed), same, "left").drop(*gone)
    salted = renamed.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    drawn = big.withColumn("__draw", F.pmod(F.xxhash64("doc_id", "evidence"), F.lit(_SALTS)).cast("int"))
    return drawn.join(salted, same & (F.col("__draw") == F.col("__salt")), "left").drop(
        *gone, "__salt", "__draw"
    )


# What of a page is no text, and the host and first folder of an address.
_NO_TEXT = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
_FOLDER = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]+)/"


def page_documents(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as documents: doc_id, host, path (the first folder) and text.

    Hosts are in lower case and without ``www.``. A page without a usable address has null
    sites; one that lies in no folder has the path ''. Null html is a null text.
    """
    host = F.regexp_replace(F.lower(F.regexp_extract("url", _HOST, 1)), r"^www\.", "")
    return pages.select(
        F.col("page_id").alias("doc_id"),
        F.when(host != "", host).alias("host"),
        F.when(host != "", F.regexp_extract("url", _FOLDER, 1)).alias("path"),
        F.regexp_replace("html", _NO_TEXT, " ").alias("text"),
    )


def judge_pages(pages: DataFrame, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``judge_sites`` of web pages by their addresses; labelled documents teach the classifier."""
    return judge_sites(page_documents(pages), labels, host="host", path="path", training=docs, **options)


def judge_sites(
    docs: DataFrame,
    labels: DataFrame,
    host: str = "source",
    path: str = "lang",
    keep_from: float = KEEP_FROM,
    sample: int = SAMPLE,
    training: DataFrame | None = None,
) -> DataFrame:
    """Per document: doc_id, host, path, evidence, host_mean, path_mean, posterior and kept.

    ``labels`` are those of ``docs``, or of other documents ``training`` (doc_id, text).
    ``host`` and ``path`` name columns; a path lies inside its host, and null hosts and paths
    are groups of their own. A null text is a text without words. Repeated rows count and
    come back as often. A document alone in the corpus meets the prior one half.
    """
    named = docs.select(
        "doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text"
    )
    measured = materialize(measure_features(named, ["doc_id", "host", "path"]), "site_features")
    learned = measured if training is None else measure_features(training, ["doc_id"])
    weights, rate = train(learned, labels, sample)
    terms = [F.lit(float(w)) * F.get("x", F.lit(i)) for i, w in enumerate(weights)]
    score = sum(terms[1:], terms[0])
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-15.0), F.least(F.lit(15.0), score))))
    scored = materialize(
        measured.select("doc_id", "host", "path", probability.alias("p")).withColumn(
            "evidence", _logit(F.col("p")) - F.lit(float(np.log(rate / (1 - rate))))
        ),
        "site_scores",
    )
    sums = [
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("p").alias("good"),
        F.sum(F.col("p") * F.col("p")).alias("squares"),
    ]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "good", "squares")])
    n, good = paths.agg(F.sum("n"), F.sum("good")).first()
    mean = float(np.clip((good + 0.5) / (n + 1), 1e-4, 1 - 1e-4)) if n else 0.5
    of_host, of_path = strength(hosts, mean), strength(paths, mean)
    host_sums = hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    table = _sums_by_path(paths, host_sums)

    # Without the document itself, in its path and in its host.
    host_mean = (F.col("host_good") - F.col("p") + of_host * mean) / (F.col("host_n") - 1 + of_host)
    path_mean = (F.col("path_good") - F.col("p") + of_path * F.col("host_mean")) / (
        F.col("path_n") - 1 + of_path
    )
    bounded = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col("path_mean")))
    joined = _spread_join(scored, table, ["host", "path"])
    return (
        joined.withColumn("host_mean", host_mean)
        .withColumn("path_mean", path_mean)
        .withColumn(
            "posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("evidence") + _logit(bounded))))
        )
        .select(
            "doc_id",
            "host",
            "path",
            "evidence",
            "host_mean",
            "path_mean",
            "posterior",
            (F.col("posterior") >= keep_from).alias("kept"),
        )
    )


def _sums_by_path(paths: DataFrame, host_sums: DataFrame) -> DataFrame:
    """Sums of each path beside those of its host."""
    other = host_sums.withColumnRenamed("host", "__host")
    small = F.broadcast(other) if fits_broadcast(other) else other
    return paths.join(small, F.col("host").eqNullSafe(F.col("__host"))).select(
        "host", "path", F.col("n").alias("path_n"), F.col("good").alias("path_good"), "host_n", "host_good"
    )
