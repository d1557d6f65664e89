"""A training corpus out of raw documents: STAGES in order, each over all rows the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm.decontamination import decontaminate
from kinweave.llm.mixing import mix, root_weights
from kinweave.llm.near_duplicates import drop_rows, one_of_each_class
from kinweave.llm.queries import token_digests
from kinweave.llm.toxicity import THRESHOLD, with_scores
from kinweave.plans.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Texts travel to Python in batches of at most so many rows, since one may be very long.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    spark.conf.set(name, str(BATCH_ROWS if rows <= 0 else min(BATCH_ROWS, rows)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; their rows stay as they are.

    Null and empty texts are scored by the bias alone. Repeated rows are scored one by one and
    stay repeated. Without labels every score is 0 and all stay. An empty table stays empty.
    """
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = with_scores(docs, labels, "__toxicity")
    return scored.where(scored["__toxicity"] < THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Texts without words, null ones among them, have no duplicates and stay, as often as they
    are there. Of rows that share the smallest id one stays, by the smallest hash of its text. A
    row without an id goes by that hash. An empty table stays empty.
    """
    bound_batches(spark)
    return one_of_each_class(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items.

    Null texts have no words and stay. Rows that share an id are judged by their own texts;
    repeated rows stay or go together. Without items all stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate(docs, items)
    return drop_rows(docs, judged.where("contaminated")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents in the target ratio of their sources, shuffled globally.

    A null source is one of its own. Repeated rows share their draw, so each gets as many
    copies. An empty table stays empty.
    """
    return mix(docs, root_weights(docs)).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written as binary chunks, and their digests read back from these files.

    A null text is an empty one and has the end id alone. Repeated rows are written each;
    rows that share an id go by their text. An empty table gives no rows.
    """
    bound_batches(spark)
    return token_digests(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

# SQL expresses neither the trained score nor MinHash nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's rows are stored for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.split()[0].replace('/', '')}")
    return STAGES[-1][1](spark, docs, sf_dir)
