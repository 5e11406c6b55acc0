"""From documents to token files: each stage works on the rows that the one before it kept."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gumshoe.llm import mixing, stages, token_files  # noqa: E402
from gumshoe.llm.queries import toxicity_model, vocabulary  # noqa: E402
from gumshoe.llm.store import Owner, new_folder, table  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
MIX_SEED = 20240601
"""The mix of a run: another seed draws other offsets, so that no document is left out of every mix."""


_tables = Owner()
"""What the stage called last has stored: its rows are written by the time the next stage is called."""


def _stage(step: Stage) -> Stage:
    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _tables.delete(spark)
        with _tables.holding():
            return step(spark, docs, sf_dir)

    return run_step


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold.

    A null or empty text has the score of the bias and stays if that is under it; rows that repeat are scored alike; without labels
    the score is the share of toxic ones, none; extra columns pass.
    """
    return stages.not_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near copies.

    Texts without words are in no class and stay; null ids give way to others; of rows that repeat id and text one stays, whatever
    its other columns hold.
    """
    return stages.one_of_each_class(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null texts have none; an empty benchmark drops nothing."""
    return stages.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: copies are rows that repeat.

    A null source is a source; null and empty texts have size 0 and are taken like others of their source; a source without words
    is not taken at all.
    """
    return mixing.mixed(docs, seed=MIX_SEED)


@_stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files and what is read back from them, a row for each document row; a null or empty text holds the end id only."""
    return token_files.token_digests(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
ORACLE_SQL = None
"""SQL cannot train the classifier; the tests compare each stage with a plain version of it."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, start, n_tokens, ids_crc32 of the written token files.

    Each stage's tables go once its rows are written, and those once the next stage has read them: the token files stay.
    """
    docs, before = table(spark, sf_dir, "documents"), Owner()
    for name, stage in STAGES[:-1]:
        after = Owner()
        with after.holding():
            path = new_folder(spark, f"stage-{name}")
        inside = Owner()
        with inside.holding():
            rows = stage.__wrapped__(spark, docs, sf_dir)
            rows.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        inside.delete(spark)
        before.delete(spark)
        before = after
    rows = STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
    before.delete(spark)  # the last stage reads its own files
    return rows
