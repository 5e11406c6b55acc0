"""Operators as filters of a documents table: the columns stay, decisions become rows that go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import decontamination, ngram_join, toxicity
from .store import broadcast_if_small, stored, unused


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without ``rows (doc_id, key)``, where key is the hash of the text."""
    return docs.join(broadcast_if_small(rows), _same(docs, rows), "left_anti")


def _same(docs: DataFrame, rows: DataFrame):
    return docs["doc_id"].eqNullSafe(rows["doc_id"]) & (F.xxhash64(docs["text"]) == rows["key"])


def not_toxic(docs: DataFrame, model: toxicity.Model, threshold: float = toxicity.THRESHOLD) -> DataFrame:
    score = unused(docs, "score")
    return toxicity.with_scores(docs, model, score).where(F.col(score) < threshold).select(*docs.columns)


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The first document of each class of near copies; of rows that repeat an id and a text, one."""
    classes = stored(ngram_join.classes_of(docs), "classes")
    gone = stored(classes.where(~F.col("kept")).select("doc_id", "key").distinct(), "gone")
    again = stored(
        classes.where("kept").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "key"), "again"
    )
    left = without(docs, gone)
    repeated = left.join(broadcast_if_small(again), _same(docs, again), "left_semi")
    key = unused(docs, "key")
    repeated = repeated.withColumn(key, F.xxhash64("text")).dropDuplicates(["doc_id", key]).select(*docs.columns)
    return without(left, again).unionByName(repeated)


def uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = decontamination.contamination(docs, items).where("contaminated").select("doc_id", "key").distinct()
    return without(docs, stored(found, "contaminated"))
