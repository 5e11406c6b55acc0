"""Files of any size as lines, read in byte ranges, and what the ranges of a file have to know of those before them.

Spark splits a text file into blocks that end at a line feed. Each line carries its file, the byte at which its block starts and a
number that grows inside the block, so that a file's lines have an order without being moved. What depends on earlier blocks (how
many lines there were, whether a quote is open) is summed up per block first, and then over the few blocks of a file.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gumshoe.functions import patterns as P
from gumshoe.functions import text as T
from gumshoe.lineage import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_BROADCAST = 500_000
"""Blocks whose summaries (about a hundred bytes each) may be broadcast; more of them are joined by a shuffle."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, at, raw)``: lines up to a line feed, a carriage return before it still there."""
    return (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("at"),
            F.col("value").alias("raw"),
        )
    )


def before_in_file() -> Window:
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def with_block_facts(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """``lines`` with the other columns of ``facts (file, block, ...)``, where they lie."""
    if facts.count() <= MOST_BROADCAST:
        facts = F.broadcast(facts)
    return lines.join(facts, ["file", "block"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, text)`` with lines numbered from 1, as :func:`gumshoe.functions.text.split_lines` numbers those of a whole file.

    A file that is not UTF-8 is read as Latin-1, like :func:`gumshoe.sources.files.decoded`. Two reads; no line is shuffled, and one
    large file is read by all tasks. Two differences at a file's ends: a byte order mark at its start is not part of the first line,
    and a rare break (such as a form feed) at its end adds an empty line.
    """
    lines = read_lines(spark, path)
    counted = lines.groupBy("file", "block").agg(
        F.sum(F.size(pieces(F.col("raw"), F.lit(True)))).alias("utf8"),
        F.sum(F.size(pieces(F.col("raw"), F.lit(False)))).alias("latin"),
        F.bool_and(F.is_valid_utf8("raw")).alias("valid"),
    )
    counted = counted.withColumn("valid", F.bool_and("valid").over(Window.partitionBy("file")))
    n = F.when(F.col("valid"), F.col("utf8")).otherwise(F.col("latin"))
    before = F.coalesce(F.sum(n).over(before_in_file()), F.lit(0))
    facts = keep(counted.select("file", "block", "valid", before.alias("lines_before")))
    found = with_block_facts(lines, facts).select("file", "block", "lines_before", pieces(F.col("raw"), F.col("valid")).alias("pieces"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = pc.list_value_length(batch["pieces"]).to_numpy().astype(np.int64)
            before = np.cumsum(n) - n  # in the batch
            changes = changed(batch["file"], batch["block"], place)
            # what came before the block inside this batch, or less than nothing for what earlier batches had of it
            base = np.full(len(n), -seen, dtype=np.int64)
            if len(changes):
                base = np.concatenate([[-seen], before[changes]])[np.searchsorted(changes, np.arange(len(n)), side="right")]
            first = batch["lines_before"].to_numpy() + before - base + 1
            seen = int(before[-1] + n[-1] - base[-1])
            place = (batch["file"][-1].as_py(), batch["block"][-1].as_py())
            yield pa.RecordBatch.from_arrays([batch["file"], pa.array(first), batch["pieces"]], names=["file", "first", "pieces"])

    placed = found.mapInArrow(number, "file string, first long, pieces array<string>")
    return placed.select("file", "first", F.posexplode("pieces").alias("piece", "text")).select(
        "file", (F.col("first") + F.col("piece")).alias("line"), "text"
    )


def changed(files: pa.Array, blocks: pa.Array, place: tuple | None) -> np.ndarray:
    """Rows at which another block starts; ``place`` is that of the row before the first."""
    at = blocks.to_numpy()
    differs = np.empty(len(at), dtype=bool)
    differs[0] = (files[0].as_py(), int(at[0])) != place
    differs[1:] = at[1:] != at[:-1]
    if len(at) > 1:
        differs[1:] |= pc.not_equal(files[1:], files[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs)


def pieces(raw: Column, valid: Column) -> Column:
    """The lines that a text up to a line feed holds: rare breaks end lines too."""
    read = F.when(valid, raw).otherwise(F.decode(raw.cast("binary"), "ISO-8859-1"))
    body = F.when(F.endswith(read, F.lit("\r")), F.left(read, F.length(read) - 1)).otherwise(read)
    return F.when(body.rlike(P.RARE_BREAK), F.split(T.plain_breaks(body), "\n")).otherwise(F.array(body))
