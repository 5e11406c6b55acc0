"""Files to numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.functions import text as T


def split_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line: every other column of ``files`` plus ``line`` and ``text``.

    Lines are numbered from 1. A narrow step: no shuffle, whole texts.
    """
    keep = [c for c in files.columns if c != content]
    plain = "plain " + max(files.columns, key=len)  # a column of its own: its breaks are looked for once
    files = files.select(*keep, T.plain_breaks(F.col(content)).alias(plain))
    return files.select(*keep, F.posexplode(T.split_plain_lines(T.quoted(plain))).alias("pos", "text")).select(
        *keep, (F.col("pos") + 1).alias("line"), "text"
    )


def trim_lines(lines: DataFrame) -> DataFrame:
    """Trimmed in an explode of one element: a later filter of ``text`` reads its result, where it would repeat a plain expression."""
    return lines.withColumn("text", F.explode(F.array(T.strip_line(F.col("text")))))


def drop_comment_lines(lines: DataFrame) -> DataFrame:
    """Drop trimmed lines that start a javascript comment."""
    return lines.filter(~T.is_js_comment(F.col("text")))


def line_counts(files: DataFrame) -> DataFrame:
    return files.select("file_id", T.line_count(F.col("content")).alias("line_count"))


def without_strings(lines: DataFrame) -> DataFrame:
    """``text`` as :func:`T.strip_comments_and_strings` has it; a column for each cut, so that a line is searched only for what it has."""
    text = F.col("text")
    for mark, pattern, rest in T.CUTS:
        lines = lines.withColumn("text", F.when(F.contains(text, F.lit(mark)), F.regexp_replace(text, pattern, rest)).otherwise(text))
    return lines


def tokenize(lines: DataFrame) -> DataFrame:
    """One row per identifier of a line, comments and quoted text left out."""
    return without_strings(lines).select("file_id", "line", F.posexplode(T.identifiers(F.col("text"))).alias("pos", "token"))
