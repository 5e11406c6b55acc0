"""Text patterns on lines, all evaluated in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions import patterns as P
from gumshoe.functions import text as T
from gumshoe.operators import js_scan
from gumshoe.operators.catalogue import PATTERN
from gumshoe.operators.lines import split_lines, trim_lines

JAVASCRIPT = ["javascript", "typescript"]


def _python_conditions(t: Column) -> list[tuple[Column, int, str]]:
    def has(word: str) -> Column:
        return F.contains(t, F.lit(word))

    return [
        (has("def") & has("=") & t.rlike(P.MUTABLE_DEFAULT), 11, "mutable_default"),
        (has("[") & t.rlike(P.INDEX_LARGE) & t.rlike(P.INDEX_ANY) & ~t.rlike(P.INDEX_GUARD), 12, "large_index"),
        (has("except") & t.rlike(P.BARE_EXCEPT) & ~t.rlike(P.TYPED_EXCEPT), 13, "bare_except"),
        (has("=") & (has("'") | has('"')) & t.rlike(P.SECRET_PY), 14, "hardcoded_secret"),
        (t.startswith("global "), 15, "global"),
    ]


def _hits(lines: DataFrame, conditions: list[tuple[Column, int, str]]) -> DataFrame:
    def hit(cond: Column, ord_: int, kind: str) -> Column:
        return F.when(
            cond,
            F.struct(
                F.lit("pattern_detector").alias("source"),
                F.lit(ord_).alias("ord"),
                F.lit(kind).alias("type"),
                F.lit(PATTERN[kind]["explanation"]).alias("message"),
            ),
        )

    hits = F.array(*[hit(*c) for c in conditions])
    found = lines.select("file_id", "language", "line", F.inline(hits)).filter(F.col("type").isNotNull())
    return found.withColumn("ord", F.col("line").cast("long") * 100 + F.col("ord"))


def python_pattern_hits(files: DataFrame) -> DataFrame:
    """Pattern hits of the python files as ``(file_id, language, line, source, ord, type, message)``."""
    lines = trim_lines(split_lines(files.filter(F.col("language") == "python")))
    return _hits(lines, _python_conditions(F.col("text")))


def pattern_hits_of_lines(lines: DataFrame) -> DataFrame:
    """The same for ``lines (file_id, language, line, text)`` of files that are too large for a row, python or javascript."""
    t, lines = F.col("text"), trim_lines(lines)
    python = lines.filter(F.col("language") == "python")
    script = lines.filter(F.col("language").isin(JAVASCRIPT) & ~T.is_js_comment(t))
    return _hits(python, _python_conditions(t)).unionByName(_hits(script, js_scan.line_pattern_conditions(t)))
