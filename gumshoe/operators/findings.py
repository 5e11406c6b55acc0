"""Lint reports, rule hits and patterns brought together into findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gumshoe.operators import catalogue as C

SEVERE = ["high", "critical"]


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Spark limits each group before the shuffle,
    so a hot key sends one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") == 1).drop("_rank")


def dedupe_risks(risks: DataFrame) -> DataFrame:
    """First risk per file, type and line, in the order they were raised."""
    # Placed by file before the sort, as findings are: rows are sorted once, not in each task and again where they meet.
    return first_per_key(risks.repartition("file_id"), ["file_id", "type", "line"], ["ord", "variable", "function", "param"])


def severe_lint(lint: DataFrame) -> DataFrame:
    return lint.filter(F.col("severity").isin(SEVERE))


def describe_lint(lint: DataFrame) -> DataFrame:
    """Severe lint findings in the common shape; expects ``ord``, the report order."""
    severe = severe_lint(lint)
    return severe.select(
        "file_id",
        C.classify_lint(F.coalesce("issue", F.lit(""))).alias("bug_type"),
        F.coalesce(F.col("line"), F.lit(0)).cast("int").alias("line_number"),
        F.coalesce("issue", F.lit("")).alias("explanation"),
        C.impact_of_severity(F.col("severity")).alias("impact"),
        F.col("tool").alias("source"),
        "severity",
        F.lit("").alias("suggested_fix"),
        F.lit(0).alias("priority"),
        F.col("ord").cast("long").alias("ord"),
    )


def union_findings(lint: DataFrame | None, risks: DataFrame, patterns: DataFrame) -> DataFrame:
    """Lint first, then parser risks, then text patterns; duplicates kept."""
    out = C.describe_risks(risks).unionByName(C.describe_patterns(patterns))
    return out if lint is None else describe_lint(lint).unionByName(out)


def dedupe_findings(findings: DataFrame) -> DataFrame:
    """First finding per file, line and type, by source priority and then order."""
    # Placed by file, which one sort and later steps by file can use; a key's repeats come from one file.
    return first_per_key(
        findings.repartition("file_id"), ["file_id", "line_number", "bug_type"], ["priority", "ord", "explanation"]
    )
