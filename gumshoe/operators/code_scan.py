"""Source files of all languages to risks, pattern hits and findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gumshoe.operators import catalogue, findings, js_scan, line_patterns, python_scan

BOUND = ["variable", "array", "function", "param"]
RISK_COLUMNS = ["file_id", "line", "ord", "type", "message", "variable", "array", "function", "param"]


@dataclass(frozen=True)
class CodeScan:
    """What a scan finds. Files in other languages have lines but no hits."""

    risks: DataFrame
    patterns: DataFrame


def scan(files: DataFrame, parsed: DataFrame | None = None) -> CodeScan:
    """Route files by language and collect risks and pattern hits. ``parsed`` are the python files, if they are parsed already.

    Both scans report a type once per line, so nothing needs to be compared
    across rows here.
    """
    js = js_scan.js_hits(files)
    py = python_scan.python_risks(python_scan.parse_python(files) if parsed is None else parsed)
    js_risks = js.filter(F.col("source") == "parser")
    js_patterns = js.filter(F.col("source") == "pattern_detector")
    py_patterns = line_patterns.python_pattern_hits(files)
    return CodeScan(
        risks=js_risks.select(RISK_COLUMNS).unionByName(py.select(RISK_COLUMNS)),
        patterns=js_patterns.select(py_patterns.columns).unionByName(py_patterns),
    )


COUNT_PRIORITY = 9


def candidate_findings(files: DataFrame, lint: DataFrame | None = None, with_counts: bool = False) -> DataFrame:
    """De-duplicated findings of all files, lint reports first.

    The javascript lines are read once: rules and patterns come out of the same
    pass. De-duplication moves the short hits; the sentences that describe
    them are added afterwards. ``with_counts`` adds a row of priority
    ``COUNT_PRIORITY`` per python file, whose ``ord`` is its number of functions.
    """
    js = js_scan.js_hits(files)
    py = python_scan.python_risks(python_scan.parse_python(files), with_counts)
    py = py.withColumn("source", F.lit("parser"))
    hits = js.unionByName(py).unionByName(
        line_patterns.python_pattern_hits(files), allowMissingColumns=True
    )
    parsed = F.col("source") == "parser"
    hits = hits.select(
        "file_id",
        F.col("line").alias("line_number"),
        F.when(parsed, catalogue.risk_bug_type()).otherwise(catalogue.pattern_bug_type()).alias("bug_type"),
        F.when(F.col("type") == python_scan.COUNT, COUNT_PRIORITY).when(parsed, 1).otherwise(2).alias("priority"),
        F.col("ord").cast("long").alias("ord"),
        F.when(parsed, F.col("message")).alias("explanation"),
        "type",
        *[F.col(c) for c in BOUND],
    )
    if lint is not None:
        severe = findings.describe_lint(lint).drop("impact", "suggested_fix")
        hits = hits.unionByName(
            severe.withColumnRenamed("source", "tool").withColumnRenamed("severity", "lint_severity"),
            allowMissingColumns=True,
        )
    first = findings.dedupe_findings(hits)
    return catalogue.describe(first, has_lint=lint is not None)
