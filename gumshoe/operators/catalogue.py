"""The rule vocabulary: finding types, severities, and the wording of reports.

Types and severities are fixed values; the sentences are this project's own.
``{name}`` in a sentence stands for a value bound by the rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gumshoe.functions.constants import map_of

# ---- fixed values: risk type, finding type, severity -----------------------
RISKS = [
    ("division", "Division by Zero", "high"),
    ("bare_except", "Bare Except", "medium"),
    ("syntax_error", "Syntax Error", "critical"),
    ("security", "Security Vulnerability", "critical"),
    ("off_by_one", "Off-by-One Error", "high"),
    ("undefined_variable", "Undefined Variable", "high"),
    ("null_reference", "Null Reference", "high"),
    ("out_of_bounds", "Index Out of Bounds", "high"),
    ("null_argument", "Null Argument Passed", "high"),
    ("negative_sqrt", "Negative Square Root", "high"),
    ("zero_argument", "Zero Division Argument", "high"),
]
RISK_DEFAULT = ("Runtime Risk", "medium", "May fail while running")

IMPACT = {
    "division": "The run stops when the divisor is zero",
    "bare_except": "Serious errors can pass unnoticed",
    "syntax_error": "The file cannot be run at all",
    "security": "Foreign code may be executed",
    "off_by_one": "Reads one element too many and carries an undefined value along",
    "undefined_variable": "The run stops at the first use of the name",
    "null_reference": "The run stops when the object is missing",
    "out_of_bounds": "The run stops when the index passes the end",
    "null_argument": "The callee fails as soon as it uses the argument",
    "negative_sqrt": "The run stops for a value below zero",
    "zero_argument": "The callee may divide by the zero it is given",
}

# What {name} becomes in a fix when the rule bound nothing to it.
FIX_DEFAULT = {
    "off_by_one": {"variable": "i", "array": "array"},
    "undefined_variable": {"variable": "variable"},
    "null_reference": {"variable": "obj"},
    "out_of_bounds": {"variable": "list"},
    "null_argument": {"function": "function"},
    "zero_argument": {"function": "function", "param": "param"},
}
FIX = {
    "division": "Test that the divisor is not zero first",
    "bare_except": "Name the exceptions this handler is meant for",
    "syntax_error": "Correct the syntax on the reported line",
    "security": "Replace eval() with a parser made for the data",
    "off_by_one": "Stop at {variable} < {array}.length; the last valid index is length - 1",
    "undefined_variable": "Declare {variable} before this line or correct its spelling",
    "null_reference": "Check {variable} for null first, or write {variable}?. for the access",
    "out_of_bounds": "Compare the index with the length of {variable} before reading it",
    "null_argument": "Let {function}() check its parameter before using it",
    "negative_sqrt": "Make sure the argument is not negative, or use cmath.sqrt()",
    "zero_argument": "Reject 0 for {param} before calling {function}(), or handle the error inside",
}
FIX_OTHER = "Look at the reported line and correct it"

MESSAGE = {
    "js": {
        "off_by_one": "{variable} <= {array}.length runs one step past the last element",
        "out_of_bounds": "{array}[{index} + {step}] can lie behind the end of the array",
        "null_reference": "Parameter {variable} may be null when .{member} is read",
        "division": "Dividing by {variable}, which may be zero",
        "undefined_variable": "{variable} is used but never declared in this file",
        "null_argument": "{function}() is called with null",
        "security": "eval() runs whatever text it is given",
    },
    "py": {
        "division": "A division whose divisor may be zero",
        "bare_except": "This handler catches every exception",
        "negative_sqrt": "math.sqrt() fails for a negative argument",
        "zero_argument": "{function}() gets a literal 0 for {param}",
        "out_of_bounds": "{variable} is read at an index moved by {step}",
        "undefined_variable": "{variable} is not defined anywhere in this file",
    },
}

# Patterns matched on the text of one line.
PATTERN = {
    "mutable_default": {
        "bug_type": "Mutable Default Argument", "severity": "high",
        "explanation": "The default value is one object shared by all calls",
        "impact": "A change made by one call is seen by the next",
        "fix": "Default to None and create the value inside the function",
    },
    "large_index": {
        "bug_type": "Index Out of Range", "severity": "medium",
        "explanation": "A large fixed index is read without a length check",
        "impact": "The run stops when the collection is shorter",
        "fix": "Check the length before reading",
    },
    "bare_except": {
        "bug_type": "Bare Except", "severity": "medium",
        "explanation": "A handler without a type also catches interrupts and exits",
        "impact": "Errors stay hidden and are hard to trace",
        "fix": "List the exceptions to catch",
    },
    "hardcoded_secret": {
        "bug_type": "Hardcoded Secret", "severity": "critical",
        "explanation": "A credential seems to be written into the text",
        "impact": "Whoever can read the file can use it",
        "fix": "Read it from a secret store or the environment",
    },
    "global": {
        "bug_type": "Global Variable Usage", "severity": "low",
        "explanation": "The function changes module-wide state",
        "impact": "Harder to test and to follow",
        "fix": "Pass the value as a parameter",
    },
    "loose_equality": {
        "bug_type": "Loose Equality", "severity": "medium",
        "explanation": "== converts its operands before comparing them",
        "impact": "Values of different types may compare as equal",
        "fix": "Compare with ===",
    },
    "eval": {
        "bug_type": "Security Vulnerability", "severity": "critical",
        "explanation": "eval() executes any code it is handed",
        "impact": "An attacker can inject code",
        "fix": "Parse data with JSON.parse() or another safe reader",
    },
}
PATTERN["hardcoded_secret_js"] = PATTERN["hardcoded_secret"]

# ---- fixed values: lint severities and the words that classify a message ---
PYLINT_SEVERITY = {
    "error": "high", "fatal": "critical", "warning": "medium",
    "convention": "low", "refactor": "low", "information": "info",
}
LINT_CLASSES = [
    (["undefined", "not defined"], "Undefined Variable"),
    (["import"], "Import Error"),
    (["syntax"], "Syntax Error"),
    (["type"], "Type Error"),
    (["unused"], "Unused Code"),
    (["not callable"], "Not Callable"),
]
LINT_OTHER = "Code Issue"

SEVERITY_IMPACT = {
    "critical": "Crash or security hole",
    "high": "Likely to fail while running",
    "medium": "May behave in unexpected ways",
    "low": "Lowers code quality",
    "info": "For information",
}
SEVERITY_IMPACT_OTHER = "Impact not known"


def filled(template: Column, values: dict[str, Column]) -> Column:
    """Put bound values into a sentence."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), kv[1]), values.items(), template)


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """A small fixed table as a map expression; no join needed."""
    return F.coalesce(F.element_at(map_of(table), key), F.lit(default))


def pylint_severity(kind: Column) -> Column:
    return lookup(kind, PYLINT_SEVERITY, "medium")


def eslint_severity(level: Column) -> Column:
    return F.when(F.coalesce(level, F.lit(1)) == 2, "high").otherwise("medium")


def classify_lint(issue: Column) -> Column:
    """The first class whose words occur in the message."""
    text = F.lower(issue)
    chain = F
    for words, name in LINT_CLASSES:
        cond = reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])
        chain = chain.when(cond, name)
    return chain.otherwise(LINT_OTHER)


def impact_of_severity(severity: Column) -> Column:
    return lookup(severity, SEVERITY_IMPACT, SEVERITY_IMPACT_OTHER)


def fix_text(kind: Column) -> Column:
    """The fix for a risk, with the row's bound values filled in."""
    out = F
    for name, sentence in FIX.items():
        defaults = FIX_DEFAULT.get(name, {})
        text = filled(F.lit(sentence), {k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})
        out = out.when(kind == name, text)
    return out.otherwise(FIX_OTHER)


def _risk(table: dict[str, str], default: str) -> Column:
    return lookup(F.col("type"), table, default)


def _pattern(field: str) -> Column:
    return lookup(F.col("type"), {k: v[field] for k, v in PATTERN.items()}, "")


def risk_bug_type() -> Column:
    return _risk({r: b for r, b, _ in RISKS}, RISK_DEFAULT[0])


def risk_severity() -> Column:
    return _risk({r: s for r, _, s in RISKS}, RISK_DEFAULT[1])


def pattern_bug_type() -> Column:
    return _pattern("bug_type")


def describe(hits: DataFrame, has_lint: bool) -> DataFrame:
    """Complete short hits to findings; ``priority`` tells lint, risk and pattern apart."""
    risk = F.col("priority") == 1
    severity = F.when(risk, risk_severity()).otherwise(_pattern("severity"))
    source = F.when(risk, "parser").otherwise("pattern_detector")
    impact = F.when(risk, _risk(IMPACT, RISK_DEFAULT[2])).otherwise(_pattern("impact"))
    fix = F.when(risk, fix_text(F.col("type"))).otherwise(_pattern("fix"))
    if has_lint:
        lint = F.col("priority") == 0
        severity = F.when(lint, F.col("lint_severity")).otherwise(severity)
        source = F.when(lint, F.col("tool")).otherwise(source)
        impact = F.when(lint, impact_of_severity(F.col("lint_severity"))).otherwise(impact)
        fix = F.when(lint, F.lit("")).otherwise(fix)
    return hits.select(
        "file_id",
        "bug_type",
        "line_number",
        F.coalesce("explanation", _pattern("explanation")).alias("explanation"),
        impact.alias("impact"),
        source.alias("source"),
        severity.alias("severity"),
        fix.alias("suggested_fix"),
        "priority",
        "ord",
    )


def describe_risks(risks: DataFrame) -> DataFrame:
    """Risk rows to findings: type, severity, impact and fix from the vocabulary."""
    hits = risks.withColumns(
        {
            "bug_type": risk_bug_type(),
            "line_number": F.col("line"),
            "explanation": F.col("message"),
            "priority": F.lit(1),
            "ord": F.col("ord").cast("long"),
        }
    )
    return describe(hits, has_lint=False)


def describe_patterns(hits: DataFrame) -> DataFrame:
    """Pattern hits to findings."""
    none = F.lit(None).cast("string")
    hits = hits.withColumns(
        {
            "bug_type": pattern_bug_type(),
            "line_number": F.col("line"),
            "explanation": none,
            "priority": F.lit(2),
            **{c: none for c in ("variable", "array", "function", "param")},
        }
    )
    return describe(hits, has_lint=False)
