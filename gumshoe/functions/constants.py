"""Constant arrays and maps as single expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A SQL string literal; "$" is escaped because SQL text substitutes ${...}."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def array_of(items: list[str]) -> Column:
    return F.expr(f"array({', '.join(map(quoted, items))})")


def map_of(table: dict[str, str]) -> Column:
    return F.expr(f"map({', '.join(quoted(x) for kv in table.items() for x in kv)})")
