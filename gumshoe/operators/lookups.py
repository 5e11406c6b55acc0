"""Uses of names against the definitions of the same file, inside one row.

Definitions and uses are one array. Sorted by scope and name, the entries of a
name lie side by side, definitions first, so a name is known if the first of its
entries is a definition. No array of more than :data:`FEW` names is searched once per use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


FEW = 64
"""Names that a list may hold to be searched once per use; files with more are looked up by sorting."""


def _entry(scope: str, name: Column, used: int, line: Column, at: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(scope).alias("scope"),
        name.alias("name"),
        F.lit(used).alias("used"),
        line.cast("int").alias("line"),
        at.cast("int").alias("at"),
        detail.cast("string").alias("detail"),
    )


def definitions(scope: str, names: Column) -> Column:
    return F.transform(names, lambda n: _entry(scope, n, 0, F.lit(0), F.lit(0), F.lit(None)))


def use(scope: str, name: Column, line: Column, at: Column | None = None, detail: Column | None = None) -> Column:
    """``at`` orders the uses within a line."""
    return _entry(scope, name, 1, line, F.lit(0) if at is None else at, F.lit(None) if detail is None else detail)


def resolved(df: DataFrame, entries: str, undefined: list[str], listed: Column) -> DataFrame:
    """Leave the first use of each line and scope that counts, by line.

    In the scopes of ``undefined`` uses without a definition count, in all
    others those with one. Where ``listed`` is true, the entries are only uses, and all of them count.
    """
    none = F.array().cast("array<struct<start:int,first:boolean,counts:boolean>>")
    placed = df.withColumn("_listed", listed).withColumn(entries, F.when(F.col("_listed"), F.col(entries)).otherwise(F.sort_array(entries)))

    def starts(e: Column, i: Column) -> Column:
        before = F.get(entries, i - 1)
        return F.coalesce((before["name"] != e["name"]) | (before["scope"] != e["scope"]), F.lit(True))

    heads = F.filter(
        F.transform(
            entries,
            lambda e, i: F.struct(
                i.alias("start"), starts(e, i).alias("first"), (e["scope"].isin(undefined) == (e["used"] == 1)).alias("counts")
            ),
        ),
        lambda h: h["first"],
    )
    placed = placed.withColumn("_heads", F.when(F.col("_listed"), none).otherwise(heads))
    spans = F.transform(
        "_heads",
        lambda h, i: F.struct(
            h["start"].alias("start"),
            (F.coalesce(F.get("_heads", i + 1)["start"], F.size(entries)) - h["start"]).alias("length"),
            h["counts"].alias("counts"),
        ),
    )

    def by_line(e: Column) -> Column:
        return F.struct(*[e[c].alias(c) for c in ("line", "scope", "at", "name", "detail")])

    uses = F.flatten(
        F.transform(
            F.filter(spans, lambda g: g["counts"]),
            lambda g: F.transform(F.filter(F.slice(entries, g["start"] + 1, g["length"]), lambda e: e["used"] == 1), by_line),
        )
    )
    found = placed.withColumn("_uses", F.sort_array(F.when(F.col("_listed"), F.transform(entries, by_line)).otherwise(uses)))

    def leads(e: Column, i: Column) -> Column:
        before = F.get("_uses", i - 1)
        return F.coalesce((before["line"] != e["line"]) | (before["scope"] != e["scope"]), F.lit(True))

    return found.withColumn(entries, F.filter("_uses", leads)).drop("_listed", "_heads", "_uses")
