"""Quality report of a table: missing, duplicate, mixed, empty and far-off values.

A report reads the table three times: one aggregate profiles all columns and sketches the numeric ones, one read of the numeric
columns counts what lies beside and inside the sketches' brackets, and a shuffle of fixed-width row keys counts duplicates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gumshoe.functions import text
from gumshoe.functions.text import quoted
from gumshoe.operators.quartiles import (
    fences,
    long_values,
    numeric_columns,
    outliers,
    quartiles,
    sketch_of,
)

SOURCE = "csv_analyzer"  # fixed value: the source name of table findings
SECTION = 1_000_000  # report order: section number, then column position

# The wording of table findings; {name} stands for a value.
WORDS = {
    "Missing Values": (
        "{column}: {n} values are missing ({pct}% of the rows)",
        "{n} rows are incomplete",
        "Fill the gaps in {column} or drop the rows",
    ),
    "Duplicate Rows": (
        "{n} of {rows} rows repeat an earlier row",
        "Counts and sums come out too high",
        "Keep one row of each",
    ),
    "Type Mismatch": (
        "{column}: {n} of {present} values are numbers, the others are text",
        "Arithmetic on the column fails",
        "Convert {column} to numbers and look at what does not convert",
    ),
    "Empty Columns": (
        "No values at all in: {column}",
        "They take space and tell nothing",
        "Drop these columns: {column}",
    ),
    "Data Anomaly": (
        "{column}: {n} values lie more than three interquartile ranges out",
        "Averages and models are pulled off",
        "Look at the rows where {column} > {upper}",
    ),
    "No Issues": (
        "Nothing found in {rows} rows and {columns} columns",
        "None",
        "Nothing to do",
    ),
}


def column_kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "number"
    return "text" if isinstance(data_type, T.StringType) else "other"


def _missing(field: T.StructField) -> Column:
    c = quoted(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def profile_row(df: DataFrame, with_sketches: bool = False) -> DataFrame:
    """One row: ``n_rows`` and ``columns``, an array of what :func:`profile` returns and, if asked for, of ``sketch``, null but for numbers.

    All columns are counted in a single aggregation without grouping.
    """
    fields = df.schema.fields
    aggs = [F.count("*").alias("n_rows")]
    for i, f in enumerate(fields):
        aggs.append(F.count_if(_missing(f)).alias(f"m{i}"))
        if column_kind(f.dataType) == "text":
            aggs.append(F.count_if(text.is_number(quoted(f.name))).alias(f"k{i}"))
        if with_sketches and column_kind(f.dataType) == "number":
            aggs.append(sketch_of(quoted(f.name)).alias(f"s{i}"))
    counts = df.agg(*aggs)

    def column(i: int, f: T.StructField) -> Column:
        kind = column_kind(f.dataType)
        parts = [
            F.lit(i).alias("pos"),
            F.lit(f.name).alias("column_name"),
            F.lit(kind).alias("kind"),
            "n_rows",
            F.col(f"m{i}").alias("n_missing"),
            (F.col("n_rows") - F.col(f"m{i}")).alias("n_present"),
            (F.col(f"k{i}") if kind == "text" else F.lit(0).cast("bigint")).alias("n_numeric"),
        ]
        if with_sketches:
            parts.append((F.col(f"s{i}") if kind == "number" else F.lit(None).cast("binary")).alias("sketch"))
        return F.struct(*parts)

    shape = "array<struct<pos:int,column_name:string,kind:string,n_rows:bigint,n_missing:bigint,n_present:bigint,n_numeric:bigint"
    shape += ",sketch:binary>>" if with_sketches else ">>"
    return counts.select("n_rows", F.array(*[column(i, f) for i, f in enumerate(fields)]).cast(shape).alias("columns"))


def sketches_of(profiled: DataFrame) -> DataFrame:
    """``(column_name, sketch)`` of the numeric columns, from a profile made with sketches."""
    return profiled.select(F.inline("columns")).filter("sketch is not null").select("column_name", "sketch")


def profile(df: DataFrame) -> DataFrame:
    """One row per column: position, name, kind, rows, missing, present and numeric counts."""
    return profile_row(df).select(F.inline("columns"))


def row_and_column_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, ties to the even digit."""
    return F.bround(part * 100 / whole, 1)


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with missing values, their share and its severity."""
    pct = percent(F.col("n_missing"), F.col("n_rows"))
    return (
        profile(df)
        .filter(F.col("n_missing") > 0)
        .select("pos", "column_name", "n_missing", pct.alias("pct"), F.when(pct > 30, "high").otherwise("medium").alias("severity"))
    )


def _framed(value: Column) -> Column:
    """A text that tells where it ends, so that texts behind one another cannot be mistaken for others; null is a sign of its own."""
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("~"))


def exact_text(value: Column, kind: T.DataType) -> Column:
    """A text that two values share only if they are equal; null for null. Zeros are one, so are NaNs and maps in any order."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (value + F.lit(0).cast(kind)).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: _framed(exact_text(x, kind.elementType))), "")
    if isinstance(kind, T.StructType):
        inside = F.concat(F.lit(""), *[_framed(exact_text(value[f.name], f.dataType)) for f in kind.fields])
        return F.when(value.isNotNull(), inside)
    if isinstance(kind, T.MapType):
        pair = lambda e: F.concat(_framed(exact_text(e["key"], kind.keyType)), _framed(exact_text(e["value"], kind.valueType)))
        return F.array_join(F.sort_array(F.transform(F.map_entries(value), lambda e: _framed(pair(e)))), "")
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    return value.cast("string")  # whole numbers, decimals of one scale, dates, times and intervals


def row_key(df: DataFrame) -> Column:
    """32 bytes for a whole row: equal for rows with equal values, of whatever types."""
    values = [_framed(exact_text(quoted(f.name), f.dataType)) for f in df.schema.fields]
    return F.unhex(F.sha2(F.concat(F.lit(""), *values), 256)).alias("key")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows in all, and rows that repeat an earlier one (nulls are equal)."""
    groups = df.select(row_key(df)).groupBy("key").agg(F.count("*").alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"),
    )


def mixed_type_columns(df: DataFrame) -> DataFrame:
    """Text columns where more than half, but not all, of the values are numbers."""
    return profile(df).filter(_is_mixed(F.col)).select("pos", "column_name", "n_numeric", "n_present")


def _is_mixed(field: Callable[[str], Column]) -> Column:
    numeric, present = field("n_numeric"), field("n_present")
    return (field("kind") == "text") & (numeric > 0) & (numeric < present) & (numeric > present * 0.5)


def empty_columns(df: DataFrame) -> DataFrame:
    """Columns without any value, in table order."""
    return profile(df).filter(F.col("n_present") == 0).select("pos", "column_name")


def column_quartiles(df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """Exact ``(column_name, n, q1, q3)`` per numeric column; with ``accuracy`` approximate, in one pass."""
    columns = numeric_columns(df) if columns is None else columns
    return quartiles(long_values(df, columns), accuracy)


def iqr_outliers(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """Numeric columns with values beyond the fences: ``(column_name, n_outliers, lower, upper)``."""
    return outliers(long_values(df), accuracy)


def outlier_rows(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """The rows whose value lies above the upper fence."""
    upper = fences(column_quartiles(df, [column], accuracy)).select("upper")
    return df.filter(quoted(column) > upper.scalar())


# ---------------------------------------------------------------- report


def _finding(kind: str, ord_: Column, severity: Column, column: Column, values: dict[str, Column]) -> Column:
    def words(i: int) -> Column:
        return reduce(
            lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), kv[1].cast("string")),
            values.items(),
            F.lit(WORDS[kind][i]),
        )

    return F.struct(
        ord_.cast("bigint").alias("ord"),
        F.lit(kind).alias("bug_type"),
        F.lit(0).alias("line_number"),
        column.alias("column_name"),
        words(0).alias("explanation"),
        words(1).alias("impact"),
        severity.alias("severity"),
        words(2).alias("suggested_fix"),
        F.lit(SOURCE).alias("source"),
    )


def _profile_findings(profiled: DataFrame) -> DataFrame:
    """Missing, mixed and empty findings and the clean row, all from the one row of a profile."""
    none = F.lit(None).cast("string")

    def of_column(c: Column) -> Column:
        name, n, pct = c["column_name"], c["n_missing"], percent(c["n_missing"], c["n_rows"])
        missing = _finding(
            "Missing Values", SECTION + c["pos"], F.when(pct > 30, "high").otherwise("medium"), name, {"column": name, "n": n, "pct": pct}
        )
        mixed = _finding(
            "Type Mismatch", 3 * SECTION + c["pos"], F.lit("high"), name, {"column": name, "n": c["n_numeric"], "present": c["n_present"]}
        )
        return F.array(F.when(n > 0, missing), F.when(_is_mixed(c.getField), mixed))

    columns = F.col("columns")
    empty = F.transform(F.filter(columns, lambda c: c["n_present"] == 0), lambda c: c["column_name"])
    empty = F.when(
        F.size(empty) > 0, _finding("Empty Columns", F.lit(4 * SECTION), F.lit("low"), none, {"column": F.array_join(empty, ", ")})
    )
    clean = _finding(
        "No Issues", F.lit(6 * SECTION), F.lit("info"), none, {"rows": F.col("n_rows"), "columns": F.size(columns)}
    )
    found = F.concat(F.flatten(F.transform(columns, of_column)), F.array(empty, clean))
    return profiled.select(F.inline(F.array_compact(found)))


def table_quality_report(df: DataFrame, table_name: str, accuracy: int | None = None) -> DataFrame:
    """Every finding of a table in report order, or a single clean row."""
    numbers = bool(numeric_columns(df))
    profiled = profile_row(df, with_sketches=numbers and accuracy is None)
    far = None
    if numbers:
        known = sketches_of(profiled) if accuracy is None else None
        far = outliers(long_values(df), accuracy, known)
    return report_of(profiled, duplicate_rows(df), far, df.columns, table_name)


def report_of(profiled: DataFrame, duplicates: DataFrame, far: DataFrame | None, columns: list[str], table_name: str) -> DataFrame:
    """The report from its parts: the rows of :func:`profile_row`, :func:`duplicate_rows` and :func:`outliers`."""
    none = F.lit(None).cast("string")
    parts = [_profile_findings(profiled)]
    repeated = _finding(
        "Duplicate Rows", F.lit(2 * SECTION), F.lit("medium"), none, {"n": F.col("n_duplicates"), "rows": F.col("n_rows")}
    )
    parts.append(duplicates.filter(F.col("n_duplicates") > 0).select(repeated.alias("f")).select("f.*"))
    if far is not None:
        positions = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
        anomaly = _finding(
            "Data Anomaly", 5 * SECTION + F.element_at(positions, F.col("column_name")), F.lit("medium"),
            F.col("column_name"),
            {"column": F.col("column_name"), "n": F.col("n_outliers"), "upper": F.format_string("%.2f", F.col("upper"))},
        )
        parts.append(far.select(anomaly.alias("f")).select("f.*"))
    out = reduce(DataFrame.unionByName, parts)
    # The clean row stays only where it stands alone; a report has few rows.
    found = F.count_if(F.col("bug_type") != "No Issues").over(Window.partitionBy("table_name"))
    return (
        out.select(F.lit(table_name).alias("table_name"), "*")
        .withColumn("_found", found)
        .filter((F.col("bug_type") != "No Issues") | (F.col("_found") == 0))
        .drop("_found")
    )


def total_real_findings(report: DataFrame) -> DataFrame:
    return report.groupBy("table_name").agg(F.count_if(F.col("bug_type") != "No Issues").alias("total_bugs"))


def is_clean(report: DataFrame) -> DataFrame:
    return report.groupBy("table_name").agg((F.count_if(F.col("bug_type") != "No Issues") == 0).alias("is_clean"))
