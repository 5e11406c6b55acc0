"""Table audits batch by batch: what a batch adds is stored once and merged, earlier batches are not profiled again.

Below ``path`` each batch leaves, per column, its counts and a quantile sketch, and per distinct row a key of 32 bytes with
its number of copies. All of it adds up: counts are summed, keys are counted over all batches, sketches are merged. Exact fences
need one read of the numeric columns of all batches, whose values the merged sketches narrow down. Writing a batch again
replaces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.operators import quality
from gumshoe.operators.quartiles import long_values, merged, numeric_columns, outliers

COLUMNS = (
    "pos int, column_name string, kind string, n_rows bigint, n_missing bigint, n_present bigint, n_numeric bigint, sketch binary, "
    "batch string"
)
KEYS = "key binary, copies bigint, batch string"


def audit_batch(rows: DataFrame, path: str, batch: str) -> None:
    """Store what a batch adds; two reads of the batch."""
    columns = quality.profile_row(rows, with_sketches=True).select(F.inline("columns"))
    columns.write.mode("overwrite").parquet(f"{path}/columns/batch={batch}")
    keys = rows.select(quality.row_key(rows)).groupBy("key").agg(F.count("*").alias("copies"))
    keys.write.mode("overwrite").parquet(f"{path}/keys/batch={batch}")


def _read(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{path}/{part}").parquet(f"{path}/{part}")


def merged_profile(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`quality.profile_row` returns, for all batches together; they must have the same columns."""
    stored = _read(spark, path, "columns", COLUMNS)
    sums = [F.sum(c).alias(c) for c in ("n_rows", "n_missing", "n_present", "n_numeric")]
    per_column = stored.groupBy("pos", "column_name", "kind").agg(*sums)
    one = F.struct("pos", "column_name", "kind", "n_rows", "n_missing", "n_present", "n_numeric")
    # as many rows as the schema has columns
    return per_column.agg(F.max("n_rows").alias("n_rows"), F.sort_array(F.collect_list(one)).alias("columns"))


def merged_duplicates(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`quality.duplicate_rows` returns, for all batches together."""
    groups = _read(spark, path, "keys", KEYS).groupBy("key").agg(F.sum("copies").alias("copies"))
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicates"),
    )


def merged_sketches(spark: SparkSession, path: str) -> DataFrame:
    """``(column_name, sketch)`` of all batches together."""
    return merged(_read(spark, path, "columns", COLUMNS).select("column_name", "sketch").filter("sketch is not null"))


def audited_report(table: DataFrame, path: str, table_name: str) -> DataFrame:
    """The report of all audited batches. ``table`` are their rows; only its numeric columns are read, once."""
    spark = table.sparkSession
    far = outliers(long_values(table), known=merged_sketches(spark, path)) if numeric_columns(table) else None
    return quality.report_of(merged_profile(spark, path), merged_duplicates(spark, path), far, table.columns, table_name)
