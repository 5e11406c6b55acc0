"""Scans that parse only what changed since the runs before.

Below ``store`` each run leaves the digest of every file it scanned and the findings of these files. A later run compares digests
first: a file whose id, language and content were scanned before, in any run, is not parsed again; its findings are read. Digests
are brought to the files by id to tell the two apart: contents that are dealt out by file stay in place. The contents that are
scanned are kept until their findings are written. Writing a run again replaces it, and does not see itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gumshoe.lineage import exists, keep, kept_until_end
from gumshoe.operators.code_scan import candidate_findings

STATE = ["file_id", "digest"]
SCANNED = "file_id string, digest string, run string"


def with_digest(files: DataFrame) -> DataFrame:
    """Add ``digest``, of the language and the content: another language is scanned by other rules."""
    return files.withColumn("digest", F.sha2(F.concat_ws("\n", F.coalesce("language", F.lit("")), F.coalesce("content", F.lit(""))), 256))


def _read(spark: SparkSession, store: str, part: str, schema: str | StructType, run: str) -> DataFrame | None:
    """What runs but this one have left, or None before the first."""
    path = f"{store}/{part}"
    if not exists(spark, path):
        return None
    return spark.read.schema(schema).option("basePath", path).parquet(path).filter(F.col("run") != run)


def changed_files(files: DataFrame, store: str, run: str) -> DataFrame:
    """The files, with their digest, that no other run has scanned as they are."""
    files = with_digest(files)
    known = _read(files.sparkSession, store, "files", SCANNED, run)
    if known is None:
        return files
    known = known.groupBy("file_id").agg(F.collect_set("digest").alias("known"))  # as many as there are runs, at most
    again = F.coalesce(F.array_contains("known", F.col("digest")), F.lit(False))
    return files.filter(F.col("file_id").isNotNull()).join(known, "file_id", "left").filter(~again).drop("known")


def rescan(files: DataFrame, store: str, run: str) -> DataFrame:
    """Findings of all ``files (file_id, language, content)``, as :func:`candidate_findings` gives them, scanning what changed."""
    spark = files.sparkSession
    with kept_until_end(spark):
        changed = keep(changed_files(files, store, run))
        found = candidate_findings(changed.drop("digest")).join(changed.select(*STATE), "file_id")
        found.write.mode("overwrite").parquet(f"{store}/findings/run={run}")
        changed.select(*STATE).write.mode("overwrite").parquet(f"{store}/files/run={run}")
    spark.catalog.refreshByPath(store)
    fresh = spark.read.schema(found.schema).parquet(f"{store}/findings/run={run}")  # all of files as they are
    earlier = _read(spark, store, "findings", found.schema.add("run", "string"), run)
    current = with_digest(files).select(*STATE).distinct()
    return earlier.join(current, STATE, "left_semi").drop("run").unionByName(fresh).drop("digest")


def scanned_files(spark: SparkSession, store: str, run: str) -> DataFrame:
    """``(file_id)`` that a run has parsed."""
    return spark.read.schema("file_id string, digest string").parquet(f"{store}/files/run={run}").select("file_id")
