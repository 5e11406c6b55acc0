"""Files from storage: reading, type and size checks, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gumshoe.functions import patterns as P
from gumshoe.functions import text
from gumshoe.functions.constants import map_of

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where valid, else as Latin-1."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def allowed(path: Column) -> Column:
    return suffix(path).isin(P.ALLOWED_SUFFIXES)


def filter_allowed_types(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of known types, and the rejected rest."""
    ok = allowed(F.col("path"))
    return files.filter(ok), files.filter(~ok)


def filter_size_cap(files: DataFrame, max_bytes: int) -> DataFrame:
    """Files up to the size limit. On ``binaryFile`` input the filter reaches the scan."""
    return files.filter(F.col("length") <= max_bytes)


def language_from_extension(path: Column) -> Column:
    return F.coalesce(F.element_at(map_of(P.SUFFIX_LANGUAGE), suffix(path)), F.lit("unknown"))


def route_by_kind(path: Column) -> Column:
    """Image, csv, or code; any unknown suffix is treated as code."""
    s = suffix(path)
    return F.when(s.isin(P.IMAGE_SUFFIXES), "image").when(s.isin(P.TABLE_SUFFIXES), "csv").otherwise("code")


def file_id(path: Column) -> Column:
    """128 bits of the path's digest: a replay gives the same id, and it stays unique over any number of files."""
    return F.substring(F.sha2(path, 256), 1, 32)


def rejects(raw: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """``(path, length, reason)`` of the raw files that :func:`manifest` leaves out."""
    reason = F.when(~allowed(F.col("path")), "type")
    if max_bytes is not None:
        reason = reason.when(F.col("length") > max_bytes, "size")
    return raw.select("path", "length", reason.alias("reason")).filter(F.col("reason").isNotNull())


def manifest(raw: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Raw files (path, length, content) to one record per accepted file, of any size unless ``max_bytes`` is given.

    Images carry no text.
    """
    ok = filter_allowed_types(raw)[0]
    if max_bytes is not None:
        ok = filter_size_cap(ok, max_bytes)
    path = F.col("path")
    return ok.select(
        file_id(path).alias("file_id"),
        F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"),
        path,
        language_from_extension(path).alias("language"),
        route_by_kind(path).alias("kind"),
        F.when(route_by_kind(path) != "image", decoded(F.col("content"))).alias("content"),
        F.col("length").alias("size"),
    )


def from_extracted_text(extracted: DataFrame) -> DataFrame:
    """Text read from images, ``(file_id, raw_text, declared_language)``, as source files."""
    clean = extracted.withColumn("content", text.clean_extracted_text(F.col("raw_text")))
    language = text.resolve_language(F.col("declared_language"), F.col("content"))
    return clean.select("file_id", language.alias("language"), "content")


def read_source_corpus(spark: SparkSession, path: str) -> DataFrame:
    """All accepted files below a path, read by the executors."""
    return manifest(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
