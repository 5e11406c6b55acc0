"""Keep an expensive result so that later steps do not compute it again, and folders that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, a folder all executors share; a local session without it uses its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes with the process, as a frame that reads it may be used until then."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


@contextmanager
def kept_until_end(spark: SparkSession) -> Iterator[None]:
    """What is kept inside the block goes at its end: for jobs that have written all they make by then, such as a micro-batch."""
    paths: list[str] = []
    token = _held.set(paths)
    try:
        yield
    finally:
        _held.reset(token)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame) -> DataFrame:
    """Store as a compressed table in the shared folder and read from there: it survives lost executors, and readers take only the
    columns that they use.

    It goes with the process, or, inside :func:`kept_until_end` and named ``kept-``, when that ends. Columns without a type go by checkpoint.
    """
    spark, paths = df.sparkSession, _held.get()
    if "void" in df.schema.simpleString():
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_folder(spark))
        return df.checkpoint()
    path = new_folder(spark, "table" if paths is None else "kept")
    if paths is not None:
        paths.append(path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
