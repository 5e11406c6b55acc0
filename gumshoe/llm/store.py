"""Tables that operators write once and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Owner:
    """Tables that go together, once nothing reads them any more."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    @contextmanager
    def holding(self) -> Iterator[Owner]:
        """What this thread stores inside the block belongs to this owner."""
        token = _owner.set(self)
        try:
            yield self
        finally:
            _owner.reset(token)

    def delete(self, spark: SparkSession) -> None:
        for path in self.paths:
            at, files = _file_system(spark, path)
            files.delete(at, True)
        self.paths.clear()


_owner: ContextVar[Owner | None] = ContextVar("owner", default=None)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the folder all executors share (``spark.checkpoint.dir``).

    It belongs to the :class:`Owner` that holds the thread; without one it stays as long as the session's process, as a frame
    that reads it may be used at any time. Only a local session may leave the setting out, as tests do.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="gumshoe-llm-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    owner = _owner.get()
    if owner is not None:
        owner.paths.append(path)
    else:
        at, files = _file_system(spark, path)
        files.mkdirs(at)  # what does not exist cannot be marked
        files.deleteOnExit(at)
        files.delete(at, True)
    return path


def stored(df: DataFrame, name: str, rows_a_group: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it: cuts the lineage, survives lost executors.

    Readers decode a row group, or 4,096 rows of it, at a time: ``rows_a_group`` bounds that for rows of several MB.
    """
    path = new_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if rows_a_group is not None:
        writer = writer.option("parquet.block.row.count.limit", rows_a_group)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, most_bytes: int = 16 << 20) -> DataFrame:
    """Mark a stored table for broadcast if its measured size allows it; a larger one is left to a shuffled join."""
    found = df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()[0]
    return F.broadcast(df) if found <= most_bytes else df


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
