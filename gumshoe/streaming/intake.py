"""Continuous intake: new files are reviewed as they arrive.

Each micro-batch writes what it finds below ``batch=`` folders in overwrite mode, so a replayed batch replaces its own output:
``findings``, ``history``, ``log`` and ``runs`` (one row of counts) of code files, ``tables`` with the quality reports of CSV files, and ``rejects`` with every
file or report that none of these took, and why.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gumshoe.functions import text
from gumshoe.lineage import exists, keep, kept_until_end
from gumshoe.operators.summaries import write_counted
from gumshoe.plans.review import review_code
from gumshoe.sources import files as files_source
from gumshoe.sources import reports, tables
from gumshoe.sources.history import append_analysis_log, append_history, append_run_log, read_history
from gumshoe.streaming import waiting

LINT = "path string, tool string, report string"
RUNS = "path string, model string, model_ord int, status string, response string"
TEXTS = "path string, raw_text string, declared_language string"
REJECT = ["path", "file_id", "reason"]
LINTED = ("python", "javascript", "typescript")


def _files(spark: SparkSession, inbox: str, max_files: int) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(files_source.BINARY_FILE)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", max_files)
        .load(inbox)
    )


def _write_code(
    spark: SparkSession, code: DataFrame, lint: DataFrame | None, runs: DataFrame | None, outbox: str, batch_id: int, use_history: bool
) -> None:
    history = None
    if use_history and batch_id > 0 and exists(spark, f"{outbox}/history"):
        # Only earlier batches: a replay must see the history it saw the first time.
        history = read_history(spark, f"{outbox}/history").filter(F.col("batch").cast("bigint") < batch_id)
    review = review_code(code, lint=lint, runs=runs, history=history)
    target = f"{outbox}/findings/batch={batch_id}"
    counts = write_counted(review.findings, target)
    append_run_log(spark, counts, f"{outbox}/runs", str(batch_id))
    written = spark.read.parquet(target)
    append_history(written, f"{outbox}/history", str(batch_id))
    log = review.report.withColumn("reviewed_at", F.current_timestamp())
    append_analysis_log(log, f"{outbox}/log", str(batch_id))


def _write_tables(spark: SparkSession, csv_files: DataFrame, outbox: str, batch_id: int) -> None:
    """One report per CSV file, read from its path; a batch holds at most ``max_files``."""
    found = csv_files.select("file_id", "path").orderBy("path").collect()
    if found:
        all_reports = [tables.csv_report(spark, r["path"], r["file_id"]) for r in found]
        reduce(DataFrame.unionByName, all_reports).write.mode("overwrite").parquet(f"{outbox}/tables/batch={batch_id}")


def _write_rejects(rejects: DataFrame, outbox: str, batch_id: int) -> None:
    rejects.select(*REJECT).write.mode("overwrite").parquet(f"{outbox}/rejects/batch={batch_id}")


def incremental_scan(
    spark: SparkSession, inbox: str, outbox: str, checkpoint: str, use_history: bool = True, max_files: int = 1000
) -> StreamingQuery:
    """Review the files that arrived since the last run, each on its own, then stop. Images have no text here and are rejects.

    Files are independent of each other, so no watermark or state is needed.
    """

    def review_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        with kept_until_end(session):
            found = keep(files_source.manifest(batch))
            _write_code(session, found.filter("kind = 'code'"), None, None, outbox, batch_id, use_history)
            _write_tables(session, found.filter("kind = 'csv'"), outbox, batch_id)
            images = found.filter("kind = 'image'").select("path", "file_id", F.lit(waiting.NO_TEXT).alias("reason"))
            others = files_source.rejects(batch).withColumn("file_id", files_source.file_id(F.col("path")))
            _write_rejects(images.unionByName(others.select(*REJECT)), outbox, batch_id)

    return (
        _files(spark, inbox, max_files)
        .writeStream.foreachBatch(review_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _events(spark: SparkSession, inbox: str, max_files: int) -> DataFrame:
    """All that arrives, in one stream: files, and JSON lines that name a file by its path."""
    path, at = F.col("path"), F.col("_metadata.file_modification_time").alias("at")
    key = files_source.file_id(path).alias("file_id")
    raw = _files(spark, f"{inbox}/files", max_files)
    kind = F.when(files_source.allowed(path), files_source.route_by_kind(path)).otherwise("type")
    content = F.when(kind == "code", files_source.decoded(F.col("content")))
    language = files_source.language_from_extension(path)
    parts = [
        raw.select(
            key, F.col("modificationTime").alias("at"), F.lit(waiting.FILE).alias("event"), path, kind.alias("kind"),
            language.alias("language"), content.alias("content"), F.col("length").alias("size"),
        )
    ]

    def lines(folder: str, schema: str) -> DataFrame:
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(f"{inbox}/{folder}")

    parts.append(lines("lint", LINT).select(key, at, F.lit(waiting.LINT).alias("event"), "tool", F.col("report").alias("body")))
    parts.append(
        lines("runs", RUNS).select(key, at, F.lit(waiting.RUN).alias("event"), "model", "model_ord", "status", F.col("response").alias("body"))
    )
    clean = text.clean_extracted_text(F.col("raw_text"))
    parts.append(
        lines("texts", TEXTS).select(
            key, at, F.lit(waiting.TEXT).alias("event"), text.resolve_language(F.col("declared_language"), clean).alias("language"),
            clean.alias("body"),
        )
    )
    names = [f.strip().split()[0] for f in waiting.EVENT.split(",")]
    full = [p.select(*[p[n] if n in p.columns else F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in waiting.EVENT.split(", "))]) for p in parts]
    return reduce(DataFrame.unionByName, full).select(*names)


def incremental_review(
    spark: SparkSession,
    inbox: str,
    outbox: str,
    checkpoint: str,
    models: tuple[str, ...] = (),
    linted: tuple[str, ...] = LINTED,
    wait_seconds: int = 3600,
    use_history: bool = True,
    max_files: int = 1000,
) -> StreamingQuery:
    """Review what arrived since the last run in ``files``, ``lint``, ``runs`` and ``texts`` below ``inbox``, then stop.

    A code file is reviewed once its lint report (if its language is one of ``linted``) and the answers of all ``models`` are there,
    or with what has come when ``wait_seconds`` are over; the four folders must exist.
    """

    def review_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        with kept_until_end(session):
            ready = keep(batch)
            code = ready.filter(F.col("kind").eqNullSafe("code") & (F.col("outcome") != waiting.ORPHAN))
            each = code.select("file_id", F.inline("lint"))
            pylint, eslint = (each.filter(F.col("tool") == t).select("file_id", "report") for t in ("pylint", "eslint"))
            lint = reports.read_pylint_reports(pylint).unionByName(reports.read_eslint_reports(eslint))
            runs = code.select("file_id", F.inline("runs"))
            _write_code(session, code.select("file_id", "language", "content"), lint, runs, outbox, batch_id, use_history)
            _write_tables(session, ready.filter("kind = 'csv'"), outbox, batch_id)
            reason = F.when(F.col("outcome").isin(waiting.ORPHAN, waiting.NO_TEXT), F.col("outcome")).when(F.col("kind") == "type", "type")
            _write_rejects(ready.withColumn("reason", reason).filter("reason is not null"), outbox, batch_id)

    before = spark.conf.get(waiting.PROVIDER, None)
    spark.conf.set(waiting.PROVIDER, waiting.ROCKS)  # the query takes it along when it starts
    try:
        ready = waiting.wait_for_parts(_events(spark, inbox, max_files), models, linted, wait_seconds)
        return (
            ready.writeStream.foreachBatch(review_batch)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(waiting.PROVIDER, before) if before is not None else spark.conf.unset(waiting.PROVIDER)
