"""More inputs derived from the driver tables: reports, answers, paths, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.functions.constants import array_of

MODELS = ["model_a", "model_b", "model_c"]
# {m} is the model, {n} is o_orderkey % 15 + 1.
ANSWERS = [
    "[]",
    '[{"bug_type":"Division by Zero","line_number":{n},"explanation":"{m} agrees","suggested_fix":"as {m} says"}]',
    'Sure:\n```json\n[{"bug_type":"division","line_number":99,"explanation":"","suggested_fix":"{m} fix"}]\n```\nbye',
    '{"bug_type":"Division by Zero","line_number":{n}}',
    "no json here",
    '[{"bug_type":"Null Reference","line_number":2,"explanation":"{m} first"},'
    '{"bug_type":"Null Reference Error","line_number":3,"explanation":"{m} second","suggested_fix":"x"}]',
    '  [{"bug_type":"odd kind","line_number":{n}.0,"explanation":"{m} by line","suggested_fix":""}]  ',
    '```\n[{"bug_type":"","line_number":null,"explanation":"{m} all"}]\n```',
    '[{"bug_type":"Null Reference","line_number":{n},"explanation":"{m} talks"}] as asked',
    "[{'bug_type':'Division by Zero','line_number':{n}}]",
    '[null,{"bug_type":"Division by Zero","line_number":{n},"explanation":"{m} is sure","impact":"{m} sees a crash","confidence":0.75}]',
]
SUFFIXES = [".py", ".JS", ".ts", ".csv", ".png", ".jpg", ".jpeg", ".txt", ".tar.gz", ""]
DECLARED = [" Python ", "klingon", "SQL", "", "typescript", "html"]
LINT_KINDS = ["error", "fatal", "warning", "convention", "refactor", "information", "other"]
LINT_MESSAGES = [
    "Undefined name of type x", "no module to import", "Syntax is invalid", "wrong Type here",
    "Unused thing", "x is not callable", "something else", "name is not defined",
]


def option(options: list[str], index: F.Column):
    return F.get(array_of(options), (index % len(options)).cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' answers per order's file; some fail, some files have none."""
    k = F.col("o_orderkey")
    asked = orders(spark, sf_dir).filter(k % 13 != 0).select(
        k, F.posexplode(F.array(*[F.lit(m) for m in MODELS])).alias("model_ord", "model")
    )
    m = F.col("model_ord")
    text = option(ANSWERS, k * 3 + m * (k % 5 + 1))
    text = F.replace(text, F.lit("{m}"), F.col("model"))
    text = F.replace(text, F.lit("{n}"), (k % 15 + 1).cast("string"))
    invalid = (k % 17 == 0) & (m == 1)
    status = F.when(invalid, "invalid").when((k + m * 7) % 11 == 0, "failed").otherwise("ok")
    return asked.select(
        F.concat(F.lit("f"), k.cast("string")).alias("file_id"),
        "model",
        "model_ord",
        status.alias("status"),
        F.when(invalid, "timeout").otherwise(text).alias("response"),
    )


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw files as a binary source lists them: path, length and bytes."""
    k = F.col("o_orderkey")
    body = F.concat_ws(" ", F.col("o_orderpriority"), F.col("o_orderstatus"))
    return orders(spark, sf_dir).select(
        F.concat(F.lit("in/"), (F.col("o_custkey") % 50).cast("string"), F.lit("/n"), k.cast("string"), option(SUFFIXES, k)).alias("path"),
        ((k * 7919) % 20_000_000).alias("length"),
        F.encode(body, "UTF-8").alias("content"),
    )


def pylint_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two messages per order; every eleventh report is no JSON array."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def message(kind, line, text):
        return F.concat(
            F.lit('{"type":"'), kind, F.lit('","line":'), line.cast("string"), F.lit(',"column":3,"message":"'), text,
            F.lit('","message-id":"E1","symbol":"s"}'),
        )

    both = F.concat(
        F.lit("["), message(option(LINT_KINDS, k), k % 30, option(LINT_MESSAGES, c)), F.lit(","),
        message(option(LINT_KINDS, c), c % 30, option(LINT_MESSAGES, k)), F.lit("]"),
    )
    return orders(spark, sf_dir).select(
        F.concat(F.lit("f"), k.cast("string")).alias("file_id"),
        F.when(k % 11 == 0, F.lit('{"type":"error"}')).otherwise(both).alias("report"),
    )


def eslint_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reported files per order: two messages, then one without a severity."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def message(severity, line, text):
        return F.concat(
            F.lit("{"), severity, F.lit('"line":'), line.cast("string"), F.lit(',"column":1,"ruleId":"r","message":"'), text, F.lit('"}')
        )

    level = F.concat(F.lit('"severity":'), (k % 2 + 1).cast("string"), F.lit(","))
    report = F.concat(
        F.lit('[{"messages":['), message(level, k % 40, option(LINT_MESSAGES, k)), F.lit(","),
        message(level, c % 40, option(LINT_MESSAGES, c)), F.lit(']},{"messages":['),
        message(F.lit(""), k % 7, option(LINT_MESSAGES, k + c)), F.lit("]}]"),
    )
    return orders(spark, sf_dir).select(
        F.concat(F.lit("f"), k.cast("string")).alias("file_id"),
        F.when(k % 11 == 0, F.lit("oops")).otherwise(report).alias("report"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with gaps, an empty column, a mixed column and repeated rows."""
    e, k = events(spark, sf_dir), F.col("event_id")
    return e.select(
        F.when(k % 5 != 0, F.col("value")).alias("value"),
        F.when(k % 2 == 0, F.col("event_type")).alias("event_type"),
        F.when(k % 16 != 3, F.col("user_id") % 3).alias("bucket"),
        F.lit(None).cast("string").alias("nothing"),
        F.when(k % 4 == 0, F.col("event_type")).otherwise((k % 7).cast("string")).alias("mixed"),
        F.when(k % 2 == 0, F.lit("x")).otherwise((k % 3).cast("string")).alias("half"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select(
        F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("language"), F.col("embedding").alias("vector")
    )


def vector_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as earlier findings; every fortieth shares an explanation."""
    v = F.col("vec_id")
    return embeddings(spark, sf_dir).select(
        v,
        F.col("label").cast("string").alias("language"),
        F.col("embedding").alias("vector"),
        F.concat(F.lit("type"), (v % 7).cast("string")).alias("bug_type"),
        F.concat(F.when(v % 2 == 0, " E").otherwise("e"), (v % 40).cast("string")).alias("explanation"),
        F.concat(F.lit("fix"), v.cast("string")).alias("fix"),
    )


def broken_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as history, some of them null, with a null inside, too short, zero or not finite."""
    v, e = F.col("vec_id"), F.col("embedding").cast("array<double>")
    broken = (
        F.when(v % 50 == 0, F.lit(None).cast("array<double>"))
        .when(v % 50 == 1, F.concat(F.slice(e, 2, 1000), F.array(F.lit(None).cast("double"))))
        .when(v % 50 == 2, F.slice(e, 1, 5))
        .when(v % 50 == 3, F.transform(e, lambda x: x * 0))
        .when(v % 50 == 4, F.concat(F.array(F.lit(float("nan"))), F.slice(e, 2, 1000)))
        .otherwise(e)
    )
    return embeddings(spark, sf_dir).select(v, F.col("label").cast("string").alias("language"), broken.alias("vector"))
