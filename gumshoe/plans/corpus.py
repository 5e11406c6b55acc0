"""Source files derived row by row from the ``orders`` table.

The driver tables hold prose, not code. Each order becomes one small file: the
keys choose its language and its lines from the templates below, so the work
grows with the table and a SQL engine can build the same texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.functions.constants import array_of

LANGUAGES = ["python", "javascript", "typescript", "java"]

# {v} and {k} are replaced by o_custkey % 5 and o_orderkey % 9.
JS_LINES = [
    "function load{v}(user, items) {",
    "export async function save{v}(rows, opts = 1) {",
    "const pick{v} = (list, idx) => {",
    "let sum{v} = (a + b);",
    "let total{v} = 0;",
    "var cache{v} = require('m{k}');",
    "import thing{k} from 'lib';",
    "for (let i = 0; i <= items.length; i++) {",
    "  for (let j = 0; j < rows.length; j++) {",
    "while (idx < 10) {",
    "if (user) {",
    "if (items && items.length > {k}) {",
    "  total{v} = list[i + 1];",
    "  name = user.name.trim();",
    "  console.log(user.email);",
    "  ratio = total{v} / items.count;",
    "  // a / b is only a remark on user.name",
    "  * note: eval(x)",
    "  x = 10 / y; // see http://a/b",
    "  url = 'http://host/path' / 2;",
    "load{v}(null);",
    "console.log(pick{v}( null ));",
    "missing{k} = undef{v} + 1;",
    "  eval(code{k});",
    "  password = 'hunter{k}';",
    "  API_KEY: 'abc{k}',",
    "  if (total{v} == 3) {",
    "  if (total{v} === 3 && a == b) {",
    "class Box{k} extends Base {",
    "export class Shape{v} {",
    "return rows.map(row => row.id);",
    "}",
    "",
    "\tlist[idx+2] = `t ${opts.size} t`;",
    "  msg = \"it's\" + 'quoted \"x\"' + undef{k};",
    "rows != null;",
    "opts.depth = items[{k}] / rows.length;",
]
JS_PICKS = 14

PY_BLOCKS = [
    "import math\nimport os.path as osp\nfrom collections import deque",
    "def area{v}(w, h):\n    total = w * h\n    return total / h",
    "def pick{v}(items, n):\n    return items[n + 1]",
    "def root{v}(x):\n    try:\n        return math.sqrt(x)\n    except:\n        pass",
    "def use{v}(q):\n    value = q % 3\n    return missing{k}",
    "area{v}(5, 0)\npick{v}(0, 1)\nother{k}(0)",
    "class Shape{k}:\n    def draw(self, pen):\n        for edge in pen:\n            print(edge)\n        return total",
    "def log{v}(msg, seen=[]):\n    global count\n    count = 0\n    while count < 3:\n        count += 1\n    return f'{msg}'",
    "password = 'pw{k}'\nvalues = [1, 2]\nbig = values[100]",
    "if values{k} == 1:\n    total = 7 // 2",
    "def gather{v}(*args, **kw):\n    a, b = args\n    return [a for z in kw]",
    "async def fetch{v}(u):\n    return zeta / u",
    "def area{v}(one):\n    return one",
]
PY_PICKS = 5
PY_BROKEN = "def broken{v}(:\n    pass"

ROWS_A_TASK = 25_000
"""Files scanned by one task. A narrow table of keys is a few MB where its files are GB, so input splits give too few tasks."""


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by ``key``, in as many partitions as the work on them needs: what follows by file stays in place."""
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(-(-n // ROWS_A_TASK), min(4 * cores, n // 1000), 1), key)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, language, content)``, one row per order, dealt out by file."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("f"), k.cast("string")).alias("file_id"), k, c, "o_orderpriority", "o_orderstatus"
    )

    def pick(options: list[str], index: Column) -> Column:
        return F.get(array_of(options), (index % len(options)).cast("int"))

    js = F.concat_ws(
        "\n",
        F.concat(F.lit("// order "), F.col("o_orderpriority"), F.lit(" status "), F.col("o_orderstatus")),
        *[pick(JS_LINES, k * (2 * j + 1) + c * j + 5 * j * j) for j in range(JS_PICKS)],
    )
    py = F.concat_ws(
        "\n",
        F.concat(F.lit("# order "), F.col("o_orderpriority"), F.lit(" status "), F.col("o_orderstatus")),
        *[pick(PY_BLOCKS, k * (j + 1) + c + 3 * j) for j in range(PY_PICKS)],
        F.when(k % 23 == 0, F.lit(PY_BROKEN)),
    )
    language = pick(LANGUAGES, k)
    text = F.when(language == "python", py).otherwise(js)
    text = F.replace(text, F.lit("{v}"), (c % 5).cast("string"))
    text = F.replace(text, F.lit("{k}"), (k % 9).cast("string"))
    return spread(orders, "file_id").select("file_id", language.alias("language"), text.alias("content"))


def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, language)`` of :func:`code_files`, without texts and as the table holds them."""
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.concat(F.lit("f"), k.cast("string")).alias("file_id"),
        F.get(array_of(LANGUAGES), (k % len(LANGUAGES)).cast("int")).alias("language"),
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole web pages read as script text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return pages.select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file_id"),
        F.lit("javascript").alias("language"),
        F.col("html").alias("content"),
    )


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents read as python text (only the line patterns apply to prose)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file_id"),
        F.lit("python").alias("language"),
        F.col("text").alias("content"),
    )
