"""Every operator as a query over the driver tables, with its SQL counterpart.

``QUERIES`` maps a name to a function of (session, table folder). ``ORACLES``
holds the SQL for the same name; a name without SQL is an operator SQL cannot
express. All queries read their tables and texts whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gumshoe.functions import patterns as P
from gumshoe.functions import text as T
from gumshoe.operators import (
    catalogue,
    code_scan,
    findings,
    js_scan,
    line_patterns,
    lines,
    python_scan,
    quality,
    similarity,
    summaries,
    voting,
)
from gumshoe.plans import corpus, rescan, review, samples
from gumshoe.plans import oracles as O
from gumshoe.lineage import keep, new_folder
from gumshoe.operators.quartiles import long_values, merged, quartiles, sketches
from gumshoe.sources import audits, blocks, history, reports, tables, vector_index
from gumshoe.sources import files as files_source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return python_scan.parse_python(corpus.code_files(spark, sf))


# ------------------------------------------------------------------ sources


@query(
    "allowed_and_routed_files",
    f"""
WITH p AS (SELECT 'in/' || (o_custkey % 50) || '/n' || o_orderkey || ({O.listed(samples.SUFFIXES)})[(o_orderkey % 10) + 1] AS path FROM orders),
s AS (SELECT path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS x FROM p)
SELECT path, x IN ('.py', '.js', '.ts', '.csv', '.png', '.jpg', '.jpeg') AS allowed,
  CASE x WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.csv' THEN 'csv'
    WHEN '.png' THEN 'image' WHEN '.jpg' THEN 'image' WHEN '.jpeg' THEN 'image' ELSE 'unknown' END AS language,
  CASE WHEN x IN ('.png', '.jpg', '.jpeg') THEN 'image' WHEN x = '.csv' THEN 'csv' ELSE 'code' END AS kind
FROM s""",
)
def _(spark, sf):
    path = F.col("path")
    return samples.paths(spark, sf).select(
        path,
        files_source.allowed(path).alias("allowed"),
        files_source.language_from_extension(path).alias("language"),
        files_source.route_by_kind(path).alias("kind"),
    )


@query(
    "intake_manifest",
    f"""
WITH p AS (SELECT 'in/' || (o_custkey % 50) || '/n' || o_orderkey || ({O.listed(samples.SUFFIXES)})[(o_orderkey % 10) + 1] AS path,
  (o_orderkey * 7919) % 20000000 AS size, o_orderpriority || ' ' || o_orderstatus AS body FROM orders),
s AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS x FROM p)
SELECT substring(sha256(path), 1, 32) AS file_id, regexp_extract(path, '([^/]+)$', 1) AS file_name, path,
  CASE x WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.csv' THEN 'csv' ELSE 'image' END AS language,
  CASE WHEN x IN ('.png', '.jpg', '.jpeg') THEN 'image' WHEN x = '.csv' THEN 'csv' ELSE 'code' END AS kind,
  CASE WHEN x NOT IN ('.png', '.jpg', '.jpeg') THEN body END AS content, size
FROM s WHERE x IN ('.py', '.js', '.ts', '.csv', '.png', '.jpg', '.jpeg') AND size <= 10485760""",
)
def _(spark, sf):
    return files_source.manifest(samples.paths(spark, sf), max_bytes=10 << 20)


@query("decode_bytes", "SELECT doc_id, text FROM documents")
def _(spark, sf):
    docs, text = table(spark, sf, "documents"), F.col("text")
    latin = (F.col("doc_id") % 2 == 1) & text.rlike(r"\A[\x00-\xff]*\z")
    as_bytes = F.when(latin, F.encode(text, "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return docs.select("doc_id", files_source.decoded(as_bytes).alias("text"))


_LINT = """
WITH m AS (
  SELECT 'f' || o_orderkey AS file_id, o_orderkey AS k, o_custkey AS c FROM orders WHERE o_orderkey % 11 <> 0
)"""


def _lint_option(options: list[str], index: str) -> str:
    return f"({O.listed(options)})[({index} % {len(options)}) + 1]"


_PYLINT_SEVERITY = (
    "CASE kind WHEN 'error' THEN 'high' WHEN 'fatal' THEN 'critical' WHEN 'warning' THEN 'medium' WHEN 'convention' THEN 'low' "
    "WHEN 'refactor' THEN 'low' WHEN 'information' THEN 'info' ELSE 'medium' END"
)
_PYLINT_SQL = (
    _LINT
    + f""", both_rows AS (
  SELECT file_id, 0 AS ord, CAST(k % 30 AS INTEGER) AS line, {_lint_option(samples.LINT_KINDS, 'k')} AS kind, {_lint_option(samples.LINT_MESSAGES, 'c')} AS issue FROM m
  UNION ALL SELECT file_id, 1, CAST(c % 30 AS INTEGER), {_lint_option(samples.LINT_KINDS, 'c')}, {_lint_option(samples.LINT_MESSAGES, 'k')} FROM m),
lint AS (SELECT file_id, ord, line, 3 AS "column", issue, 'E1' AS code, {_PYLINT_SEVERITY} AS severity, 'pylint' AS tool, 's' AS symbol FROM both_rows)"""
)
_ESLINT_SQL = (
    _LINT
    + f""", both_rows AS (
  SELECT file_id, 0 AS ord, CAST(k % 40 AS INTEGER) AS line, k % 2 + 1 AS level, {_lint_option(samples.LINT_MESSAGES, 'k')} AS issue FROM m
  UNION ALL SELECT file_id, 1, CAST(c % 40 AS INTEGER), k % 2 + 1, {_lint_option(samples.LINT_MESSAGES, 'c')} FROM m
  UNION ALL SELECT file_id, 2, CAST(k % 7 AS INTEGER), 1, {_lint_option(samples.LINT_MESSAGES, '(k + c)')} FROM m)
SELECT file_id, ord, line, 1 AS "column", issue, 'r' AS code, CASE WHEN level = 2 THEN 'high' ELSE 'medium' END AS severity,
  'eslint' AS tool, CAST(NULL AS VARCHAR) AS symbol FROM both_rows"""
)
_CLASS = (
    "CASE WHEN contains(lower(issue), 'undefined') OR contains(lower(issue), 'not defined') THEN 'Undefined Variable' "
    "WHEN contains(lower(issue), 'import') THEN 'Import Error' WHEN contains(lower(issue), 'syntax') THEN 'Syntax Error' "
    "WHEN contains(lower(issue), 'type') THEN 'Type Error' WHEN contains(lower(issue), 'unused') THEN 'Unused Code' "
    "WHEN contains(lower(issue), 'not callable') THEN 'Not Callable' ELSE 'Code Issue' END"
)
_IMPACT = "CASE severity " + " ".join(f"WHEN {O.q(s)} THEN {O.q(t)}" for s, t in catalogue.SEVERITY_IMPACT.items()) + " END"
_LINT_FINDINGS = (
    f"SELECT file_id, {_CLASS} AS bug_type, line AS line_number, issue AS explanation, {_IMPACT} AS impact, tool AS source, severity, "
    "'' AS suggested_fix, 0 AS priority, CAST(ord AS BIGINT) AS ord FROM lint WHERE severity IN ('high', 'critical')"
)


@query("pylint_reports", _PYLINT_SQL + " SELECT * FROM lint")
def _(spark, sf):
    return reports.read_pylint_reports(samples.pylint_reports(spark, sf))


@query("eslint_reports", _ESLINT_SQL)
def _(spark, sf):
    return reports.read_eslint_reports(samples.eslint_reports(spark, sf))


@query("severe_lint_findings", _PYLINT_SQL + " " + _LINT_FINDINGS)
def _(spark, sf):
    return findings.describe_lint(reports.read_pylint_reports(samples.pylint_reports(spark, sf)))


@query(
    "lint_vocabulary",
    _PYLINT_SQL + f" SELECT file_id, ord, issue, severity, {_CLASS} AS bug_type, {_IMPACT} AS impact FROM lint",
)
def _(spark, sf):
    lint = reports.read_pylint_reports(samples.pylint_reports(spark, sf))
    return lint.select(
        "file_id", "ord", "issue", "severity",
        catalogue.classify_lint(F.col("issue")).alias("bug_type"),
        catalogue.impact_of_severity(F.col("severity")).alias("impact"),
    )


@query(
    "model_verdicts",
    O.VOTED + " SELECT file_id, model, model_ord, ord, bug_type, line_number, explanation, suggested_fix, impact, confidence FROM verdicts",
)
def _(spark, sf):
    return reports.read_model_verdicts(samples.model_runs(spark, sf))


@query(
    "recent_analyses",
    "SELECT o_orderkey, o_orderdate, 100 AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100",
)
def _(spark, sf):
    log = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return history.recent_analyses(log, "o_orderdate", "o_orderkey")


_FINDING_TEXT = "'Bug Type: ' || bug_type || ' | Language: ' || language || ' | Explanation: ' || explanation || ' | Impact: ' || impact || ' | Fix: ' || suggested_fix"
_HISTORY = (
    O.CODE
    + f"""SELECT bug_type, language, explanation, suggested_fix AS fix, severity, impact, {O.embedding(_FINDING_TEXT)} AS vector,
  sha256(file_id || '|' || line_number || '|' || bug_type || '|b1') AS vec_id
FROM findings JOIN files USING (file_id) WHERE severity IN ('high', 'critical')"""
)


def _embed(c):
    """Both engines know the 256-bit digest."""
    return T.hash_embedding(c, bits=256)


def _numbers(vector):
    return F.array_join(F.transform(vector, lambda x: (x * 128).cast("int").cast("string")), ",").alias("vector")


def _history_columns(rows):
    return rows.select("bug_type", "language", "explanation", "fix", "severity", "impact", _numbers("vector"), "vec_id")


@query("history_rows", _HISTORY)
def _(spark, sf):
    return _history_columns(history.history_rows(_with_language(spark, sf), "b1", embed=_embed))


@query("stored_history", _HISTORY)
def _(spark, sf):
    """Written in two batches, one of them two times, and read again."""
    path, found = new_folder(spark, "history"), keep(_with_language(spark, sf))  # scanned once for the three writes
    for batch, part in (("b0", found.limit(5)), ("b1", found.limit(7)), ("b1", found)):
        history.append_history(part, path, batch, embed=_embed)
    return _history_columns(history.read_history(spark, path).filter("batch = 'b1'"))


@query(
    "analysis_log",
    """SELECT o_orderkey, o_orderdate, 100 AS total FROM orders WHERE o_orderkey % 3 <> 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""",
)
def _(spark, sf):
    """Two batches of a log, one of them written two times, and the newest entries."""
    path, log = new_folder(spark, "log"), table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    for batch, part in (("0", "o_orderkey % 3 = 0"), ("2", "o_orderkey % 3 = 1"), ("2", "o_orderkey % 3 = 2")):
        history.append_analysis_log(log.filter(part), path, batch)
    return history.recent_analyses(spark.read.parquet(path).drop("batch"), "o_orderdate", "o_orderkey")


# ------------------------------------------------------------------ text


@query("document_lines", O.lines_of(O.DOCUMENTS) + " SELECT file_id, line, text FROM stripped")
def _(spark, sf):
    return lines.trim_lines(lines.split_lines(corpus.document_files(spark, sf))).drop("language")


@query("raw_lines", O.lines_of(O.DOCUMENTS) + " SELECT file_id, line, raw AS text FROM lines")
def _(spark, sf):
    return lines.split_lines(corpus.document_files(spark, sf)).drop("language")


@query("line_counts", O.lines_of(O.DOCUMENTS) + " SELECT file_id, count(*) AS line_count FROM lines GROUP BY file_id")
def _(spark, sf):
    return lines.line_counts(corpus.document_files(spark, sf))


@query("code_lines", O.CODE + "SELECT file_id, language, line, text FROM code")
def _(spark, sf):
    js = corpus.code_files(spark, sf).filter(F.col("language").isin(js_scan.JS_LANGUAGES))
    return lines.drop_comment_lines(lines.trim_lines(lines.split_lines(js)))


@query("lines_without_strings", O.CODE + f"SELECT file_id, line, {O._CLEAN} AS text FROM code")
def _(spark, sf):
    js = corpus.code_files(spark, sf).filter(F.col("language").isin(js_scan.JS_LANGUAGES))
    code = lines.drop_comment_lines(lines.trim_lines(lines.split_lines(js)))
    return code.select("file_id", "line", T.strip_comments_and_strings(F.col("text")).alias("text"))


@query(
    "identifiers",
    O.CODE
    + f"""SELECT file_id, line, row_number() OVER (PARTITION BY file_id, line ORDER BY p) - 1 AS pos, token
FROM (SELECT file_id, line, generate_subscripts(t, 1) AS p, unnest(t) AS token
      FROM (SELECT file_id, line, regexp_extract_all({O._CLEAN}, {O.q(O.W + '+')}) AS t FROM code))
WHERE regexp_matches(token, '^[a-zA-Z_]')""",
)
def _(spark, sf):
    js = corpus.code_files(spark, sf).filter(F.col("language").isin(js_scan.JS_LANGUAGES))
    return lines.tokenize(lines.drop_comment_lines(lines.trim_lines(lines.split_lines(js))))


_EXTRACTED = "'```python' || chr(10) || chr(10) || ' “q” — ‘a’ … x' || chr(160) || text || '   ' || chr(10) || '```' || chr(10) || ' ' || chr(10)"


_CLEAN_SQL = f"""
WITH f AS (SELECT doc_id, regexp_replace(regexp_replace({_EXTRACTED}, '(?m)^```{O.W}*\\n?', '', 'g'), '(?m)\\n?```$', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, generate_subscripts(a, 1) AS n, unnest(a) AS raw FROM (
  SELECT doc_id, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS a FROM (SELECT doc_id, regexp_split_to_array(t, {O.q(O.BREAK)}) AS parts FROM f))),
c AS (SELECT doc_id, n, replace(replace(replace(replace(replace(replace(replace(rtrim(raw, {O.TRIM}), '—', '--'), '“', '"'), '”', '"'), '‘', ''''), '’', ''''), '…', '...'), chr(160), ' ') AS s FROM l),
e AS (SELECT *, min(n) FILTER (WHERE trim(s) <> '') OVER (PARTITION BY doc_id) AS a, max(n) FILTER (WHERE trim(s) <> '') OVER (PARTITION BY doc_id) AS b FROM c)
SELECT doc_id, string_agg(s, chr(10) ORDER BY n) AS text FROM e WHERE n BETWEEN a AND b GROUP BY doc_id"""


def _extracted(spark, sf):
    raw = F.concat(
        F.lit("```python\n\n “q” — ‘a’ … x\u00a0"), F.col("text"), F.lit("   \n```\n \n")
    )
    docs = table(spark, sf, "documents").select("doc_id", "text")
    declared = samples.option(samples.DECLARED, F.col("doc_id"))
    return docs.select("doc_id", raw.alias("raw_text"), declared.alias("declared_language"))


@query("clean_extracted_text", _CLEAN_SQL)
def _(spark, sf):
    return _extracted(spark, sf).select("doc_id", T.clean_extracted_text(F.col("raw_text")).alias("text"))


def _score_sql(text: str) -> str:
    def total(marks: list[str], expr: str) -> str:
        return " + ".join(f"contains({expr}, {O.q(m)})::INT" for m in marks)

    py = total(P.PY_MARKS, text) + f" + (contains({text}, 'class ') AND contains({text}, 'self'))::INT"
    js = total(P.JS_MARKS, text)
    ts = total(P.TS_LOWER_MARKS, f"lower({text})") + " + " + total(P.TS_MARKS, text)
    return (
        f"CASE WHEN {O.strip(text)} = '' THEN 'unknown' WHEN ({js}) + ({ts}) > ({py}) AND ({ts}) > 0 THEN 'typescript' "
        f"WHEN ({js}) > ({py}) THEN 'javascript' ELSE 'python' END"
    )


@query(
    "detected_language",
    f"SELECT 'd' || doc_id AS id, {_score_sql('text')} AS language FROM documents "
    f"UNION ALL SELECT 'p' || page_id, {_score_sql('html')} FROM pages",
)
def _(spark, sf):
    texts = corpus.document_files(spark, sf).unionByName(corpus.page_files(spark, sf))
    return texts.select(F.col("file_id").alias("id"), T.detect_language(F.col("content")).alias("language"))


@query(
    "extracted_files",
    f"""SELECT 'x' || c.doc_id AS file_id, text AS content, CASE WHEN lower(trim(declared)) IN {O.words(P.LANGUAGES)}
  THEN lower(trim(declared)) ELSE {_score_sql('text')} END AS language
FROM ({_CLEAN_SQL}) c JOIN (SELECT doc_id, {_lint_option(samples.DECLARED, 'doc_id')} AS declared FROM documents) d USING (doc_id)""",
)
def _(spark, sf):
    extracted = _extracted(spark, sf).withColumn("file_id", F.concat(F.lit("x"), F.col("doc_id").cast("string")))
    return files_source.from_extracted_text(extracted)


@query("detected_code_language", O.CODE + f"SELECT file_id, {_score_sql('content')} AS language FROM files")
def _(spark, sf):
    return corpus.code_files(spark, sf).select("file_id", T.detect_language(F.col("content")).alias("language"))


@query(
    "detected_language_simple",
    O.CODE
    + """SELECT file_id, CASE WHEN contains(content, 'def ') AND contains(content, 'import ') THEN 'python'
  WHEN contains(content, 'function ') OR contains(content, 'const ') OR contains(content, '=>') THEN 'javascript' ELSE 'python' END AS language FROM files""",
)
def _(spark, sf):
    return corpus.code_files(spark, sf).select("file_id", T.detect_language_simple(F.col("content")).alias("language"))


@query(
    "resolved_language",
    f"""WITH d AS (SELECT doc_id, text, {_lint_option(samples.DECLARED, 'doc_id')} AS declared FROM documents)
SELECT doc_id, CASE WHEN lower(trim(declared)) IN {O.words(P.LANGUAGES)} THEN lower(trim(declared)) ELSE {_score_sql('text')} END AS language FROM d""",
)
def _(spark, sf):
    declared = samples.option(samples.DECLARED, F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", T.resolve_language(declared, F.col("text")).alias("language"))


@query(
    "review_packets",
    O.CODE
    + """SELECT f.file_id, 'Language: ' || language || chr(10) || chr(10) || 'Code:' || chr(10) || '```' || chr(10) || content || chr(10) || '```' ||
  chr(10) || chr(10) || 'Findings to confirm:' || chr(10) || coalesce(bullets, '') AS packet
FROM files f LEFT JOIN (SELECT file_id, string_agg('- Line ' || line_number || ': ' || bug_type || ' — ' || explanation, chr(10)
    ORDER BY priority, ord, line_number, bug_type) AS bullets FROM findings GROUP BY file_id) b USING (file_id)""",
)
def _(spark, sf):
    """All findings; those of python rules come in the order of their lines, which both engines know."""
    files = corpus.code_files(spark, sf)
    found = code_scan.candidate_findings(files).join(files.select("file_id", "language"), "file_id")
    by_line = (F.col("language") == "python") & (F.col("source") == "parser")
    found = found.withColumn("ord", F.when(by_line, F.col("line_number").cast("long")).otherwise(F.col("ord")))
    return summaries.review_packet(files, found, max_chars=None)


@query(
    "finding_texts",
    O.CODE
    + """SELECT file_id, line_number, bug_type, 'Bug Type: ' || bug_type || ' | Language: ' || language || ' | Explanation: ' || explanation ||
  ' | Impact: ' || impact || ' | Fix: ' || suggested_fix AS text FROM findings JOIN files USING (file_id)""",
)
def _(spark, sf):
    f = _with_language(spark, sf)
    text = T.finding_text(*(F.col(c) for c in ("bug_type", "language", "explanation", "impact", "suggested_fix")))
    return f.select("file_id", "line_number", "bug_type", text.alias("text"))


# ------------------------------------------------------------------ facts


@query(
    "js_functions",
    O.CODE
    + """SELECT file_id, f.line, f.name, coalesce(string_agg(param, ',' ORDER BY pos), '') AS params
FROM fn f LEFT JOIN params p USING (file_id, line) GROUP BY file_id, f.line, f.name""",
)
def _(spark, sf):
    fns = js_scan.js_functions(corpus.code_files(spark, sf))
    return fns.withColumn("params", F.array_join("params", ","))


@query("js_variables", O.CODE + "SELECT file_id, line, name FROM vars")
def _(spark, sf):
    return js_scan.js_variables(corpus.code_files(spark, sf))


@query("js_loop_variables", O.CODE + "SELECT file_id, line, name FROM loopvars")
def _(spark, sf):
    return js_scan.js_loop_variables(corpus.code_files(spark, sf))


@query(
    "js_declared_names",
    O.CODE
    + f"SELECT file_id, name FROM declared UNION SELECT file_id, unnest({O.listed(P.JS_BUILTINS)}) FROM files "
    "WHERE language IN ('javascript', 'typescript')",
)
def _(spark, sf):
    return js_scan.js_declared_names(corpus.code_files(spark, sf))


_S = P.S
_LINE_FACTS = {
    "class": (
        "js_classes",
        f"SELECT file_id, line, regexp_extract(text, {O.q(f'^(?:export{_S}+)?class{_S}+({O.W}+)')}, 1) AS name FROM code "
        f"WHERE regexp_matches(text, {O.q(f'^(?:export{_S}+)?class{_S}+{O.W}')})",
    ),
    "import": (
        "js_imports",
        "SELECT file_id, line, text AS name FROM code WHERE starts_with(text, 'import ') "
        "OR (starts_with(text, 'const ') AND contains(text, 'require('))",
    ),
    "loop": (
        "js_loops",
        "SELECT file_id, line, CASE WHEN contains(left(text, 5), 'for') THEN 'for' ELSE 'while' END AS name FROM code "
        f"WHERE regexp_matches(text, {O.q(f'^(for|while){_S}*\\(')})",
    ),
    "conditional": (
        "js_conditionals",
        f"SELECT file_id, line, CAST(NULL AS VARCHAR) AS name FROM code WHERE regexp_matches(text, {O.q(f'^if{_S}*\\(')})",
    ),
    "call": (
        "js_calls",
        f"SELECT * FROM (SELECT file_id, line, unnest(regexp_extract_all(text, {O.q(f'({O.W}+){_S}*\\(')}, 1)) AS name FROM code) "
        f"WHERE name NOT IN {O.words(P.JS_NOT_CALLS)}",
    ),
}


def _js_fact_query(kind: str):
    def run(spark, sf):
        facts = js_scan.js_line_facts(corpus.code_files(spark, sf))
        return facts.filter(F.col("kind") == kind).select("file_id", "line", "name")

    return run


for _kind, (_name, _sql) in _LINE_FACTS.items():
    query(_name, O.CODE + _sql)(_js_fact_query(_kind))


@query(
    "generic_files",
    O.CODE + "SELECT f.file_id, count(*) AS line_count FROM files f JOIN lines l USING (file_id) WHERE f.language = 'java' GROUP BY f.file_id",
)
def _(spark, sf):
    known = ["python", *js_scan.JS_LANGUAGES]
    return lines.line_counts(corpus.code_files(spark, sf).filter(~F.col("language").isin(known)))


@query(
    "python_facts",
    O.CODE
    + """SELECT file_id, kind, CASE WHEN kind <> 'local' THEN CAST(line AS INTEGER) END AS line, CASE WHEN kind IN ('division', 'bare_except', 'conditional', 'sqrt') THEN NULL ELSE name END AS name,
  CASE WHEN kind = 'zero_argument' THEN coalesce(string_split(f.names, ',')[pos + 1], '') ELSE n.names END AS names,
  CASE WHEN kind = 'zero_argument' THEN pos END AS pos
FROM nodes n LEFT JOIN py_functions f USING (file_id, name)
UNION ALL SELECT file_id, 'syntax_error', CAST(line AS INTEGER), 'invalid syntax', '', NULL FROM syntax""",
)
def _(spark, sf):
    facts = python_scan.python_facts(parsed(spark, sf))
    names = F.coalesce(F.array_join("names", ","), F.lit("")).alias("names")
    pos = F.when(F.col("kind") == "zero_argument", F.col("pos")).alias("pos")
    line = F.when(F.col("kind") != "local", F.col("line")).alias("line")  # a local name carries its function's line
    return facts.select("file_id", "kind", line, "name", names, pos)


@query("python_defined_names", O.CODE + "SELECT file_id, name FROM py_defined")
def _(spark, sf):
    return python_scan.python_defined_names(parsed(spark, sf))


@query(
    "python_name_loads",
    O.CODE + "SELECT DISTINCT file_id, name, CAST(line AS INTEGER) AS line FROM nodes WHERE kind = 'load'",
)
def _(spark, sf):
    facts = python_scan.python_facts(parsed(spark, sf))
    return facts.filter(F.col("kind") == "load").select("file_id", "name", "line")


@query("python_syntax_errors", O.CODE + "SELECT file_id, CAST(line AS INTEGER) AS line, 'invalid syntax' AS message FROM syntax")
def _(spark, sf):
    facts = python_scan.python_facts(parsed(spark, sf))
    return facts.filter(F.col("kind") == "syntax_error").select("file_id", "line", F.col("name").alias("message"))


@query(
    "files_by_language",
    O.CODE
    + """, r AS (SELECT file_id, count(*) AS n_risks FROM risks GROUP BY file_id),
p AS (SELECT file_id, count(*) AS n_patterns FROM (SELECT file_id FROM js_patterns UNION ALL SELECT file_id FROM py_patterns) GROUP BY file_id)
SELECT file_id, language, coalesce(n_risks, 0) AS n_risks, coalesce(n_patterns, 0) AS n_patterns FROM files LEFT JOIN r USING (file_id) LEFT JOIN p USING (file_id)""",
)
def _(spark, sf):
    """What the scan of each file's language finds; other languages have none."""
    files = corpus.code_files(spark, sf)
    found = code_scan.scan(files)
    both = found.risks.select("file_id", F.lit(1).alias("r"), F.lit(0).alias("p")).unionByName(
        found.patterns.select("file_id", F.lit(0).alias("r"), F.lit(1).alias("p"))
    )
    counts = both.groupBy("file_id").agg(F.sum("r").alias("n_risks"), F.sum("p").alias("n_patterns"))
    return files.select("file_id", "language").join(counts, "file_id", "left").fillna(0, ["n_risks", "n_patterns"])


# ------------------------------------------------------------------ rules


def _js_rule_query(kind: str):
    def run(spark, sf):
        hits = js_scan.js_hits(corpus.code_files(spark, sf))
        return hits.filter(F.col("type") == kind).select("file_id", "line", "message", "variable", "array", "function")

    return run


for _kind, _name in {
    "off_by_one": "js_off_by_one",
    "out_of_bounds": "js_out_of_bounds",
    "null_reference": "js_null_reference",
    "division": "js_division",
    "undefined_variable": "js_undefined_variable",
    "null_argument": "js_null_argument",
    "security": "js_eval",
}.items():
    query(_name, O.js_rule(_kind))(_js_rule_query(_kind))


def _py_rule_query(kind: str):
    def run(spark, sf):
        risks = python_scan.python_risks(parsed(spark, sf))
        return risks.filter(F.col("type") == kind).select("file_id", "line", "message", "variable", "function", "param")

    return run


for _kind, _name in {
    "division": "py_division",
    "bare_except": "py_bare_except",
    "negative_sqrt": "py_negative_sqrt",
    "zero_argument": "py_zero_argument",
    "out_of_bounds": "py_out_of_bounds",
    "undefined_variable": "py_undefined_variable",
    "syntax_error": "py_syntax_error",
}.items():
    query(_name, O.py_rule(_kind))(_py_rule_query(_kind))


def _py_pattern_query(kind: str):
    def run(spark, sf):
        hits = line_patterns.python_pattern_hits(corpus.code_files(spark, sf))
        return hits.filter(F.col("type") == kind).select("file_id", "line")

    return run


for _kind, _name in {
    "mutable_default": "pattern_mutable_default",
    "large_index": "pattern_large_index",
    "bare_except": "pattern_bare_except",
    "hardcoded_secret": "pattern_hardcoded_secret",
    "global": "pattern_global",
}.items():
    query(_name, O.pattern("py_patterns", _kind))(_py_pattern_query(_kind))


def _js_pattern_query(kind: str):
    def run(spark, sf):
        hits = js_scan.js_hits(corpus.code_files(spark, sf))
        return hits.filter(F.col("type") == kind).select("file_id", "line")

    return run


for _kind, _name in {
    "loose_equality": "pattern_loose_equality",
    "eval": "pattern_eval",
    "hardcoded_secret_js": "pattern_hardcoded_secret_js",
}.items():
    query(_name, O.pattern("js_patterns", _kind))(_js_pattern_query(_kind))


@query(
    "document_pattern_hits",
    f"WITH {O.DOCUMENTS}, {O.LINES}, {O.PY_LINES}, {O.PY_PATTERNS} SELECT file_id, line, type FROM py_patterns",
)
def _(spark, sf):
    return line_patterns.python_pattern_hits(corpus.document_files(spark, sf)).select("file_id", "line", "type")


@query(
    "page_script_risks",
    O.PAGE_CODE + 'SELECT file_id, line, type, message, variable, "array", "function" FROM js_risks',
)
def _(spark, sf):
    hits = js_scan.js_hits(corpus.page_files(spark, sf)).filter(F.col("source") == "parser")
    return hits.select("file_id", "line", "type", "message", "variable", "array", "function")


@query(
    "deduped_risks",
    O.CODE + "SELECT file_id, line, type, message FROM risks",
)
def _(spark, sf):
    """Every risk is raised two times, and later again with another message."""
    risks = keep(code_scan.scan(corpus.code_files(spark, sf)).risks)  # scanned once for the three
    later = risks.withColumns({"ord": F.col("ord") + 10_000_000, "message": F.lit("later")})
    return findings.dedupe_risks(risks.unionByName(risks).unionByName(later)).select("file_id", "line", "type", "message")


# ------------------------------------------------------------------ findings

_F = "file_id, bug_type, line_number, explanation, impact, source, severity, suggested_fix"
_FINDING_COLUMNS = _F.split(", ")


def _candidates(spark, sf):
    return code_scan.candidate_findings(corpus.code_files(spark, sf))


def _with_language(spark, sf):
    return _candidates(spark, sf).join(corpus.file_languages(spark, sf), "file_id")


@query("described_risks", O.CODE + f"SELECT {_F} FROM all_findings WHERE source = 'parser'")
def _(spark, sf):
    return catalogue.describe_risks(code_scan.scan(corpus.code_files(spark, sf)).risks).select(_FINDING_COLUMNS)


@query("described_patterns", O.CODE + f"SELECT {_F} FROM all_findings WHERE source = 'pattern_detector'")
def _(spark, sf):
    return catalogue.describe_patterns(code_scan.scan(corpus.code_files(spark, sf)).patterns).select(_FINDING_COLUMNS)


_CODE_LINT = (
    O.CODE
    + _PYLINT_SQL.replace("WITH m AS", ", m AS", 1).strip()
    + f", lint_findings AS ({_LINT_FINDINGS}), everything AS (SELECT * FROM lint_findings UNION ALL SELECT {_F}, priority, ord FROM all_findings)"
)


@query("united_findings", _CODE_LINT + f" SELECT {_F} FROM everything")
def _(spark, sf):
    found = code_scan.scan(corpus.code_files(spark, sf))
    lint = reports.read_pylint_reports(samples.pylint_reports(spark, sf))
    return findings.union_findings(lint, found.risks, found.patterns).select(_FINDING_COLUMNS)


@query(
    "deduped_findings",
    _CODE_LINT
    + f""" SELECT {_F} FROM everything
QUALIFY row_number() OVER (PARTITION BY file_id, line_number, bug_type ORDER BY priority, ord) = 1""",
)
def _(spark, sf):
    lint = reports.read_pylint_reports(samples.pylint_reports(spark, sf))
    return code_scan.candidate_findings(corpus.code_files(spark, sf), lint).select(_FINDING_COLUMNS)


@query("code_findings", O.CODE + f"SELECT {_F} FROM findings")
def _(spark, sf):
    return _candidates(spark, sf).select(_FINDING_COLUMNS)


# ------------------------------------------------------------------ files in byte ranges

_TOKENS = ", ".join(O.q(t) for t in P.NULL_TOKENS)


def _csv_of_documents(spark, sf):
    """The documents as CSV: texts with quotes, commas and line breaks."""
    path = f"{new_folder(spark, 'csv')}/documents"
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    writer = rows.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(
    "csv_rows",
    "SELECT CAST(doc_id AS DOUBLE) AS doc_id, "
    + ", ".join(f"CASE WHEN {c} NOT IN ({_TOKENS}) THEN {c} END AS {c}" for c in ("text", "lang", "source"))
    + " FROM documents",
)
def _(spark, sf):
    return tables.read_csv_table(spark, _csv_of_documents(spark, sf))


@query(
    "csv_column_kinds",
    "SELECT * FROM (VALUES ('doc_id', 'number'), ('text', 'text'), ('lang', 'text'), ('source', 'text')) t(column_name, kind)",
)
def _(spark, sf):
    kinds = tables.infer_column_kinds(tables.read_raw_csv(spark, _csv_of_documents(spark, sf)).drop(tables.EXTRA))
    return spark.createDataFrame(sorted(kinds.items()), "column_name string, kind string")


@query(
    "csv_parse_findings",
    f"""SELECT CAST(0 AS BIGINT) AS ord, 'CSV Parse Error' AS bug_type, 1 AS line_number, CAST(NULL AS VARCHAR) AS column_name,
  count(*) || ' rows {tables.TOO_LONG}' AS explanation, 'The table cannot be read' AS impact, 'critical' AS severity,
  'Check the separator, the quoting and the encoding' AS suggested_fix, 'csv_analyzer' AS source
FROM orders WHERE o_orderkey % 97 = 0""",
)
def _(spark, sf):
    """Orders as sixteen CSV files, some rows with a field too many and all with quoted line breaks."""
    path = f"{new_folder(spark, 'csv')}/orders"
    k = F.col("o_orderkey")
    line = F.concat(k.cast("string"), F.lit(',"'), F.col("o_orderpriority"), F.lit('\n,""x"" "'), F.when(k % 97 == 0, ",more").otherwise(""))
    rows = table(spark, sf, "orders").select((k % 16).alias("part"), k.alias("place"), line.alias("value"))
    rows = rows.unionByName(spark.range(16).select(F.col("id").alias("part"), F.lit(-1).alias("place"), F.lit("key,text").alias("value")))
    rows = rows.repartition(16, "part").sortWithinPartitions("part", "place").select("part", "value")
    rows.write.partitionBy("part").text(path)
    return tables.csv_parse_findings(tables.read_raw_csv(spark, f"{path}/*"))


_BIG_FILES = O.FILES.replace("files AS", "small AS", 1) + """,
files AS (
  SELECT 'b' || (c % 16) AS file_id, 'python' AS language, string_agg(content, chr(10) ORDER BY k) AS content
  FROM small WHERE language = 'python' GROUP BY ALL
)"""


def _big_files(spark, sf):
    """Sixteen text files that hold all python files, one behind the other."""
    path = f"{new_folder(spark, 'code')}/big"
    small = corpus.code_files(spark, sf).filter(F.col("language") == "python")
    orders = table(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("file_id"), "o_orderkey", "o_custkey")
    rows = small.join(orders, "file_id").select((F.col("o_custkey") % 16).alias("big"), "o_orderkey", "content")
    rows = rows.repartition(16, "big").sortWithinPartitions("big", "o_orderkey").select("big", "content")
    rows.write.partitionBy("big").text(path)
    lines = blocks.numbered_lines(spark, path)
    return lines.withColumn("file_id", F.concat(F.lit("b"), F.regexp_extract("file", r"/big=(\d+)/", 1)))


@query("lines_of_big_files", f"WITH {_BIG_FILES}, {O.LINES} SELECT file_id, line, raw AS text FROM lines")
def _(spark, sf):
    return _big_files(spark, sf).select("file_id", "line", "text")


@query(
    "patterns_of_big_files",
    f"WITH {_BIG_FILES}, {O.LINES}, {O.PY_LINES}, {O.PY_PATTERNS} SELECT file_id, line, type FROM py_patterns",
)
def _(spark, sf):
    lines = _big_files(spark, sf).withColumn("language", F.lit("python"))
    return line_patterns.pattern_hits_of_lines(lines).select("file_id", "line", "type")


# ------------------------------------------------------------------ scanning what changed


def _before(files):
    """The files as they were: every seventh was other code, every eleventh another language, every thirteenth was not there."""
    k = F.substring("file_id", 2, 20).cast("long")
    return files.filter(k % 13 != 0).withColumns(
        {
            "content": F.when(k % 7 == 0, "x = eval(y)").otherwise(F.col("content")),
            "language": F.when(k % 11 == 0, "java").otherwise(F.col("language")),
        }
    )


def _two_runs(spark, sf):
    store, files = new_folder(spark, "scans"), corpus.code_files(spark, sf)
    rescan.rescan(_before(files), store, "1")
    return store, rescan.rescan(files, store, "2")


@query("rescanned_findings", O.CODE + f"SELECT {_F} FROM findings")
def _(spark, sf):
    """The second run's findings are those of a full scan."""
    return _two_runs(spark, sf)[1].select(_FINDING_COLUMNS)


@query(
    "rescanned_files",
    O.CODE + "SELECT file_id FROM files WHERE k % 7 = 0 OR (k % 11 = 0 AND language <> 'java') OR k % 13 = 0",
)
def _(spark, sf):
    """The files that the second run has parsed."""
    return rescan.scanned_files(spark, _two_runs(spark, sf)[0], "2")


# ------------------------------------------------------------------ quality


def _events(spark, sf):
    return samples.events(spark, sf)


def _gappy(spark, sf):
    return samples.gappy_events(spark, sf)


@query("table_quality_report", O.table_report("", "events", "events", O.EVENT_COLUMNS))
def _(spark, sf):
    return quality.table_quality_report(_events(spark, sf), "events")


@query("table_quality_report_gappy", O.table_report(O.GAPPY, "gappy", "gappy", O.GAPPY_COLUMNS))
def _(spark, sf):
    return quality.table_quality_report(_gappy(spark, sf), "gappy")


@query("table_quality_report_wide", O.table_report("", "lineitem", "lineitem", O.LINEITEM_COLUMNS))
def _(spark, sf):
    return quality.table_quality_report(table(spark, sf, "lineitem"), "lineitem")


@query(
    "row_and_column_count",
    "SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem",
)
def _(spark, sf):
    return quality.row_and_column_count(table(spark, sf, "lineitem"))


def _per_column(columns: list[tuple[str, str]], select: str, where: str) -> str:
    parts = [
        f"SELECT {pos} AS pos, {O.q(c)} AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_missing, count({c}) AS n_present, "
        + (f"count(*) FILTER (WHERE regexp_matches({c}, {O.q(O.NUMBER)}))" if kind == "text" else "0")
        + f" AS n_numeric, {O.q(kind)} AS kind FROM gappy"
        for pos, (c, kind) in enumerate(columns)
    ]
    return f"WITH {O.GAPPY}, p AS ({' UNION ALL '.join(parts)}) SELECT {select} FROM p WHERE {where}"


@query(
    "column_profile",
    _per_column(O.GAPPY_COLUMNS, "pos, column_name, kind, n_rows, n_missing, n_present, n_numeric", "true"),
)
def _(spark, sf):
    return quality.profile(_gappy(spark, sf))


@query(
    "missing_values",
    _per_column(
        O.GAPPY_COLUMNS,
        "pos, column_name, n_missing, round_even(n_missing * 100 / n_rows, 1) AS pct, "
        "CASE WHEN round_even(n_missing * 100 / n_rows, 1) > 30 THEN 'high' ELSE 'medium' END AS severity",
        "n_missing > 0",
    ),
)
def _(spark, sf):
    return quality.missing_values(_gappy(spark, sf))


@query(
    "mixed_type_columns",
    _per_column(
        O.GAPPY_COLUMNS, "pos, column_name, n_numeric, n_present",
        "kind = 'text' AND n_numeric > 0 AND n_numeric < n_present AND n_numeric > n_present * 0.5",
    ),
)
def _(spark, sf):
    return quality.mixed_type_columns(_gappy(spark, sf))


@query("empty_columns", _per_column(O.GAPPY_COLUMNS, "pos, column_name", "n_present = 0"))
def _(spark, sf):
    return quality.empty_columns(_gappy(spark, sf))


@query(
    "duplicate_rows",
    "SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS c FROM documents GROUP BY text)",
)
def _(spark, sf):
    return quality.duplicate_rows(table(spark, sf, "documents").select("text"))


_QUARTILES = "WITH v AS ({}) SELECT * FROM v".format(
    " UNION ALL ".join(
        f"SELECT {O.q(c)} AS column_name, count({c}) AS n, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.75), 6) AS q3 FROM lineitem"
        for c, kind in O.LINEITEM_COLUMNS
        if kind == "number"
    )
)


def _rounded(df):
    return df.select("column_name", "n", F.round("q1", 6).alias("q1"), F.round("q3", 6).alias("q3"))


@query("quartiles", _QUARTILES)
def _(spark, sf):
    return _rounded(quality.column_quartiles(table(spark, sf, "lineitem")))


def _batches(df, id_column):
    return [df.filter(F.pmod(F.xxhash64(id_column), F.lit(10)) == i) for i in range(10)]


@query("quartiles_by_histogram", _QUARTILES)
def _(spark, sf):
    """From sketches that ten batches left, merged; the second read counts the values in the bins of the brackets."""
    rows = table(spark, sf, "lineitem")
    several = reduce(DataFrame.unionByName, [sketches(long_values(b)) for b in _batches(rows, "l_orderkey")])
    return _rounded(quartiles(long_values(rows), known=merged(several)))


def _audited(spark, rows, id_column, name):
    path = new_folder(spark, "audit")
    for i, batch in enumerate(_batches(rows, id_column)):
        audits.audit_batch(batch, path, str(i))
    audits.audit_batch(_batches(rows, id_column)[3], path, "3")  # written again: replaced
    return audits.audited_report(rows, path, name)


@query("table_quality_report_of_batches", O.table_report("", "lineitem", "lineitem", O.LINEITEM_COLUMNS))
def _(spark, sf):
    """Ten batches, each audited once, and the report of them all."""
    return _audited(spark, table(spark, sf, "lineitem"), "l_orderkey", "lineitem")


_EVENT_ROWS = "user_id, event_type, ts, value, props"


@query(
    "duplicate_event_rows",
    f"SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS c FROM events GROUP BY {_EVENT_ROWS})",
)
def _(spark, sf):
    """All columns of the events but their id: numbers, texts and times to the microsecond."""
    return quality.duplicate_rows(_events(spark, sf).drop("event_id"))


@query(
    "duplicate_documents",
    "SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang, source, n_chars)",
)
def _(spark, sf):
    return quality.duplicate_rows(table(spark, sf, "documents").drop("doc_id"))


@query(
    "iqr_outliers",
    """WITH f AS (SELECT q1 - 3 * (q3 - q1) AS lower, q3 + 3 * (q3 - q1) AS upper FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))
SELECT 'value' AS column_name, count(*) AS n_outliers, round(any_value(lower), 6) AS lower, round(any_value(upper), 6) AS upper FROM events, f WHERE value < lower OR value > upper""",
)
def _(spark, sf):
    far = quality.iqr_outliers(_events(spark, sf))
    return far.select("column_name", "n_outliers", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query(
    "outlier_rows",
    """WITH f AS (SELECT q3 + 3 * (q3 - q1) AS upper FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))
SELECT event_id, user_id, event_type, value FROM events, f WHERE value > upper""",
)
def _(spark, sf):
    return quality.outlier_rows(_events(spark, sf), "value").select("event_id", "user_id", "event_type", "value")


def _two_reports(spark, sf):
    return quality.table_quality_report(_events(spark, sf), "events").unionByName(
        quality.table_quality_report(table(spark, sf, "lineitem"), "lineitem")
    )


_TWO = (
    f"WITH a AS ({O.table_report('', 'events', 'events', O.EVENT_COLUMNS)}), "
    f"b AS ({O.table_report('', 'lineitem', 'lineitem', O.LINEITEM_COLUMNS)}), t AS (SELECT * FROM a UNION ALL SELECT * FROM b) "
)


@query(
    "total_real_findings",
    _TWO + "SELECT table_name, count(*) FILTER (WHERE bug_type <> 'No Issues') AS total_bugs FROM t GROUP BY table_name",
)
def _(spark, sf):
    return quality.total_real_findings(_two_reports(spark, sf))


@query("clean_tables", _TWO + "SELECT table_name, bool_and(bug_type = 'No Issues') AS is_clean FROM t GROUP BY table_name")
def _(spark, sf):
    return quality.is_clean(_two_reports(spark, sf))


# ------------------------------------------------------------------ votes


def _vote_inputs(spark, sf):
    runs = samples.model_runs(spark, sf)
    return keep(_candidates(spark, sf)), runs, reports.read_model_verdicts(runs)


@query(
    "verdict_matches",
    O.VOTED
    + " SELECT DISTINCT file_id, line_number, bug_type, model FROM matches",
)
def _(spark, sf):
    found, _, verdicts = _vote_inputs(spark, sf)
    return voting.match_verdicts(found, verdicts).select("file_id", "line_number", "bug_type", "model").distinct()


@query(
    "first_match_per_model",
    O.VOTED + " SELECT file_id, line_number, bug_type, model, ord, v_explanation, v_fix FROM firsts",
)
def _(spark, sf):
    found, _, verdicts = _vote_inputs(spark, sf)
    return voting.first_match_per_model(found, verdicts).drop("model_ord")


@query("vote_counts", O.VOTED + " SELECT file_id, line_number, bug_type, votes, v_explanation, v_fix FROM counts")
def _(spark, sf):
    found, _, verdicts = _vote_inputs(spark, sf)
    return voting.count_votes(found, verdicts)


@query("models_asked", O.VOTED + " SELECT file_id, total, error FROM asked")
def _(spark, sf):
    return voting.models_asked(samples.model_runs(spark, sf))


@query("voted_findings", O.VOTED + O.VOTE_RESULT)
def _(spark, sf):
    voted = voting.vote(*_vote_inputs(spark, sf))
    return voted.select(
        "file_id", "line_number", "bug_type", "explanation", "suggested_fix", "llm_validated", "majority",
        "validation_votes", "validation_note",
    )


# ------------------------------------------------------------------ similarity


def _vectors(spark, sf):
    return samples.vector_queries(spark, sf), samples.vector_history(spark, sf)


@query("similar_top_k", O.SCORED + "SELECT query_id, vec_id, score, rank FROM best WHERE score > 0.3")
def _(spark, sf):
    return similarity.top_k(*_vectors(spark, sf), digits=6)


def _index(spark, store):
    """An index trained on the vectors and filled in three batches."""
    path = new_folder(spark, "index")
    vector_index.train_index(store, path)
    for i in range(3):
        vector_index.append_index(store.filter(F.col("vec_id") % 3 == i), path, str(i))
    vector_index.append_index(store.filter(F.col("vec_id") % 3 == 1), path, "1")  # written again: replaced
    return path


@query("similar_by_index", O.SCORED + "SELECT query_id, vec_id, score, rank FROM best WHERE score > 0.3")
def _(spark, sf):
    """The exact result by way of the stored index."""
    queries, store = _vectors(spark, sf)
    return similarity.top_k(queries, None, digits=6, index=_index(spark, store))


@query("similar_history_by_index", O.SCORED + "SELECT * FROM kept")
def _(spark, sf):
    queries, store = _vectors(spark, sf)
    return similarity.similar_history(queries, store, digits=6, index=_index(spark, store))


_BROKEN = """
WITH e AS (
  SELECT vec_id, CAST(label AS VARCHAR) AS language, CASE vec_id % 50 WHEN 0 THEN NULL
    WHEN 1 THEN list_append(CAST(embedding AS DOUBLE[])[2:], NULL) WHEN 2 THEN CAST(embedding AS DOUBLE[])[:5]
    WHEN 3 THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 0)
    WHEN 4 THEN list_prepend('nan'::DOUBLE, CAST(embedding AS DOUBLE[])[2:]) ELSE CAST(embedding AS DOUBLE[]) END AS v FROM embeddings
)"""


@query(
    "unusable_vectors",
    _BROKEN
    + """SELECT vec_id, language, len(v) AS size,
  ['no vector', 'holds null', 'other size', 'zero', 'holds a number that is not finite'][vec_id % 50 + 1] AS reason FROM e WHERE vec_id % 50 < 5""",
)
def _(spark, sf):
    return similarity.unusable_vectors(samples.broken_vectors(spark, sf), "vec_id")


@query(
    "similar_among_broken",
    _BROKEN
    + """, scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score
  FROM e a JOIN e b ON a.language = b.language AND len(a.v) = len(b.v)
  WHERE a.vec_id % 50 NOT IN (0, 1, 3, 4) AND b.vec_id % 50 NOT IN (0, 1, 3, 4)
) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored WHERE score > 0.3 QUALIFY rank <= 6""",
)
def _(spark, sf):
    v = samples.broken_vectors(spark, sf)
    return similarity.top_k(v.withColumnRenamed("vec_id", "query_id"), v, digits=6)


@query(
    "similar_without_self",
    O.SCORED + "SELECT query_id, vec_id, score, rank FROM best WHERE score > 0.3 AND score < 0.99",
)
def _(spark, sf):
    return similarity.drop_self(similarity.top_k(*_vectors(spark, sf), digits=6))


@query("similar_deduped", O.SCORED + "SELECT query_id, vec_id, score, rank FROM single")
def _(spark, sf):
    queries, store = _vectors(spark, sf)
    best = similarity.drop_self(similarity.top_k(queries, store, digits=6))
    return similarity.dedupe_matches(best.join(store.select("vec_id", "explanation"), "vec_id")).drop("explanation")


@query("similar_history", O.SCORED + "SELECT * FROM kept")
def _(spark, sf):
    return similarity.similar_history(*_vectors(spark, sf), digits=6)


@query(
    "nested_history",
    O.SCORED
    + """SELECT e.vec_id AS query_id, e.language, coalesce(string_agg(bug_type || ':' || explanation || ':' || fix || ':' || similarity, ';' ORDER BY rank), '') AS matches
FROM e LEFT JOIN kept k ON k.query_id = e.vec_id GROUP BY ALL""",
)
def _(spark, sf):
    queries, store = _vectors(spark, sf)
    nested = similarity.nest_matches(queries, similarity.similar_history(queries, store, digits=6))
    flat = F.transform(
        "historical_bugs",
        lambda m: F.concat_ws(":", m["bug_type"], m["explanation"], m["fix"], m["similarity"].cast("string")),
    )
    return nested.select("query_id", "language", F.array_join(flat, ";").alias("matches"))


@query(
    "vector_norms",
    "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, "
    "round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 6) AS mirrored FROM embeddings",
)
def _(spark, sf):
    v = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(T.norm(v), 6).alias("norm"), F.round(T.cosine(v, F.reverse(v)), 6).alias("mirrored")
    )


@query("hash_embedding", f"SELECT doc_id, {O.embedding('text')} AS vector FROM documents")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return docs.select("doc_id", _numbers(_embed(F.col("text"))))


# ------------------------------------------------------------------ summaries


@query("severity_breakdown", O.CODE + "SELECT file_id, severity, count(*) AS n FROM findings GROUP BY ALL")
def _(spark, sf):
    return summaries.severity_breakdown(_candidates(spark, sf))


@query("total_findings", O.CODE + "SELECT file_id, count(*) AS total_bugs FROM findings GROUP BY file_id")
def _(spark, sf):
    return summaries.total_findings(_candidates(spark, sf))


@query(
    "confirmed_findings",
    O.CODE + "SELECT file_id, line_number, bug_type, severity FROM findings WHERE severity IN ('high', 'critical')",
)
def _(spark, sf):
    return summaries.confirmed_findings(_candidates(spark, sf)).select("file_id", "line_number", "bug_type", "severity")


@query(
    "fact_counts",
    O.CODE
    + """, facts AS (SELECT file_id, 'function' AS kind FROM fn UNION ALL SELECT file_id, 'variable' FROM vars UNION ALL SELECT file_id, 'risk' FROM risks
  UNION ALL SELECT file_id, kind FROM nodes WHERE kind IN ('function', 'variable'))
SELECT file_id, kind, count(*) AS n FROM facts GROUP BY ALL""",
)
def _(spark, sf):
    files = corpus.code_files(spark, sf)
    trees = keep(python_scan.parse_python(files))  # parsed once for facts and risks
    py = python_scan.python_facts(trees).filter(F.col("kind").isin("function", "variable"))
    facts = (
        js_scan.js_functions(files).select("file_id", F.lit("function").alias("kind"))
        .unionByName(js_scan.js_variables(files).select("file_id", F.lit("variable").alias("kind")))
        .unionByName(code_scan.scan(files, trees).risks.select("file_id", F.lit("risk").alias("kind")))
        .unionByName(py.select("file_id", "kind"))
    )
    return summaries.fact_counts(facts)


@query(
    "observed_counts",
    O.CODE
    + "SELECT count(*) AS total_bugs, "
    + ", ".join(f"count(*) FILTER (WHERE severity = {O.q(s)}) AS {s}" for s in summaries.SEVERITIES)
    + " FROM findings",
)
def _(spark, sf):
    """The log row of a run: its counts come from the job that writes the findings."""
    path = new_folder(spark, "run")
    counts = summaries.write_counted(_candidates(spark, sf), f"{path}/findings")
    history.append_run_log(spark, counts, f"{path}/log", "1")
    return spark.read.parquet(f"{path}/log").drop("reviewed_at", "batch")


@query("flagged_lines", O.CODE + "SELECT DISTINCT file_id, line_number FROM findings WHERE line_number > 0")
def _(spark, sf):
    return summaries.flagged_lines(_candidates(spark, sf))


@query(
    "file_report",
    O.CODE
    + """, per AS (SELECT file_id, count(*) AS total_bugs, """
    + ", ".join(f"count(*) FILTER (WHERE severity = {O.q(s)}) AS {s}" for s in ("critical", "high", "medium", "low", "info", "unknown"))
    + """ FROM findings GROUP BY file_id),
fns AS (SELECT file_id, count(*) AS n FROM (SELECT file_id FROM fn UNION ALL SELECT file_id FROM nodes WHERE kind = 'function') GROUP BY file_id),
lc AS (SELECT file_id, count(*) AS line_count FROM lines GROUP BY file_id)
SELECT file_id, language AS file_type, line_count, """
    + ", ".join(f"coalesce({s}, 0) AS {s}" for s in ("total_bugs", "critical", "high", "medium", "low", "info", "unknown"))
    + """, coalesce(n, 0) AS functions_found FROM files JOIN lc USING (file_id) LEFT JOIN per USING (file_id) LEFT JOIN fns USING (file_id)""",
)
def _(spark, sf):
    files = corpus.code_files(spark, sf)
    return summaries.file_report(files, *review.scan_once(files))


@query(
    "nested_report",
    O.CODE
    + """, per AS (SELECT file_id, string_agg(severity || '=' || n, ',' ORDER BY severity) AS severities
  FROM (SELECT file_id, severity, count(*) AS n FROM findings GROUP BY ALL) GROUP BY file_id),
bugs AS (SELECT file_id, count(*) AS n_bugs, string_agg(line_number || ' ' || bug_type || ' ' || severity || ' ' || explanation || ' ' || impact || ' ' || suggested_fix, chr(10)
  ORDER BY line_number, bug_type) AS bugs FROM findings GROUP BY file_id)
SELECT file_id, coalesce(severities, '') AS severities, coalesce(n_bugs, 0) AS total_bugs, coalesce(bugs, '') AS bugs
FROM files LEFT JOIN per USING (file_id) LEFT JOIN bugs USING (file_id)""",
)
def _(spark, sf):
    """The report with its map and its array, both written out as text."""
    files = corpus.code_files(spark, sf)
    report = summaries.nested_report(files, *review.scan_once(files))
    pairs = F.array_sort(F.transform(F.map_entries("severity_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    words = lambda b: F.concat_ws(" ", b["line_number"], b["bug_type"], b["severity"], b["explanation"], b["impact"], b["suggested_fix"])
    rows = F.array_sort(F.transform("bugs", lambda b: F.struct(b["line_number"], b["bug_type"], words(b).alias("text"))))
    return report.select("file_id", F.array_join(pairs, ",").alias("severities"), "total_bugs", F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("bugs"))


@query("code_review")
def _(spark, sf):
    """All steps over all files; the history holds the vectors of every severe finding."""
    files = corpus.code_files(spark, sf)
    store = keep(history.history_rows(_with_language(spark, sf), "earlier"))
    return review.review_code(files, runs=samples.model_runs(spark, sf), history=store).findings


def _vector_sql(expr):
    return f"list_transform(range(0, 32), lambda i: (('0x' || substr(sha256({expr}), i * 2 + 1, 2))::INTEGER - 128)::DOUBLE / 128)"


@query(
    "table_review",
    f"WITH report AS ({O.table_report(O.GAPPY, 'gappy', 'gappy', O.GAPPY_COLUMNS)}), "
    + "q AS (SELECT *, 'csv' AS language, "
    + _vector_sql(_FINDING_TEXT.replace("language", "'csv'"))
    + " AS v FROM report), h AS (SELECT vec_id::VARCHAR AS vec_id, 'earlier ' || vec_id AS explanation, "
    + _vector_sql("vec_id::VARCHAR")
    + """ AS v FROM embeddings),
scored AS (
  SELECT q.ord, h.vec_id, h.explanation, list_dot_product(q.v, h.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(h.v, h.v))) AS score
  FROM q, h),
best AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY score DESC, vec_id) AS rank FROM scored WHERE score > 0.3 QUALIFY rank <= 6),
kept AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY rank) AS place FROM best WHERE score < 0.99 QUALIFY place <= 3),
told AS (
  SELECT ord, string_agg('Missing Values:' || explanation || ':fill:' || round_even(score * 100, 1), ';' ORDER BY place) AS matches FROM kept GROUP BY ord)
SELECT table_name, ord, bug_type, line_number, column_name, explanation, impact, severity, suggested_fix, source, language, coalesce(matches, '') AS matches
FROM q LEFT JOIN told USING (ord)""",
)
def _(spark, sf):
    """A table's report with similar findings of a history whose vectors are 256-bit digests."""
    store = samples.embeddings(spark, sf).select(
        F.col("vec_id").cast("string").alias("vec_id"), F.lit("csv").alias("language"),
        _embed(F.col("vec_id").cast("string")).alias("vector"), F.lit("Missing Values").alias("bug_type"),
        F.concat(F.lit("earlier "), F.col("vec_id").cast("string")).alias("explanation"), F.lit("fill").alias("fix"),
    )
    reviewed = review.review_table(_gappy(spark, sf), "gappy", store, embed=_embed)
    told = F.transform("historical_bugs", lambda m: F.concat_ws(":", m["bug_type"], m["explanation"], m["fix"], m["similarity"].cast("string")))
    return reviewed.select("*", F.array_join(told, ";").alias("matches")).drop("historical_bugs", "finding_id")
