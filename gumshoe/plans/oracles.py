"""The same questions in plain SQL, to compare the Spark results with.

The SQL is written naively (joins on file and line, theta conditions, windows)
and independently of the Spark plans. Word lists and wording are shared, as
they are fixed values.
"""

from __future__ import annotations

from gumshoe.functions import patterns as P
from gumshoe.operators import catalogue as C
from gumshoe.operators import quality as Q
from gumshoe.plans import corpus, samples


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: list[str]) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def listed(items: list[str]) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def fill(template: str, **values: str) -> str:
    """A SQL expression for a sentence with values put in."""
    out = q(template)
    for name, expr in values.items():
        out = f"replace({out}, {q('{' + name + '}')}, {expr})"
    return out


W = r"[\w\p{L}\p{N}]"
S = P.S
TRIM = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)||chr(5760)||" + "||".join(
    f"chr({c})" for c in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
BREAK = P.LINE_BREAK


def strip(expr: str) -> str:
    return f"trim({expr}, {TRIM})"


# ------------------------------------------------------------ source files

_JS_TEXT = "concat_ws(chr(10), '// order ' || o_orderpriority || ' status ' || o_orderstatus, " + ", ".join(
    f"jt[((o_orderkey * {2 * j + 1} + o_custkey * {j} + {5 * j * j}) % {len(corpus.JS_LINES)}) + 1]"
    for j in range(corpus.JS_PICKS)
) + ")"
_PY_PICK = [f"((o_orderkey * {j + 1} + o_custkey + {3 * j}) % {len(corpus.PY_BLOCKS)})" for j in range(corpus.PY_PICKS)]
_PY_TEXT = (
    "concat_ws(chr(10), '# order ' || o_orderpriority || ' status ' || o_orderstatus, "
    + ", ".join(f"pt[{p} + 1]" for p in _PY_PICK)
    + f", CASE WHEN o_orderkey % 23 = 0 THEN {q(corpus.PY_BROKEN)} END)"
)
FILES = f"""
files AS (
  SELECT 'f' || o_orderkey AS file_id, o_orderkey AS k, o_custkey AS c, language,
    replace(replace(body, '{{v}}', CAST(o_custkey % 5 AS VARCHAR)), '{{k}}', CAST(o_orderkey % 9 AS VARCHAR)) AS content
  FROM (SELECT *, ({listed(corpus.LANGUAGES)})[(o_orderkey % 4) + 1] AS language,
          CASE WHEN o_orderkey % 4 = 0 THEN {_PY_TEXT} ELSE {_JS_TEXT} END AS body
        FROM orders, (SELECT {listed(corpus.JS_LINES)} AS jt, {listed(corpus.PY_BLOCKS)} AS pt))
)"""
PAGES = "files AS (SELECT 'p' || page_id AS file_id, 'javascript' AS language, html AS content FROM pages)"
DOCUMENTS = "files AS (SELECT 'd' || doc_id AS file_id, 'python' AS language, text AS content FROM documents)"
LINES = f"""
lines AS (
  SELECT file_id, language, generate_subscripts(a, 1) AS line, unnest(a) AS raw
  FROM (SELECT file_id, language, CASE WHEN content = '' THEN [] WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS a
        FROM (SELECT *, regexp_split_to_array(content, {q(BREAK)}) AS parts FROM files))
),
stripped AS (SELECT file_id, language, line, {strip('raw')} AS text FROM lines)"""


def lines_of(files: str) -> str:
    return f"WITH {files}, {LINES}"


_F4 = rf"^(?:export{S}+)?(?:async{S}+)?function{S}+({W}+){S}*\(([^)]*)\)"
_F5 = rf"^(?:const|let|var){S}+({W}+){S}*={S}*(?:async{S}+)?\(([^)]*)\)"
_F6 = rf"^(?:const|let|var){S}+({W}+)"
_F7 = rf"^for{S}*\({S}*(?:let|var|const){S}+({W}+)"
JS_FACTS = f"""
jl AS (SELECT * FROM stripped WHERE language IN ('javascript', 'typescript')),
code AS (SELECT * FROM jl WHERE NOT (starts_with(text, '//') OR starts_with(text, '/*') OR starts_with(text, '*'))),
fn AS (
  SELECT file_id, line, regexp_extract(text, {q(_F4)}, 1) AS name, regexp_extract(text, {q(_F4)}, 2) AS plist
  FROM jl WHERE regexp_matches(text, {q(_F4)})
  UNION ALL
  SELECT file_id, line, regexp_extract(text, {q(_F5)}, 1), regexp_extract(text, {q(_F5)}, 2)
  FROM jl WHERE regexp_matches(text, {q(_F5)})
),
params AS (
  SELECT file_id, line, name, pos, {strip("split_part(" + strip("p") + ", '=', 1)")} AS param
  FROM (SELECT file_id, line, name, generate_subscripts(string_split(plist, ','), 1) AS pos,
               unnest(string_split(plist, ',')) AS p FROM fn)
  WHERE {strip('p')} <> ''
),
vars AS (SELECT file_id, line, regexp_extract(text, {q(_F6)}, 1) AS name FROM jl
         WHERE regexp_matches(text, {q(_F6)}) AND NOT regexp_matches(text, {q(_F5)})),
loopvars AS (SELECT file_id, line, regexp_extract(text, {q(_F7)}, 1) AS name FROM jl WHERE regexp_matches(text, {q(_F7)})),
declared AS (
  SELECT file_id, name FROM fn UNION SELECT file_id, param FROM params
  UNION SELECT file_id, name FROM vars UNION SELECT file_id, name FROM loopvars
),
pool AS (SELECT DISTINCT p.file_id, p.param FROM params p
         JOIN (SELECT file_id, name, max(line) AS line FROM fn GROUP BY ALL) l USING (file_id, name, line))"""

_R8 = rf"({W}+){S}*<={S}*({W}+)\.length"
_R9 = rf"({W}+)\[({W}+){S}*\+{S}*(\p{{Nd}}+)\]"
_R10 = rf"({W}+)\.({W}+)"
_R11 = rf"({W}+){S}*/{S}*({W}[\w\p{{L}}\p{{N}}.]*)"
_R13 = rf"({W}+)\({S}*null{S}*\)"
_CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '//.*$', ''), "
    "'\"[^\"]*\"', '\"\"', 'g'), '''[^'']*''', '''''', 'g'), '`[^`]*`', '``', 'g')"
)
M = C.MESSAGE["js"]
_GUARD = " OR ".join(f"contains(g.text, {q(m)})" for m in P.JS_GUARD_MARKS)
_NULLS = "NULL::VARCHAR"
JS_HITS = f"""
tokens AS (
  SELECT file_id, line, generate_subscripts(t, 1) AS pos, unnest(t) AS token
  FROM (SELECT file_id, line, regexp_extract_all({_CLEAN}, {q(W + '+')}) AS t FROM code
        WHERE NOT regexp_matches(text, {q(P.JS_DECLARATION_START)}))
),
unknown AS (
  SELECT file_id, line, arg_min(token, pos) AS token FROM tokens t
  WHERE regexp_matches(token, '^[a-zA-Z_]') AND token NOT IN {words(P.JS_BUILTINS + P.JS_KEYWORDS)}
    AND NOT EXISTS (SELECT 1 FROM declared d WHERE d.file_id = t.file_id AND d.name = t.token)
  GROUP BY ALL
),
member AS (
  SELECT file_id, line, regexp_extract(text, {q(_R10)}, 1) AS obj, regexp_extract(text, {q(_R10)}, 2) AS member
  FROM code WHERE regexp_matches(text, {q(_R10)})
),
js_risks AS (
  SELECT file_id, line, 1 AS rule, 'off_by_one' AS type, {fill(M['off_by_one'], variable='v', array='a')} AS message,
         v AS variable, a AS "array", {_NULLS} AS "function"
  FROM (SELECT *, regexp_extract(text, {q(_R8)}, 1) AS v, regexp_extract(text, {q(_R8)}, 2) AS a FROM code) WHERE v <> ''
  UNION ALL
  SELECT file_id, line, 2, 'out_of_bounds', {fill(M['out_of_bounds'], array='a', index='i', step='s')}, NULL, a, NULL
  FROM (SELECT *, regexp_extract(text, {q(_R9)}, 1) AS a, regexp_extract(text, {q(_R9)}, 2) AS i, regexp_extract(text, {q(_R9)}, 3) AS s FROM code)
  WHERE a <> '' AND NOT regexp_matches(text, 'if|while|&&|\\|\\||\\.length')
  UNION ALL
  SELECT m.file_id, m.line, 3, 'null_reference', {fill(M['null_reference'], variable='obj', member='member')}, obj, NULL, NULL
  FROM member m JOIN pool p ON p.file_id = m.file_id AND p.param = m.obj
  WHERE obj NOT IN {words(P.JS_SAFE_OBJECTS)} AND NOT EXISTS (
    SELECT 1 FROM jl g WHERE g.file_id = m.file_id AND g.line BETWEEN m.line - 4 AND m.line - 1
      AND contains(g.text, m.obj) AND ({_GUARD}))
  UNION ALL
  SELECT file_id, line, 4, 'division', {fill(M['division'], variable='d')}, d, NULL, NULL
  FROM (SELECT *, regexp_extract(text, {q(_R11)}, 0) AS whole, regexp_extract(text, {q(_R11)}, 2) AS d FROM code)
  WHERE d <> '' AND NOT contains(split_part(text, whole, 1), '//')
  UNION ALL
  SELECT file_id, line, 5, 'undefined_variable', {fill(M['undefined_variable'], variable='token')}, token, NULL, NULL FROM unknown
  UNION ALL
  SELECT file_id, line, 6, 'null_argument', {fill(M['null_argument'], function='f')}, NULL, NULL, f
  FROM (SELECT *, regexp_extract(text, {q(_R13)}, 1) AS f FROM code) c
  WHERE f NOT IN ('console', 'Math') AND EXISTS (SELECT 1 FROM fn WHERE fn.file_id = c.file_id AND fn.name = c.f)
  UNION ALL
  SELECT file_id, line, 7, 'security', {q(M['security'])}, NULL, NULL, NULL FROM code WHERE contains(text, 'eval(')
),
js_patterns AS (
  SELECT file_id, line, 11 AS rule, 'loose_equality' AS type FROM code
  WHERE regexp_matches(text, '[^=!]==[^=]') AND NOT contains(text, '===')
  UNION ALL SELECT file_id, line, 12, 'eval' FROM code WHERE contains(text, 'eval(')
  UNION ALL SELECT file_id, line, 13, 'hardcoded_secret_js' FROM code
  WHERE regexp_matches(text, '(?i)(password|secret|api_key|token){S}*[:=]{S}*["''][^"'']+["'']')
)"""
PY_PATTERNS = f"""
py_patterns AS (
  SELECT file_id, line, 11 AS rule, 'mutable_default' AS type FROM py
  WHERE regexp_matches(text, 'def{S}+{W}+\\(.*={S}*(\\[\\]|\\{{\\}}|\\(\\))')
  UNION ALL SELECT file_id, line, 12, 'large_index' FROM py
  WHERE regexp_matches(text, '{W}+\\[\\p{{Nd}}+\\]') AND NOT regexp_matches(text, 'if|while|for|len')
    AND regexp_matches(text, '{W}+\\[-?\\p{{Nd}}{{2,}}\\]')
  UNION ALL SELECT file_id, line, 13, 'bare_except' FROM py
  WHERE regexp_matches(text, 'except{S}*:') AND NOT regexp_matches(text, 'except{S}+{W}')
  UNION ALL SELECT file_id, line, 14, 'hardcoded_secret' FROM py
  WHERE regexp_matches(text, '(?i)(password|secret|api_key|token){S}*={S}*["''][^"'']+["'']')
  UNION ALL SELECT file_id, line, 15, 'global' FROM py WHERE starts_with(text, 'global ')
)"""
PY_LINES = "py AS (SELECT * FROM stripped WHERE language = 'python')"

# ------------------------------------------------------------ python facts
# What each python template states, read off by hand: template, line in it,
# kind, name, place, names. {v} and {k} stand for the file's own numbers.
_PY_FACTS = [
    (0, 1, "import", "math", 0, "math"), (0, 2, "import", "os.path", 0, "osp"),
    (0, 3, "import", "collections", 0, "collections,deque"),
    (1, 1, "function", "area{v}", 0, "w,h"), (1, 2, "local", "total", 0, ""), (1, 2, "variable", "total", 0, ""),
    (1, 3, "division", "", 0, ""), (1, 2, "load", "w", 1, ""), (1, 2, "load", "h", 2, ""),
    (1, 3, "load", "total", 1, ""), (1, 3, "load", "h", 2, ""),
    (2, 1, "function", "pick{v}", 0, "items,n"), (2, 2, "moved_index", "items", 0, "1"),
    (2, 2, "load", "items", 1, ""), (2, 2, "load", "n", 2, ""),
    (3, 1, "function", "root{v}", 0, "x"), (3, 3, "sqrt", "", 0, ""), (3, 3, "call", "sqrt", 0, ""),
    (3, 4, "bare_except", "", 0, ""), (3, 3, "load", "math", 2, ""), (3, 3, "load", "x", 1, ""),
    (4, 1, "function", "use{v}", 0, "q"), (4, 2, "local", "value", 0, ""), (4, 2, "variable", "value", 0, ""),
    (4, 2, "division", "", 0, ""), (4, 2, "load", "q", 1, ""), (4, 3, "load", "missing{k}", 1, ""),
    (5, 1, "call", "area{v}", 0, ""), (5, 2, "call", "pick{v}", 0, ""), (5, 3, "call", "other{k}", 0, ""),
    (5, 1, "zero_argument", "area{v}", 1, ""), (5, 2, "zero_argument", "pick{v}", 0, ""),
    (5, 3, "zero_argument", "other{k}", 0, ""),
    (6, 1, "class", "Shape{k}", 0, ""), (6, 2, "function", "draw", 0, "self,pen"), (6, 3, "loop", "for", 0, "edge"),
    (6, 4, "call", "print", 0, ""), (6, 3, "load", "pen", 1, ""), (6, 4, "load", "print", 1, ""),
    (6, 4, "load", "edge", 2, ""), (6, 5, "load", "total", 1, ""),
    (7, 1, "function", "log{v}", 0, "msg,seen"), (7, 3, "local", "count", 0, ""), (7, 3, "variable", "count", 0, ""),
    (7, 4, "loop", "while", 0, ""), (7, 4, "load", "count", 1, ""), (7, 6, "load", "msg", 1, ""),
    (8, 1, "variable", "password", 0, ""), (8, 2, "variable", "values", 0, ""), (8, 3, "variable", "big", 0, ""),
    (9, 1, "conditional", "", 0, ""), (9, 2, "division", "", 0, ""), (9, 2, "variable", "total", 0, ""),
    (10, 1, "function", "gather{v}", 0, ""), (10, 2, "load", "args", 1, ""), (10, 3, "load", "a", 1, ""),
    (10, 3, "load", "kw", 2, ""),
    (11, 2, "division", "", 0, ""),
    (12, 1, "function", "area{v}", 0, "one"), (12, 2, "load", "one", 1, ""),
]
_FACT_ROWS = ", ".join(f"({b}, {l}, {q(k)}, {q(n)}, {p}, {q(ns)})" for b, l, k, n, p, ns in _PY_FACTS)
_LENGTHS = listed([str(b.count("\n") + 1) for b in corpus.PY_BLOCKS]).replace("'", "")
PY_FACTS = f"""
picks AS (
  SELECT file_id, k, c, j, block, 2 + coalesce(sum(({_LENGTHS})[block + 1]) OVER (PARTITION BY file_id ORDER BY j
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    2 + sum(({_LENGTHS})[block + 1]) OVER (PARTITION BY file_id) AS after
  FROM ({" UNION ALL ".join(f"SELECT 'f' || o_orderkey AS file_id, o_orderkey AS k, o_custkey AS c, {j} AS j, {p} AS block FROM orders WHERE o_orderkey % 4 = 0" for j, p in enumerate(_PY_PICK))})
),
block_facts(block, rel, kind, name, pos, names) AS (VALUES {_FACT_ROWS}),
nodes AS (
  SELECT file_id, f.kind, CAST(start + rel - 1 AS BIGINT) AS line, pos, names,
    replace(replace(name, '{{v}}', CAST(c % 5 AS VARCHAR)), '{{k}}', CAST(k % 9 AS VARCHAR)) AS name
  FROM picks JOIN block_facts f USING (block) WHERE k % 23 <> 0
),
syntax AS (SELECT DISTINCT file_id, CAST(after AS BIGINT) AS line FROM picks WHERE k % 23 = 0),
py_defined AS (
  SELECT file_id, name FROM nodes WHERE kind IN ('function', 'class', 'local')
  UNION SELECT file_id, unnest(string_split(names, ',')) FROM nodes
  WHERE kind IN ('function', 'import', 'loop') AND names <> ''
),
py_functions AS (SELECT file_id, name, arg_max(names, line) AS names FROM nodes WHERE kind = 'function' GROUP BY ALL),
py_undefined AS (
  SELECT file_id, line, arg_min(name, pos) AS name FROM nodes n WHERE kind = 'load' AND name NOT IN {words(P.PY_BUILTINS)}
    AND NOT EXISTS (SELECT 1 FROM py_defined d WHERE d.file_id = n.file_id AND d.name = n.name) GROUP BY ALL
),
py_zero AS (
  SELECT n.file_id, n.line, n.name, string_split(f.names, ',')[n.pos + 1] AS param
  FROM nodes n JOIN py_functions f USING (file_id, name)
  WHERE n.kind = 'zero_argument' AND f.names <> '' AND len(string_split(f.names, ',')) > n.pos
),
py_risks AS (
  SELECT file_id, line, 'syntax_error' AS type, 'invalid syntax' AS message, {_NULLS} AS variable, {_NULLS} AS "function", {_NULLS} AS param FROM syntax
  UNION ALL SELECT DISTINCT file_id, line, 'division', {q(C.MESSAGE['py']['division'])}, NULL, NULL, NULL FROM nodes WHERE kind = 'division'
  UNION ALL SELECT DISTINCT file_id, line, 'bare_except', {q(C.MESSAGE['py']['bare_except'])}, NULL, NULL, NULL FROM nodes WHERE kind = 'bare_except'
  UNION ALL SELECT DISTINCT file_id, line, 'negative_sqrt', {q(C.MESSAGE['py']['negative_sqrt'])}, NULL, NULL, NULL FROM nodes WHERE kind = 'sqrt'
  UNION ALL SELECT file_id, line, 'out_of_bounds', {fill(C.MESSAGE['py']['out_of_bounds'], variable='name', step='names')}, name, NULL, NULL FROM nodes WHERE kind = 'moved_index'
  UNION ALL SELECT file_id, line, 'zero_argument', {fill(C.MESSAGE['py']['zero_argument'], function='name', param='param')}, NULL, name, param FROM py_zero
  UNION ALL SELECT file_id, line, 'undefined_variable', {fill(C.MESSAGE['py']['undefined_variable'], variable='name')}, name, NULL, NULL FROM py_undefined
)"""

# ------------------------------------------------------------ findings

_CATALOGUE = ", ".join(f"({q(r)}, {q(b)}, {q(s)}, {q(C.IMPACT[r])})" for r, b, s in C.RISKS)
_PATTERNS = ", ".join(
    f"({q(k)}, {q(v['bug_type'])}, {q(v['severity'])}, {q(v['explanation'])}, {q(v['impact'])}, {q(v['fix'])})"
    for k, v in C.PATTERN.items()
)
_FIX = "CASE type " + " ".join(
    "WHEN {} THEN {}".format(
        q(k), fill(v, **{n: f'coalesce("{n}", {q(d)})' for n, d in C.FIX_DEFAULT.get(k, {}).items()})
    )
    for k, v in C.FIX.items()
) + f" ELSE {q(C.FIX_OTHER)} END"
FINDINGS = f"""
catalogue(type, bug_type, severity, impact) AS (VALUES {_CATALOGUE}),
pattern_words(type, bug_type, severity, explanation, impact, fix) AS (VALUES {_PATTERNS}),
risks AS (
  SELECT file_id, line, line * 100 + rule AS ord, type, message, variable, "array", "function", {_NULLS} AS param FROM js_risks
  UNION ALL SELECT file_id, line, line, type, message, variable, NULL, "function", param FROM py_risks
),
all_findings AS (
  SELECT file_id, coalesce(c.bug_type, 'Runtime Risk') AS bug_type, line AS line_number, message AS explanation,
    coalesce(c.impact, 'May fail while running') AS impact, 'parser' AS source,
    coalesce(c.severity, 'medium') AS severity, {_FIX} AS suggested_fix, 1 AS priority, ord
  FROM risks LEFT JOIN catalogue c USING (type)
  UNION ALL
  SELECT file_id, w.bug_type, line, w.explanation, w.impact, 'pattern_detector', w.severity, w.fix, 2, line * 100 + rule
  FROM (SELECT * FROM js_patterns UNION ALL SELECT * FROM py_patterns) JOIN pattern_words w USING (type)
),
findings AS (
  SELECT * FROM all_findings
  QUALIFY row_number() OVER (PARTITION BY file_id, line_number, bug_type ORDER BY priority, ord) = 1
)"""

CODE = f"WITH {FILES}, {LINES}, {JS_FACTS}, {JS_HITS}, {PY_LINES}, {PY_PATTERNS}, {PY_FACTS}, {FINDINGS} "
PAGE_CODE = f"WITH {PAGES}, {LINES}, {JS_FACTS}, {JS_HITS} "


def js_rule(kind: str) -> str:
    return (
        CODE + f'SELECT file_id, line, message, variable, "array", "function" FROM js_risks WHERE type = {q(kind)}'
    )


def pattern(table: str, kind: str) -> str:
    return CODE + f"SELECT file_id, line FROM {table} WHERE type = {q(kind)}"


def py_rule(kind: str) -> str:
    return CODE + f'SELECT file_id, line, message, variable, "function", param FROM py_risks WHERE type = {q(kind)}'


# ------------------------------------------------------------ votes

_ANSWER = (
    f"replace(replace(({listed(samples.ANSWERS)})[((o_orderkey * 3 + m * (o_orderkey % 5 + 1)) % {len(samples.ANSWERS)}) + 1], "
    f"'{{m}}', model), '{{n}}', CAST(o_orderkey % 15 + 1 AS VARCHAR))"
)
_FENCE = rf"(?s)```(?:json)?{S}*\n(.*?)\n```"
VOTES = f"""
runs AS (
  SELECT 'f' || o_orderkey AS file_id, model, m AS model_ord,
    CASE WHEN o_orderkey % 17 = 0 AND m = 1 THEN 'invalid' WHEN (o_orderkey + m * 7) % 11 = 0 THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN o_orderkey % 17 = 0 AND m = 1 THEN 'timeout' ELSE {_ANSWER} END AS response
  FROM orders, (VALUES (0, 'model_a'), (1, 'model_b'), (2, 'model_c')) t(m, model) WHERE o_orderkey % 13 <> 0
),
payloads AS (
  SELECT *, CASE WHEN contains(a, '```') AND regexp_matches(a, {q(_FENCE)})
    THEN {strip('regexp_extract(a, ' + q(_FENCE) + ', 1)')} ELSE a END AS payload
  FROM (SELECT *, {strip('response')} AS a FROM runs WHERE status = 'ok')
),
arrays AS (SELECT * FROM payloads WHERE json_valid(payload) AND CASE WHEN json_valid(payload) THEN json_type(payload) = 'ARRAY' END),
verdicts AS MATERIALIZED (
  SELECT file_id, model, model_ord, ord - 1 AS ord, v->>'bug_type' AS bug_type, TRY_CAST(v->>'line_number' AS DOUBLE) AS line_number,
    v->>'explanation' AS explanation, v->>'suggested_fix' AS suggested_fix, v->>'impact' AS impact,
    TRY_CAST(v->>'confidence' AS DOUBLE) AS confidence
  FROM (SELECT file_id, model, model_ord, generate_subscripts(vs, 1) AS ord, unnest(vs) AS v
        FROM (SELECT *, list_filter(json_extract(payload, '$[*]'), lambda x: json_type(x) <> 'NULL') AS vs FROM arrays))
),
found AS MATERIALIZED (SELECT file_id, line_number, bug_type FROM findings),
kinds AS MATERIALIZED (
  SELECT f.bug_type, v.v_type FROM (SELECT DISTINCT bug_type FROM found) f, (SELECT DISTINCT coalesce(bug_type, '') AS v_type FROM verdicts) v
  WHERE contains(lower(f.bug_type), lower(v.v_type)) OR contains(lower(v.v_type), lower(f.bug_type))
),
matches AS (
  SELECT f.file_id, f.line_number, f.bug_type, v.model, v.model_ord, v.ord, v.explanation AS v_explanation, v.suggested_fix AS v_fix
  FROM found f JOIN verdicts v ON f.file_id = v.file_id AND f.line_number = v.line_number
  UNION
  SELECT f.file_id, f.line_number, f.bug_type, v.model, v.model_ord, v.ord, v.explanation, v.suggested_fix
  FROM found f JOIN kinds k ON f.bug_type = k.bug_type JOIN verdicts v ON f.file_id = v.file_id AND coalesce(v.bug_type, '') = k.v_type
),
firsts AS (SELECT * FROM matches QUALIFY row_number() OVER (PARTITION BY file_id, line_number, bug_type, model ORDER BY ord) = 1),
counts AS (
  SELECT file_id, line_number, bug_type, count(*) AS votes,
    arg_min(v_explanation, model_ord) FILTER (WHERE v_explanation <> '') AS v_explanation,
    arg_min(v_fix, model_ord) FILTER (WHERE v_fix <> '') AS v_fix
  FROM firsts GROUP BY ALL
),
asked AS (SELECT file_id, count(DISTINCT model) AS total, min(response) FILTER (WHERE status = 'invalid') AS error FROM runs GROUP BY ALL),
voted AS (
  SELECT f.*, c.votes, c.v_explanation, c.v_fix, a.total, a.error,
    a.total IS NOT NULL AND a.error IS NULL AS judged, coalesce(c.votes, 0) AS n
  FROM findings f LEFT JOIN counts c USING (file_id, line_number, bug_type) LEFT JOIN asked a USING (file_id)
)"""
VOTED = CODE + "," + VOTES
VOTE_RESULT = """
SELECT file_id, line_number, bug_type,
  CASE WHEN judged AND n >= least(2, total) THEN coalesce(v_explanation, explanation) ELSE explanation END AS explanation,
  CASE WHEN judged AND n >= least(2, total) THEN coalesce(v_fix, suggested_fix) ELSE suggested_fix END AS suggested_fix,
  judged AND n > 0 AS llm_validated, coalesce(judged AND n >= least(2, total), false) AS majority,
  CASE WHEN judged THEN n || '/' || total END AS validation_votes,
  CASE WHEN total IS NULL THEN 'no model was asked' WHEN error IS NOT NULL THEN 'validation failed: ' || error END AS validation_note
FROM voted"""



def embedding(expr: str) -> str:
    """The numbers of a 256-bit hash embedding in 128ths, as a text."""
    return f"array_to_string(list_transform(range(0, 32), lambda i: ('0x' || substr(sha256({expr}), i * 2 + 1, 2))::INTEGER - 128), ',')"


# ------------------------------------------------------------ similarity

SCORED = """
WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS language, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score
  FROM e a JOIN e b USING (language)
),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
  QUALIFY rank <= 6
),
described AS (
  SELECT *, 'type' || (vec_id % 7) AS bug_type, CASE WHEN vec_id % 2 = 0 THEN ' E' ELSE 'e' END || (vec_id % 40) AS explanation,
    'fix' || vec_id AS fix FROM best WHERE score > 0.3 AND score < 0.99
),
single AS (
  SELECT * FROM described QUALIFY row_number() OVER (PARTITION BY query_id, lower(trim(explanation)) ORDER BY rank) = 1
),
kept AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, vec_id, bug_type, explanation, fix,
    round_even(score * 100, 1) AS similarity FROM single QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 3
)
"""

# ------------------------------------------------------------ quality

GAPPY = """
gappy AS (
  SELECT CASE WHEN event_id % 5 <> 0 THEN value END AS value, CASE WHEN event_id % 2 = 0 THEN event_type END AS event_type,
    CASE WHEN event_id % 16 <> 3 THEN user_id % 3 END AS bucket, CAST(NULL AS VARCHAR) AS nothing,
    CASE WHEN event_id % 4 = 0 THEN event_type ELSE CAST(event_id % 7 AS VARCHAR) END AS mixed,
    CASE WHEN event_id % 2 = 0 THEN 'x' ELSE CAST(event_id % 3 AS VARCHAR) END AS half
  FROM events
)"""
NUMBER = P.NUMBER.replace(r"\s", r"[\t\n\f\r\v ]")


def table_report(cte: str, source: str, name: str, columns: list[tuple[str, str]]) -> str:
    """A table's report; ``columns`` are (name, kind) in table order."""
    missing, mixed, empty, far = [], [], [], []
    for pos, (col, kind) in enumerate(columns):
        stats = f"(SELECT count(*) AS n_rows, count(*) - count({col}) AS n, count({col}) AS present"
        if kind == "text":
            stats += f", count(*) FILTER (WHERE regexp_matches({col}, {q(NUMBER)})) AS numeric"
        stats += f" FROM {source})"
        pct = "round_even(n * 100 / n_rows, 1)"
        missing.append(
            f"SELECT {Q.SECTION + pos} AS ord, 'Missing Values' AS bug_type, {q(col)} AS column_name, "
            + _words("Missing Values", column=q(col), n="CAST(n AS VARCHAR)", pct=f"CAST({pct} AS VARCHAR)")
            + f", CASE WHEN {pct} > 30 THEN 'high' ELSE 'medium' END AS severity FROM {stats} WHERE n > 0"
        )
        empty.append(f"SELECT {pos} AS pos, {q(col)} AS col FROM {stats} WHERE present = 0")
        if kind == "text":
            mixed.append(
                f"SELECT {3 * Q.SECTION + pos}, 'Type Mismatch', {q(col)}, "
                + _words("Type Mismatch", column=q(col), n="CAST(numeric AS VARCHAR)", present="CAST(present AS VARCHAR)")
                + f", 'high' FROM {stats} WHERE numeric > 0 AND numeric < present AND numeric > present * 0.5"
            )
        if kind == "number":
            far.append(
                f"SELECT {5 * Q.SECTION + pos}, 'Data Anomaly', {q(col)}, "
                + _words("Data Anomaly", column=q(col), n="CAST(n AS VARCHAR)", upper="printf('%.2f', hi)")
                + f", 'medium' FROM (SELECT hi, (SELECT count(*) FROM {source} WHERE {col} < lo OR {col} > hi) AS n "
                f"FROM (SELECT q1 - 3 * (q3 - q1) AS lo, q3 + 3 * (q3 - q1) AS hi FROM (SELECT quantile_cont({col}, 0.25) AS q1, "
                f"quantile_cont({col}, 0.75) AS q3 FROM {source}) WHERE q3 > q1)) WHERE n > 0"
            )
    dup = (
        f"SELECT {2 * Q.SECTION}, 'Duplicate Rows', NULL, "
        + _words("Duplicate Rows", n="CAST(n AS VARCHAR)", rows="CAST(n_rows AS VARCHAR)")
        + f", 'medium' FROM (SELECT sum(c - 1) AS n, sum(c) AS n_rows FROM (SELECT count(*) AS c FROM {source} GROUP BY "
        + ", ".join(c for c, _ in columns)
        + ")) WHERE n > 0"
    )
    none = (
        f"SELECT {4 * Q.SECTION}, 'Empty Columns', NULL, "
        + _words("Empty Columns", column="cols")
        + f", 'low' FROM (SELECT string_agg(col, ', ' ORDER BY pos) AS cols FROM ({' UNION ALL '.join(empty)})) WHERE cols IS NOT NULL"
    )
    parts = [*missing, dup, *mixed, none, *far]
    clean = (
        f"SELECT {6 * Q.SECTION}, 'No Issues', NULL, "
        + _words("No Issues", rows="CAST((SELECT count(*) FROM " + source + ") AS VARCHAR)", columns=q(str(len(columns))))
        + ", 'info' WHERE NOT EXISTS (SELECT 1 FROM found)"
    )
    return (
        f"WITH {cte + ',' if cte else ''} found AS ({' UNION ALL '.join(parts)}), "
        f"report AS (SELECT * FROM found UNION ALL {clean}) "
        f"SELECT {q(name)} AS table_name, ord, bug_type, 0 AS line_number, column_name, explanation, impact, severity, "
        f"suggested_fix, 'csv_analyzer' AS source FROM report"
    )


def _words(kind: str, **values: str) -> str:
    names = ("explanation", "impact", "suggested_fix")
    return ", ".join(f"{fill(t, **values)} AS {n}" for t, n in zip(Q.WORDS[kind], names))


EVENT_COLUMNS = [("event_id", "number"), ("ts", "other"), ("user_id", "number"), ("event_type", "text"), ("value", "number"), ("props", "text")]
GAPPY_COLUMNS = [("value", "number"), ("event_type", "text"), ("bucket", "number"), ("nothing", "text"), ("mixed", "text"), ("half", "text")]
LINEITEM_COLUMNS = [
    ("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"), ("l_quantity", "number"),
    ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "text"), ("l_linestatus", "text"),
    ("l_shipdate", "other"),
]
