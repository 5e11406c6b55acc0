import time

import pytest

from gumshoe.operators import code_scan, findings, js_scan, lines, python_scan

JS = """function first(list, opts = {}) {
  for (let i = 0; i <= list.length; i++) {
    total = list[i + 1];
  }
  return opts.size / list.count;
}
const second = async (user, unused) => {
  console.log(user.name);
  if (user) {
    user.name = 'x';
  }
  // user.old / zero
  first(null);
  eval(code);
  password: "abc"
  if (a == b) {}
};"""


def hits(files, *rows):
    return {(r.line, r.type) for r in js_scan.js_hits(files(*rows)).collect()}


def test_js_rules(files):
    got = hits(files, ("javascript", JS))
    assert {
        (2, "off_by_one"), (2, "null_reference"), (3, "out_of_bounds"), (3, "undefined_variable"), (5, "division"),
        (5, "null_reference"), (13, "null_argument"), (14, "security"), (14, "eval"),
        (14, "undefined_variable"), (15, "hardcoded_secret_js"), (16, "loose_equality"),
    } <= got
    assert (12, "division") not in got and (12, "null_reference") not in got
    assert (8, "null_reference") not in got  # only the first member access of a line is looked at
    # "return" lines are exempt from the undefined check, line 10 is guarded from line 9
    assert (5, "undefined_variable") not in got and (10, "null_reference") not in got


def test_other_languages_have_no_hits(files):
    assert hits(files, ("java", JS), ("python", JS)) == set()


@pytest.mark.parametrize("gap, found", [(3, False), (4, True)])
def test_guard_reaches_four_lines(files, gap, found):
    text = "\n".join(["function f(p) {", "if (p) {}", *["x"] * gap, "p.a"])
    assert ((gap + 3, "null_reference") in hits(files, ("javascript", text))) is found


def test_only_the_last_definition_counts(files):
    text = "function f(a) {\nfunction f(b) {\n\n\n\n\n\na.x\nb.x"
    got = hits(files, ("typescript", text))
    assert (9, "null_reference") in got and (8, "null_reference") not in got
    # parameters of every definition stay declared
    assert (8, "undefined_variable") in got  # the member name x is what is unknown
    names = {r.name for r in js_scan.js_declared_names(files(("javascript", text))).collect()}
    assert {"a", "b", "f", "console"} <= names


def test_division_after_a_comment_mark(files):
    got = hits(files, ("javascript", "url = x // a / b"), ("javascript", "y = a / b // c"))
    assert (1, "division") in got
    rows = js_scan.js_hits(files(("javascript", "u('http://a/b')"))).filter("type = 'division'").collect()
    assert rows == []


def test_scope_agrees_with_line_facts(files):
    """The whole-text declarations equal the ones found line by line."""
    text = "\r\n".join([JS, "var q\x85let (z) = 3", " export async function g ( k = (1), m ) {", "for(var w in q)", "const h = (u\n v) =>"])
    df = files(("javascript", text))
    whole = set(js_scan.with_scope(df).first().declared)
    by_line = {r.name for r in js_scan.js_variables(df).collect()} | {r.name for r in js_scan.js_loop_variables(df).collect()}
    for r in js_scan.js_functions(df).collect():
        by_line |= {r.name, *r.params}
    assert whole == by_line


def test_js_line_facts(files):
    text = "import a from 'b'\nconst c = require('d')\nexport class E {\nwhile (f(1) && g.h(2)) {\nif(x){}\n// for (;;)"
    got = {(r.line, r.kind, r.name) for r in js_scan.js_line_facts(files(("javascript", text))).collect()}
    assert got == {
        (1, "import", "import a from 'b'"), (2, "import", "const c = require('d')"), (2, "call", "require"),
        (3, "class", "E"), (4, "loop", "while"), (4, "call", "f"), (4, "call", "h"), (5, "conditional", None),
    }


def risks(files, text):
    parsed = python_scan.parse_python(files(("python", text)))
    return {(r.line, r.type) for r in python_scan.python_risks(parsed).collect()}


def test_python_rules(files):
    text = (
        "import math\n"
        "def div(a, b):\n    return a // b\n"
        "def nxt(xs):\n    try:\n        return xs[0 + 1]\n    except:\n        return math.sqrt(nope) % 2\n"
        "div(1, 0)\ndiv(1, False)\ndiv(0.0)\nother(0)\nobj.div(0)\n"
        "total = missing\n"
    )
    assert risks(files, text) == {
        (3, "division"), (6, "out_of_bounds"), (7, "bare_except"), (8, "negative_sqrt"), (8, "division"),
        (8, "undefined_variable"), (9, "zero_argument"), (10, "zero_argument"), (11, "zero_argument"), (13, "zero_argument"),
    }


def test_dedupe_keeps_the_first_risk(spark):
    rows = [("f", "a", 1, 5, "late"), ("f", "a", 1, 2, "early"), ("f", "b", 1, 9, "other"), ("g", "a", 1, 7, "file")]
    df = spark.createDataFrame(rows, "file_id string, type string, line int, ord long, message string")
    df = df.selectExpr("*", "'' as variable", "'' as function", "'' as param")
    assert {r.message for r in findings.dedupe_risks(df).collect()} == {"early", "other", "file"}


def test_python_names_are_pooled_per_file(files):
    text = (
        "def a(p):\n    local = p\n    return other\n"
        "def b():\n    other = 1\n    return local\n"
        "outer = 1\n"
        "def c(*args, **kw):\n    return outer, args\n"
        "async def d():\n    return never\n"
    )
    assert risks(files, text) == {(9, "undefined_variable")}


def test_python_redefinition_decides_the_parameter(files):
    text = "def f(a, b):\n    pass\ndef f(a):\n    pass\nf(1, 0)\nf(0)\n"
    assert risks(files, text) == {(6, "zero_argument")}


def test_syntax_error_is_the_only_fact(files):
    parsed = python_scan.parse_python(files(("python", "x = 1\ndef f(:\n  pass"), ("python", "")))
    rows = python_scan.python_facts(parsed).collect()
    assert [(r.kind, r.line) for r in rows] == [("syntax_error", 2)]


def test_huge_literals_do_not_break_a_job(files):
    text = "a[i + 0x" + "f" * 9000 + "]\n"
    assert risks(files, text) == {(1, "out_of_bounds")}


def test_parser_wins_over_pattern(files):
    text = "try:\n    pass\nexcept:\n    pass\n"
    rows = code_scan.candidate_findings(files(("python", text))).collect()
    assert [(r.line_number, r.bug_type, r.source) for r in rows] == [(3, "Bare Except", "parser")]


def test_python_patterns(files):
    text = "def f(a=[]):\ndef g(a=()):\n    global q\n  x[12]\n  if x[12]\n  x[1]\n  x[-12] = y[0]\nexcept :\nexcept E:\nTOKEN = 'a'"
    found = code_scan.candidate_findings(files(("python", text)))
    got = {(r.line_number, r.bug_type) for r in found.filter("source = 'pattern_detector'").collect()}
    assert got == {
        (1, "Mutable Default Argument"), (2, "Mutable Default Argument"), (3, "Global Variable Usage"),
        (4, "Index Out of Range"), (7, "Index Out of Range"), (8, "Bare Except"), (10, "Hardcoded Secret"),
    }


def test_long_lines_are_searched_in_linear_time(files):
    many = "def a(b) " * 40_000
    spaces = "x" + " " * 200_000 + "y"
    rows = [("python", many), ("python", many + "=[]"), ("javascript", spaces), ("javascript", "w" * 200_000)]
    found = code_scan.candidate_findings(files(*rows)).filter("source = 'pattern_detector'").collect()
    assert [(r.file_id, r.bug_type) for r in found] == [("f1", "Mutable Default Argument")]


def test_fix_texts_fill_in_bindings(files):
    rows = code_scan.candidate_findings(files(("javascript", JS))).collect()
    by_type = {r.bug_type: r.suggested_fix for r in rows}
    assert by_type["Off-by-One Error"].startswith("Stop at i < list.length")
    assert "length of list" in by_type["Index Out of Bounds"]  # javascript binds no variable here


def test_partitioning_does_not_change_results(files, spark):
    df = files(*[("javascript", JS), ("python", "def f(a):\n    return a / b\n"), ("typescript", JS)] * 5)
    one = code_scan.candidate_findings(df.coalesce(1))
    many = code_scan.candidate_findings(df.repartition(8))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    keys = one.groupBy("file_id", "line_number", "bug_type").count()
    assert keys.filter("count > 1").count() == 0
    counts = lines.line_counts(df)
    assert one.join(counts, "file_id").filter("line_number < 0 or line_number > line_count").count() == 0


def test_a_very_long_line_is_read_whole(files):
    text = "x " * 60_000 + "= eval(late)"
    assert (1, "security") in hits(files, ("javascript", text))


def test_dedupe_reads_a_hot_key_once_per_task(files):
    plan = findings.dedupe_findings(code_scan.candidate_findings(files(("javascript", JS))))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text


def test_lint_order_and_severity(spark, files):
    lint = spark.createDataFrame(
        [("f0", 0, 2, "unused thing", "high", "pylint"), ("f0", 1, 3, "undefined type", "critical", "pylint"),
         ("f0", 2, 4, "import", "medium", "pylint"), ("f0", 3, 3, "not defined", "high", "pylint")],
        "file_id string, ord int, line int, issue string, severity string, tool string",
    )
    rows = code_scan.candidate_findings(files(("java", "x")), lint).orderBy("ord").collect()
    assert [(r.line_number, r.bug_type, r.source) for r in rows] == [
        (2, "Unused Code", "pylint"), (3, "Undefined Variable", "pylint")
    ]
    assert rows[1].explanation == "undefined type"


def test_time_grows_with_the_declarations_of_a_file(files):
    def seconds(n):
        text = "\n".join(f"var name{i} = 1;\nname{i} = other + name{i * 7 % n};" for i in range(n))
        start = time.monotonic()
        assert js_scan.js_hits(files(("javascript", text))).filter("type = 'undefined_variable'").count() == n
        return time.monotonic() - start

    seconds(500)
    few, many = seconds(4_000), seconds(32_000)
    assert many < 16 * max(few, 1)


def test_time_grows_with_the_uses_of_a_python_file(files):
    def seconds(n):
        text = "\n".join(f"def f{i}(a, b):\n    return a + y{i} + f{i - 1}(0, 0)" for i in range(1, n + 1))
        start = time.monotonic()
        found = python_scan.python_risks(python_scan.parse_python(files(("python", text))))
        # the first call goes to f0, which the file does not define; of two zero arguments on a line one is reported
        kinds = {r["type"]: r["count"] for r in found.groupBy("type").count().collect()}
        assert kinds == {"zero_argument": n - 1, "undefined_variable": n}
        return time.monotonic() - start

    seconds(500)
    few, many = seconds(2_000), seconds(16_000)
    assert many < 16 * max(few, 1)
