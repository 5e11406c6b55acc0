"""A second run parses what changed, and gives what a full scan gives."""

from gumshoe.operators.code_scan import candidate_findings
from gumshoe.plans import rescan

PY, JS = "def f(a=[]):\n    return g(a)\n", "if (a == b) { eval(c) }\n"


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_id string, language string, content string")


def rows(df, columns):
    return sorted(map(tuple, df.select(*sorted(columns)).collect()), key=str)


def test_runs_over_changing_files(spark, tmp_path):
    store = str(tmp_path)
    first = frame(spark, [("a", "python", PY), ("b", "javascript", JS), ("c", "java", "class C"), ("d", "python", None), ("e", "python", "def (")])
    second = frame(
        spark, [("a", "python", PY), ("b", "javascript", JS + JS), ("c", "java", "class C"), ("f", "python", PY), ("e", "javascript", "def (")]
    )
    for run, files, parsed in (
        ("1", first, "abcde"), ("2", second, "bef"), ("3", second, ""), ("4", first, ""), ("2", second, "bef"), ("5", frame(spark, []), ""),
    ):
        got = rescan.rescan(files, store, run)
        want = candidate_findings(files)
        assert rows(got, want.columns) == rows(want, want.columns)
        assert sorted(r.file_id for r in rescan.scanned_files(spark, store, run).collect()) == list(parsed)
