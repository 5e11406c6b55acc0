import hashlib

import pytest
from pyspark.sql import functions as F

from gumshoe.functions import text as T
from gumshoe.operators import lines

BREAKS = [
    "", "a", "a\n", "a\r\nb", "a\rb\n\n", "\n", "\r\n\r\n", "a\x0bb\x0cc", "x\x1cy\x1dz\x1e", "é\x85ü\u2028b\u2029",
    "no break at all ", "\n\na",
]


def test_split_lines_equals_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(BREAKS)], "i int, s string")
    got = {r.i: r.l for r in df.select("i", T.split_lines(F.col("s")).alias("l")).collect()}
    counts = {r.i: r.n for r in df.select("i", T.line_count(F.col("s")).alias("n")).collect()}
    for i, s in enumerate(BREAKS):
        assert got[i] == s.splitlines(), repr(s)
        assert counts[i] == len(s.splitlines())


def test_lines_are_numbered_from_one(files):
    rows = lines.split_lines(files(("x", "a\nb\n"))).collect()
    assert [(r.line, r.text) for r in rows] == [(1, "a"), (2, "b")]


def test_strip_equals_python(spark):
    texts = [" a ", "\u3000b\xa0", "\x1f c \u2003", "\u200bd", "", "\t\n"]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    got = [r.s for r in df.select(T.strip(F.col("s")).alias("s")).collect()]
    assert sorted(got) == sorted(s.strip() for s in texts)


def test_lines_are_stripped_as_python_does(spark, files):
    white = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    edges = [*white, "", "  ", " \t", "\u3000 ", "!", "~", "\x7f", "\x00", "\u200b", "é", "\U0001d400", "~x"]
    texts = ["", *edges, *[a + b for a in edges for b in ("x", "x \u2003y", "é")], *[b + a for a in edges for b in ("x", "é")], *[a + "x" + a for a in edges]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*texts, None])], "i int, text string")
    got = {r.i: r.text for r in lines.trim_lines(df).collect()}
    assert got == {i: s if s is None else s.strip() for i, s in enumerate([*texts, None])}
    assert lines.trim_lines(df).schema == df.schema


def test_tokens_are_those_of_the_whole_expression(spark):
    signs = ["//", '"', "'", "`", "a1 ", "_b", "é"]
    texts = [x + y + z + "'w" + x for x in signs for y in signs for z in signs]
    df = spark.createDataFrame([("f", i, s) for i, s in enumerate([*texts, "", None, "9z"])], "file_id string, line int, text string")
    plain = df.select("file_id", "line", F.posexplode(T.identifiers(T.strip_comments_and_strings(F.col("text")))).alias("pos", "token"))
    got = lines.tokenize(df)
    assert got.schema == plain.schema and sorted(got.collect()) == sorted(plain.collect())


def test_split_lines_keeps_the_other_columns(spark):
    df = spark.createDataFrame([("a\r\nb", 1, "p"), (None, 2, "q"), ("", 3, "r")], "`the text` string, plain int, `a b` string")
    got = lines.split_lines(df, "the text")
    assert got.columns == ["plain", "a b", "line", "text"]
    assert [tuple(r) for r in got.collect()] == [(1, "p", 1, "a"), (1, "p", 2, "b")]


def test_strings_are_blanked_after_comments(spark):
    row = spark.createDataFrame([("a = 'x' + \"y // z\" // tail 'q'",)], "s string")
    got = row.select(T.strip_comments_and_strings(F.col("s")).alias("s")).first().s
    assert got == "a = '' + \"y "  # the comment is cut first, even inside quotes


def test_identifiers_start_at_word_starts(spark):
    row = spark.createDataFrame([("éa b1 2c _d x.é9 ñ",)], "s string")
    assert row.select(T.identifiers(F.col("s")).alias("t")).first().t == ["b1", "_d", "x"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("```python\n\n x = “a”  \n  \n```\n", ' x = "a"'),
        ("\u00a0y\u2014\u2026", " y--..."),
        ("   \n\n", ""),
        ("", ""),
        ("a\n\n b", "a\n\n b"),
    ],
)
def test_clean_extracted_text(spark, raw, clean):
    row = spark.createDataFrame([(raw,)], "s string")
    assert row.select(T.clean_extracted_text(F.col("s")).alias("s")).first().s == clean


@pytest.mark.parametrize(
    "code, scored, simple",
    [
        ("  \n", "unknown", "python"),
        ("def f():\n    import os", "python", "python"),
        ("const a = () => console.log(1)", "javascript", "javascript"),
        ("let a: string = 'x'", "typescript", "python"),
        ("interface A {}", "typescript", "python"),
        ("hello", "python", "python"),
    ],
)
def test_languages(spark, code, scored, simple):
    row = spark.createDataFrame([(code,)], "s string")
    got = row.select(T.detect_language(F.col("s")).alias("a"), T.detect_language_simple(F.col("s")).alias("b")).first()
    assert (got.a, got.b) == (scored, simple)


def test_resolve_language(spark):
    row = spark.createDataFrame([(" SQL", "x"), ("elvish", "const a => 1"), (None, "def ")], "d string, s string")
    got = [r.l for r in row.select(T.resolve_language(F.col("d"), F.col("s")).alias("l")).collect()]
    assert got == ["sql", "javascript", "python"]


def test_numbers(spark):
    yes = ["1", " -2.5 ", "1e9", ".5", "5.", "+3", "inf", "-Infinity"]
    no = ["", "1_000", "NaN", "1d", "0x1", "abc", "1 2", "e5", "."]
    df = spark.createDataFrame([(s,) for s in yes + no], "s string")
    got = {r.s for r in df.filter(T.is_number(F.col("s"))).collect()}
    assert got == set(yes)


def test_hash_embedding(spark):
    row = spark.createDataFrame([("naïve text",)], "s string")
    want = [(b - 128) / 128.0 for b in hashlib.sha384("naïve text".encode()).digest()]
    assert row.select(T.hash_embedding(F.col("s")).alias("v")).first().v == want


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    got = row.select(T.cosine(F.col("a"), F.col("b")).alias("x"), T.cosine(F.col("a"), F.col("z")).alias("y")).first()
    assert got.x == pytest.approx(0.5**0.5) and got.y == 0.0


def test_finding_text(spark):
    row = spark.createDataFrame([(None, "py", "e", None, "f")], "b string, l string, e string, i string, f string")
    got = row.select(T.finding_text(*(F.col(c) for c in "bleif")).alias("t")).first().t
    assert got == "Bug Type: Unknown | Language: py | Explanation: e | Impact:  | Fix: f"
