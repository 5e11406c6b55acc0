"""Files in byte ranges, against plain versions that read them whole."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from gumshoe.functions import text
from gumshoe.operators import js_scan, line_patterns
from gumshoe.sources import blocks, files, tables


@pytest.fixture(params=[64, 1 << 20], ids=["small", "large"])
def small_blocks(spark, request):
    """Files are cut after every 64 bytes, or not at all, and python gets three rows at a time."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], str(request.param))
    spark.conf.set(names[1], "0")
    spark.conf.set(names[2], "3")
    yield
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def field(rnd):
    kind = rnd.randrange(7)
    plain = "".join(rnd.choice("abc 12") for _ in range(rnd.randrange(6))) or "z"
    if kind < 3:
        return plain
    inside = "".join(rnd.choice('ab,\n"x\r\n ') for _ in range(rnd.randrange(40)))
    return '"' + inside.replace('"', '""') + '"' if kind < 6 else plain + '"' + plain


@pytest.mark.parametrize("seed", range(6))
def test_records_across_blocks(spark, tmp_path, small_blocks, seed):
    rnd = random.Random(seed)
    end = rnd.choice(["\n", "\r\n"])
    for name in ("one", "two"):
        lines = ["a,b,c"] + [",".join(field(rnd) for _ in range(3)) for _ in range(rnd.randrange(1, 60))]
        (tmp_path / f"{name}.csv").write_text(end.join(lines) + rnd.choice(["", end]), newline="")
    want = []
    for name in ("one", "two"):
        want += list(csv.reader(io.StringIO((tmp_path / f"{name}.csv").read_bytes().decode(), newline="")))[1:]
    raw = tables.read_raw_csv(spark, str(tmp_path))
    got = [[x or "" for x in r] for r in raw.drop(tables.EXTRA).collect()]
    assert raw.filter(F.col(tables.EXTRA).isNotNull()).count() == 0
    clean = lambda rows: sorted([x.strip() for x in r] for r in rows)
    assert clean(got) == clean(want)


def test_one_record_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f'line {i}, "" end' for i in range(200))
    (tmp_path / "t.csv").write_text(f'a,b\n1,"{long}"\n2,x\n', newline="")
    got = tables.read_raw_csv(spark, str(tmp_path / "t.csv")).orderBy("a").collect()
    assert [(r.a, r.b) for r in got] == [("1", long.replace('""', '"')), ("2", "x")]


def report(spark, path):
    return [(r.bug_type, r.line_number, r.severity, r.explanation) for r in tables.csv_report(spark, str(path), "t").collect()]


def test_files_that_cannot_be_read(spark, tmp_path, small_blocks):
    cases = {
        "empty": (b"", "1 files hold no header"),
        "blank": (b"\n  \n\r\n", "1 files hold no header"),
        "open": (b'a,b\n1,"x\ny\n', "1 rows open a quote that is never closed"),
        "latin": ("a,b\n1,caf\u00e9\n".encode("latin-1"), "1 rows are not UTF-8 text"),
        "long": (b'a,b\n1,"x\n,,"\n1,2,3\n1,2,\n', "2 rows have more fields than the header"),
    }
    for name, (data, why) in cases.items():
        (tmp_path / name).write_bytes(data)
        assert report(spark, tmp_path / name) == [("CSV Parse Error", 1, "critical", why)]


def test_headers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/one.csv").write_text("\n\na,b\n1,2\na,b\n")
    (tmp_path / "d/two.csv").write_text('"b","c\nd"\n3,4\n')
    got = tables.read_raw_csv(spark, str(tmp_path / "d")).drop(tables.EXTRA)
    assert got.columns == ["b", "c\nd", "a"] or got.columns == ["a", "b", "c\nd"]
    rows = sorted((r["a"] or "", r["b"], r["c\nd"] or "") for r in got.collect())
    assert rows == [("", "3", "4"), ("1", "2", ""), ("a", "b", "")]
    (tmp_path / "odd.csv").write_text("x,,x,x.1\n1,2,3,4\n")
    assert tables.read_raw_csv(spark, str(tmp_path / "odd.csv")).columns[:-1] == ["x", "Unnamed: 1", "x.1", "x.1.1"]


def test_stray_quotes_open_nothing(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n5" disk,x\ny,3" z\n"q"w,r\n')
    got = tables.read_raw_csv(spark, str(tmp_path / "t.csv")).collect()
    assert [(r.a, r.b) for r in got][:2] == [('5" disk', "x"), ("y", '3" z')] and len(got) == 3


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_numbered_lines_are_those_of_the_whole_file(spark, tmp_path, small_blocks, end):
    rnd = random.Random(3)
    for k in range(4):
        body = end.join("".join(rnd.choice("abc \x0b\x0c\u2028\x85é") for _ in range(rnd.randrange(30))) for _ in range(80)) + "e"
        (tmp_path / f"{k}.py").write_bytes((body + rnd.choice(["", end])).encode())
    (tmp_path / "latin.py").write_bytes("caf\u00e9\x85x\n".encode("latin-1") * 30 + b"plain\n")
    (tmp_path / "empty.py").write_bytes(b"")
    whole = files.read_source_corpus(spark, str(tmp_path)).select("file_name", F.posexplode(text.split_lines(F.col("content"))).alias("line", "text"))
    want = sorted((r.file_name, r.line + 1, r.text) for r in whole.collect())
    got = blocks.numbered_lines(spark, str(tmp_path / "*.py"))
    assert sorted((r.file.rpartition("/")[2], r.line, r.text) for r in got.collect()) == want


def test_patterns_of_one_large_file(spark, tmp_path, small_blocks):
    """Line numbers and hits of a file in many blocks equal those of the file as one row."""
    rnd = random.Random(7)
    lines = {
        "py": ["def f(a=[]):", "x = a[42]", "except:", "password = 'p'", "global g", "pass", ""],
        "js": ["if (a == b)", "eval(x)", "token: 'abc'", "// eval(x)", "let y = 1;"],
    }
    for name, options in lines.items():
        (tmp_path / f"big.{name}").write_text("\n".join(rnd.choice(options) for _ in range(500)))
    whole = files.read_source_corpus(spark, str(tmp_path)).withColumn("file_id", F.col("file_name"))
    want = line_patterns.python_pattern_hits(whole).unionByName(
        js_scan.js_hits(whole).filter("source = 'pattern_detector'").select("file_id", "language", "line", "source", "ord", "type", "message")
    )
    read = blocks.numbered_lines(spark, str(tmp_path)).withColumn("file_id", F.regexp_extract("file", "([^/]+)$", 1))
    read = read.withColumn("language", files.language_from_extension(F.col("file")))
    got = line_patterns.pattern_hits_of_lines(read)
    key = ["file_id", "line", "type", "ord", "message"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_a_quoted_line_is_followed_once_from_either_state(monkeypatch):
    asked, follow = [], tables.ends_open
    monkeypatch.setattr(tables, "ends_open", lambda line, is_open: asked.append(is_open) or follow(line, is_open))
    block = tables._Block("f", 1)
    for line in ('1,"a', 'b"', 'c,d"e', '"'):
        block.pass_line(line)
    assert asked == [False, True] * 4 and (block.ends, block.opens) == ([True, True], True)


def test_lines_that_are_not_text_beside_quoted_ones(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('key,text\n1,"a, b"\n2,grün\n3,"c"\n'.encode("latin-1"))
    rows = tables.read_raw_csv(spark, str(tmp_path / "t.csv"))
    assert sorted((r["key"], r[tables.EXTRA]) for r in rows.select("key", tables.EXTRA).collect()) == [("1", None), ("2", tables.NOT_TEXT), ("3", None)]
