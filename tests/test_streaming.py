import hashlib
import json
import os
import pathlib

from gumshoe.streaming import intake
from gumshoe.streaming.intake import incremental_scan


def test_intake_reviews_each_file_once(spark, tmp_path):
    inbox, outbox, checkpoint = (tmp_path / n for n in ("in", "out", "cp"))
    inbox.mkdir()

    def run():
        query = incremental_scan(spark, str(inbox), str(outbox), str(checkpoint))
        query.awaitTermination(240)
        assert query.exception() is None

    (inbox / "a.js").write_text("x = a / b\n")
    (inbox / "skip.txt").write_text("x = a / b\n")
    run()
    (inbox / "b.py").write_text("def f(q):\n    return q % 2\n")
    run()
    run()  # nothing new
    found = spark.read.option("basePath", f"{outbox}/findings").parquet(f"{outbox}/findings")
    got = sorted((r.batch, r.language, r.bug_type) for r in found.collect())
    assert got == [(0, "javascript", "Division by Zero"), (0, "javascript", "Undefined Variable"), (1, "python", "Division by Zero")]
    log = spark.read.parquet(f"{outbox}/log")
    assert log.count() == 2
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    assert not list(shared.glob("kept-*"))  # a batch leaves nothing but its output
    counts = spark.read.parquet(f"{outbox}/runs").orderBy("batch").collect()
    assert [(r.batch, r.total_bugs) for r in counts] == [(0, 2), (1, 1)]
    assert [(r.path.rpartition("/")[2], r.reason) for r in spark.read.parquet(f"{outbox}/rejects").collect()] == [("skip.txt", "type")]


def put(folder, name, rows, minute):
    """A file of JSON lines that arrived at a minute of the day."""
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)) if isinstance(rows, list) else rows)
    at = 1_700_000_000 + 60 * minute
    os.utime(folder / name, (at, at))


def uri(path):
    return f"file:{path}"


def rows_of(spark, outbox, part, *columns):
    path = outbox / part
    if not path.exists():
        return []
    return sorted((tuple(map(str, r)) for r in spark.read.option("basePath", str(path)).parquet(str(path)).select(*columns).collect()))


def test_parts_that_arrive_later(spark, tmp_path):
    inbox, outbox, files = tmp_path / "in", tmp_path / "out", tmp_path / "in/files"
    for name in ("files", "lint", "runs", "texts"):
        (inbox / name).mkdir(parents=True)

    def run():
        intake.incremental_review(spark, str(inbox), str(outbox), str(tmp_path / "cp"), models=("m",), wait_seconds=600).awaitTermination()
        names = {files_id(p): p.name for p in files.iterdir()}
        found = {(names[f], b) for f, b in rows_of(spark, outbox, "log", "file_id", "batch")}
        return sorted(f for f, _ in found), rows_of(spark, outbox, "rejects", "path", "reason")

    def files_id(path):
        return hashlib.sha256(uri(path).encode()).hexdigest()[:32]

    bad = "try:\n    x = 1\nexcept:\n    pass\n"
    for name in ("whole.py", "later.py", "never.py"):
        put(files, name, bad, 0)
    put(files, "shot.png", "png", 0)
    put(files, "blank.png", "png", 0)
    put(files, "t.csv", "a,b\n1,\n1,\n", 0)
    put(files, "x.exe", "?", 0)
    lint = '[{"type":"error","line":2,"message":"no such name","symbol":"s"}]'
    answer = '[{"bug_type":"Bare Except","line_number":3,"explanation":"said so","suggested_fix":"f"}]'
    report = lambda name: {"path": uri(files / name), "tool": "pylint", "report": lint}
    said = lambda name: {"path": uri(files / name), "model": "m", "model_ord": 0, "status": "ok", "response": answer}
    put(inbox / "lint", "1", [report("whole.py")], 0)
    put(inbox / "runs", "1", [said("whole.py")], 1)
    done, rejects = run()
    assert done == ["whole.py"]
    assert [r[1] for r in rejects] == ["type"]
    assert {r[0] for r in rows_of(spark, outbox, "tables", "bug_type")} == {"Missing Values", "Duplicate Rows", "Empty Columns"}

    put(inbox / "lint", "2", [report("later.py")], 3)
    put(inbox / "texts", "2", [{"path": uri(files / "shot.png"), "raw_text": "```python\n" + bad + "```", "declared_language": "python"}], 3)
    put(inbox / "runs", "2", [said("later.py"), said("shot.png")], 4)
    done, _ = run()
    assert done == ["later.py", "whole.py"]  # the picture's text waits for its lint report

    put(inbox / "lint", "3", [report("shot.png"), {"path": "file:/gone.py", "tool": "pylint", "report": lint}], 5)
    assert run()[0] == ["later.py", "shot.png", "whole.py"]

    put(inbox / "lint", "4", [report("whole.py")], 60)  # the watermark passes: waiting is over
    run()
    put(inbox / "lint", "5", [report("never.py")], 120)  # comes too late: an orphan, like the report that named no file
    run()
    put(inbox / "lint", "6", [{"path": "file:/end", "tool": "pylint", "report": "[]"}], 300)
    run()
    done, rejects = run()
    assert done == ["later.py", "never.py", "shot.png", "whole.py"]
    assert sorted(r[1] for r in rejects) == ["no text", "orphan", "orphan", "orphan", "type"]

    names = {files_id(p): p.name for p in files.iterdir()}
    votes = {(names[f], b): v for f, b, v in rows_of(spark, outbox, "findings", "file_id", "bug_type", "llm_validated")}
    assert votes["later.py", "Bare Except"] == votes["whole.py", "Bare Except"] == "True"
    assert votes["never.py", "Bare Except"] == "False"
    assert [k for k in votes if k[0] == "shot.png" and k[1] == "Bare Except"]
    before = {p: rows_of(spark, outbox, p, "batch") for p in ("findings", "log", "rejects", "history")}
    last = sorted((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda p: int(p.name))[-1]
    for part in (last, last.with_name(f".{last.name}.crc")):  # as if the job had died before its last batch was committed
        part.unlink(missing_ok=True)
    run()
    assert {p: rows_of(spark, outbox, p, "batch") for p in before} == before
